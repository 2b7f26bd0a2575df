"""Boxes: struct<x1,y1,x2,y2>. All arithmetic stays in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Coordinates are cut toward zero."""
    return F.struct(*[c.cast("int").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def metrics(b: Column) -> Column:
    """struct<width, height, area, center_x, center_y>; the centre is cut toward zero."""
    width, height = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return F.struct(
        width.alias("width"),
        height.alias("height"),
        (width * height).alias("area"),
        ((b["x1"] + b["x2"]) / 2).cast("int").alias("center_x"),
        ((b["y1"] + b["y2"]) / 2).cast("int").alias("center_y"),
    )


def valid(b: Column) -> Column:
    return (b["x1"] < b["x2"]) & (b["y1"] < b["y2"]) & (b["x1"] >= 0) & (b["y1"] >= 0)


def expand(b: Column, scale_x: float, scale_y: float) -> Column:
    """Scaled about the centre; the left and upper edges stop at 0, the others do not stop."""
    if scale_x <= 0 or scale_y <= 0:
        raise ValueError("scales must be positive")
    half_x, half_y = (b["x2"] - b["x1"]) * F.lit(scale_x) / 2, (b["y2"] - b["y1"]) * F.lit(scale_y) / 2
    center_x, center_y = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    zero = F.lit(0).cast("int")
    return F.struct(
        F.greatest(zero, (center_x - half_x).cast("int")).alias("x1"),
        F.greatest(zero, (center_y - half_y).cast("int")).alias("y1"),
        (center_x + half_x).cast("int").alias("x2"),
        (center_y + half_y).cast("int").alias("y2"),
    )


def from_polygon(points: Column) -> Column:
    """The box around an array of struct<x,y>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def from_corner(left: Column, top: Column, width: Column, height: Column) -> Column:
    return box(left, top, left + width, top + height)


def flip_y(b: Column, height: Column) -> Column:
    """From an origin at the lower left to one at the upper left."""
    return F.struct(b["x1"].alias("x1"), (height - b["y2"]).alias("y1"), b["x2"].alias("x2"), (height - b["y1"]).alias("y2"))


def boxes_of_lines(text: Column, height: Column) -> Column:
    """array<struct<symbol, box>> from lines 'symbol x1 y1 x2 y2 ...' with a lower-left origin; shorter lines are skipped."""
    rows = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.split(x, " ", -1)), lambda p: F.size(p) >= 5)

    def one(p: Column) -> Column:
        corner = [F.try_element_at(p, F.lit(i)).try_cast("int") for i in (2, 3, 4, 5)]
        return F.struct(F.try_element_at(p, F.lit(1)).alias("symbol"), flip_y(box(*corner), height).alias("box"))

    return F.transform(rows, one)


def crop_with_margin(b: Column, width: Column, height: Column, margin: int = 10) -> Column:
    zero = F.lit(0)
    return box(F.greatest(zero, b["x1"] - margin), F.greatest(zero, b["y1"] - margin), F.least(width, b["x2"] + margin), F.least(height, b["y2"] + margin))


def whole_image(width: Column, height: Column) -> Column:
    return box(F.lit(0), F.lit(0), width, height)


def ordered_corners(points: Column) -> Column:
    """struct<tl, tr, br, bl> of four struct<x,y>: by x, then the left and the right pair by y."""
    by_x = F.array_sort(points)
    low = lambda a, b: F.when(a["y"] <= b["y"], a).otherwise(b)
    high = lambda a, b: F.when(a["y"] <= b["y"], b).otherwise(a)
    a, b, c, d = (by_x[i] for i in range(4))
    return F.struct(low(a, b).alias("tl"), low(c, d).alias("tr"), high(c, d).alias("br"), high(a, b).alias("bl"))


def rectified_size(corners: Column) -> Column:
    """struct<width, height>: the longer of the opposite sides, cut toward zero."""
    side = lambda p, q: F.sqrt(F.pow(corners[p]["x"] - corners[q]["x"], 2) + F.pow(corners[p]["y"] - corners[q]["y"], 2))
    return F.struct(
        F.greatest(side("br", "bl").cast("int"), side("tr", "tl").cast("int")).alias("width"),
        F.greatest(side("tr", "br").cast("int"), side("tl", "bl").cast("int")).alias("height"),
    )


def rotated_canvas(width: Column, height: Column, degrees: Column) -> Column:
    """struct<width, height, shift_x, shift_y> of an image turned by an angle without being cut."""
    cos, sin = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    new_w, new_h = (height * sin + width * cos).cast("int"), (height * cos + width * sin).cast("int")
    return F.struct(new_w.alias("width"), new_h.alias("height"), (new_w / 2 - (width / 2).cast("int")).alias("shift_x"), (new_h / 2 - (height / 2).cast("int")).alias("shift_y"))


def fitted_size(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """struct<width, height> keeping the aspect ratio: of a target that is not given (null) the one that follows, inside both if both are given."""
    ratio = width / height
    wide = to_width / to_height > ratio
    follow_width, follow_height = (to_height * ratio).cast("int"), (to_width / ratio).cast("int")
    return F.struct(
        F.when(to_width.isNull() & to_height.isNull(), width).when(to_width.isNull() | F.coalesce(wide, F.lit(False)), follow_width).otherwise(to_width).cast("int").alias("width"),
        F.when(to_width.isNull() & to_height.isNull(), height).when(to_height.isNull() | F.coalesce(~wide, F.lit(False)), follow_height).otherwise(to_height).cast("int").alias("height"),
    )
