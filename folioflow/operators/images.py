"""Pixel operators.

The simple ones are expressions over an array of pixels. The others are NumPy kernels over one image,
run in Arrow batches by `apply_steps`: a step that fails is skipped and named, the image goes on.
Borders mirror without repeating the edge; sums are rounded half to even and cut to 0..255.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- expressions over array<double> pixels -------------------------------------------------------


def saturated(value: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(value, 0)))


def gray(blue: Column, green: Column, red: Column) -> Column:
    return saturated(0.114 * blue + 0.587 * green + 0.299 * red)


def contrast(pixels: Column, alpha: float = 1.5, beta: float = 0.0) -> Column:
    return F.transform(pixels, lambda p: saturated(F.abs(p * alpha + beta)))


def threshold(pixels: Column, limit: float = 127.0, high: float = 255.0) -> Column:
    return F.transform(pixels, lambda p: F.when(p > limit, high).otherwise(0.0))


def min_max(pixels: Column) -> Column:
    """Stretched to 0..255 and cut to whole numbers; a flat image becomes 0."""
    low, high = F.array_min(pixels), F.array_max(pixels)
    return F.transform(pixels, lambda p: F.when(high > low, F.floor((p - low) * 255.0 / F.nullif(high - low, F.lit(0.0))).cast("double")).otherwise(0.0))


def upscale_nearest(pixels: Column, width: int, height: int, scale: int) -> Column:
    """Every pixel becomes a square of scale x scale."""
    wide = width * scale
    return F.transform(F.sequence(F.lit(0), F.lit(wide * height * scale - 1)), lambda i: F.get(pixels, (F.floor(i / wide / scale) * width + F.floor(i % wide / scale)).cast("int")))


def optimal_scale(height: Column, width: Column, least: int = 300) -> Column:
    small = F.least(height, width)
    return F.when(small >= least, 1).otherwise(F.least(F.ceil(F.lit(least) / small), F.lit(4))).cast("int")


def region_scale(height: Column, width: Column, target: int = 1100) -> Column:
    """Upscaling before recognition: only where a side is below the target, at most four times."""
    scale = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.lit(target) / F.greatest(height, width)).cast("int")))
    return F.when((height < target) | (width < target), scale).otherwise(1)


def edge_density(edges: Column) -> Column:
    """Share of pixels above 0; over 0.1 an image counts as text."""
    return F.size(F.filter(edges, lambda p: p > 0)) / F.size(edges)


# --- kernels over one image, height x width (x channels), uint8 ----------------------------------


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def to_gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else _bytes(image[..., :3] @ np.array([0.114, 0.587, 0.299]))


def to_rgb(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., ::-1]


def _padded(image: np.ndarray, r: int, mode: str = "reflect") -> np.ndarray:
    mode = mode if min(image.shape[:2]) > r else "edge"
    return np.pad(image.astype(np.float32), [(r, r), (r, r)] + [(0, 0)] * (image.ndim - 2), mode=mode)


def _shifts(image: np.ndarray, size: int, mode: str = "reflect") -> Iterator[np.ndarray]:
    """size x size views of one padded copy, shifted, row by row: whatever sums over them holds one image at a time."""
    wide, (h, w) = _padded(image, size // 2, mode), image.shape[:2]
    for i in range(size):
        for j in range(size):
            yield wide[i : i + h, j : j + w]


def _weighted(image: np.ndarray, weights: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    total = np.zeros(image.shape)
    for weight, near in zip(weights, _shifts(image, size, mode), strict=True):
        if weight:
            total += weight * near
    return total


def gaussian_weights(size: int, sigma: float = 0.0) -> np.ndarray:
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    one = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma**2))
    return np.outer(one, one).ravel() / one.sum() ** 2


def _blurred(image: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    return _weighted(image, gaussian_weights(size, sigma), size)


def denoise(image: np.ndarray, method: str = "gaussian") -> np.ndarray:
    """gaussian 5x5, median 5 or bilateral (9, 75, 75); an unknown method is gaussian."""
    if method == "median":
        h = max(1, (1 << 20) // max(1, image[0].size))  # in strips, so that the 25 copies stay small
        wide = np.pad(image, [(2, 2), (2, 2)] + [(0, 0)] * (image.ndim - 2), mode="edge")
        strips = [wide[y : min(y + h, image.shape[0]) + 4] for y in range(0, image.shape[0], h)]
        middle = lambda x: np.partition(np.stack([x[i : len(x) - 4 + i, j : j + image.shape[1]] for i in range(5) for j in range(5)]), 12, axis=0)[12]
        return np.concatenate([middle(x) for x in strips])
    if method == "bilateral":
        return bilateral(image, 9, 75, 75)
    return _bytes(_blurred(image, 5))


def bilateral(image: np.ndarray, size: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    own = image.astype(np.float32)
    total, weights = np.zeros_like(own), np.zeros(own.shape[:2] + (1,) * (own.ndim - 2), np.float32)
    for at, near in enumerate(_shifts(image, size)):
        distance = (at // size - size // 2) ** 2 + (at % size - size // 2) ** 2
        if distance <= (size // 2) ** 2:
            far = np.abs(near - own)
            far = far.sum(axis=-1, keepdims=True) if image.ndim == 3 else far
            weight = np.exp(-(far**2) / np.float32(2 * sigma_color**2) - np.float32(distance / (2 * sigma_space**2)))
            total += weight * near
            weights += weight
    return _bytes(total / weights)


def non_local_means(image: np.ndarray, strength: float = 10, patch: int = 7, window: int = 21) -> np.ndarray:
    """Each pixel as the mean of those around it, weighted by how alike the patches are; one shift of the window at a time."""
    r, p = window // 2, patch // 2
    wide, (h, w) = _padded(image, r + p), image.shape[:2]
    own = wide[r : r + h + 2 * p, r : r + w + 2 * p]
    total, weights = np.zeros(image.shape), np.zeros((h, w) + (1,) * (image.ndim - 2))
    for i in range(window):
        for j in range(window):
            other = wide[i : i + h + 2 * p, j : j + w + 2 * p]
            far = ((other - own) ** 2).astype(float)
            far = far.mean(axis=-1) if image.ndim == 3 else far
            sums = np.pad(far.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
            mean = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / patch**2
            weight = np.exp(-np.maximum(mean, 0) / strength**2).reshape(weights.shape)
            total += weight * other[p : p + h, p : p + w]
            weights += weight
    return _bytes(total / weights)


def enhance(image: np.ndarray) -> np.ndarray:
    """Gray, black and white by neighbourhoods, and freed from noise."""
    return non_local_means(adaptive(image, 11, 2), 10, 7, 21)


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """What lies in a box, cut at the image's edges; a box without an area there gives an empty image."""
    h, w = image.shape[:2]
    y1, x1 = min(max(0, int(y1)), h), min(max(0, int(x1)), w)
    return image[y1 : max(y1, min(int(y2), h)), x1 : max(x1, min(int(x2), w))]


def region_ready(image: np.ndarray, side: int = 1100, most: int = 4) -> np.ndarray:
    """A region for a recogniser: small ones are made larger by whole numbers."""
    h, w = image.shape[:2]
    if not image.size or h >= side and w >= side:
        return image
    return upscale(image, max(1, min(side // max(h, w), most)), "nearest")


def draw_box(image: np.ndarray, x1: int, y1: int, x2: int, y2: int, color: tuple[int, int, int] = (0, 255, 0), thickness: int = 2, label_size: tuple[int, int] | None = None) -> np.ndarray:
    """A copy with the box's outline, and the filled bar for a label of that width and height above it; glyphs are left to the caller."""
    out = np.array(image if image.ndim == 3 else to_rgb(image))
    paint = lambda a, b, c, d: crop(out, a, b, c, d).__setitem__(Ellipsis, color)
    lo, hi = thickness // 2, thickness - thickness // 2
    for a, b, c, d in ((x1, y1, x2, y1), (x1, y2, x2, y2), (x1, y1, x1, y2), (x2, y1, x2, y2)):
        paint(a - lo, b - lo, c + hi, d + hi)
    if label_size:
        paint(x1, y1 - label_size[1] - 10, x1 + label_size[0] + 1, y1 + 1)
    return out


def binarize(image: np.ndarray, limit: float = 127, high: int = 255, inverted: bool = False) -> np.ndarray:
    over = to_gray(image) > limit
    return np.where(over != inverted, high, 0).astype(np.uint8)


def adaptive(image: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    """White where a pixel is over its Gaussian neighbourhood less c."""
    one = to_gray(image)
    mean = _bytes(_weighted(one, gaussian_weights(block), block, "edge")).astype(int)
    return np.where(one.astype(int) > mean - int(np.ceil(c)), 255, 0).astype(np.uint8)


def otsu(image: np.ndarray, inverted: bool = False) -> np.ndarray:
    """Threshold by the largest variance between classes of the histogram."""
    one = to_gray(image)
    share = np.bincount(one.ravel(), minlength=256) / one.size
    below, mean = np.cumsum(share), np.cumsum(share * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below - mean) ** 2 / (below * (1 - below))
    return binarize(one, int(np.argmax(np.nan_to_num(between))), 255, inverted)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By area: each target pixel is the mean of what it covers."""

    def cover(old: int, new: int) -> np.ndarray:
        lo, hi = np.arange(new)[:, None] * old / new, (np.arange(new)[:, None] + 1) * old / new
        part = np.clip(np.minimum(hi, np.arange(old) + 1) - np.maximum(lo, np.arange(old)), 0, None)
        return part / part.sum(axis=1, keepdims=True)

    return _bytes(np.einsum("ih,hw...,jw->ij...", cover(image.shape[0], height), image.astype(float), cover(image.shape[1], width)))


def normalize(image: np.ndarray) -> np.ndarray:
    if image.dtype == np.uint8:
        return image
    low, high = image.min(), image.max()
    return np.zeros(image.shape, np.uint8) if low == high else ((image - low) * 255.0 / (high - low)).astype(np.uint8)


def morphology(image: np.ndarray, operation: str = "close", size: int = 3, rounds: int = 1) -> np.ndarray:

    def grow(x: np.ndarray, f: Callable, fill: int) -> np.ndarray:
        wide, out = np.pad(x, [(size // 2, size - 1 - size // 2)] * 2 + [(0, 0)] * (x.ndim - 2), constant_values=fill), None
        for i in range(size):
            for j in range(size):
                part = wide[i : i + x.shape[0], j : j + x.shape[1]]
                out = part.copy() if out is None else f(out, part)
        return out

    dilate, erode = (lambda x: grow(x, np.maximum, 0)), (lambda x: grow(x, np.minimum, 255))
    order = {"dilate": [dilate], "erode": [erode], "open": [erode, dilate], "close": [dilate, erode]}[operation]
    for f in order:
        for _ in range(rounds):
            image = f(image)
    return image


def remove_shadow(image: np.ndarray) -> np.ndarray:
    """Divided by its background: an opening and a dilation by a disc of 20."""
    one = to_gray(image).astype(float)
    i, j = np.mgrid[:20, :20]
    disc = np.argwhere(((i - 9.5) / 10) ** 2 + ((j - 9.5) / 10) ** 2 <= 1)

    def by_disc(x: np.ndarray, f: Callable, fill: float) -> np.ndarray:
        wide, out = np.pad(x, 10, constant_values=fill), None
        for a, b in disc:
            part = wide[a : a + x.shape[0], b : b + x.shape[1]]
            out = part.copy() if out is None else f(out, part)
        return out

    background = by_disc(by_disc(by_disc(one, np.minimum, 255), np.maximum, 0), np.maximum, 0)
    return _bytes(np.where(background > 0, one * 255 / np.maximum(background, 1), 0))


def sharpen(image: np.ndarray, method: str = "unsharp") -> np.ndarray:
    """unsharp (sigma 2: 1.5 - 0.5 blurred) or laplacian 3x3; unknown: as it is."""
    if method == "unsharp":
        return _bytes(1.5 * image.astype(float) - 0.5 * _blurred(image, 13, 2.0))
    if method == "laplacian":
        return _bytes(_weighted(image, np.array([0, -1, 0, -1, 5, -1, 0, -1, 0], float), 3))
    return image


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float = 0.0) -> np.ndarray:
    """Bilinear values at places; outside the image a constant."""
    h, w = image.shape[:2]
    wide = np.pad(image.astype(float), [(1, 1), (1, 1)] + [(0, 0)] * (image.ndim - 2), constant_values=outside)
    y, x = np.clip(y, -1, h) + 1, np.clip(x, -1, w) + 1
    i, j = np.minimum(y.astype(int), h), np.minimum(x.astype(int), w)
    a, b = y - i, x - j
    if image.ndim == 3:
        a, b = a[..., None], b[..., None]
    return (1 - a) * (1 - b) * wide[i, j] + a * (1 - b) * wide[i + 1, j] + (1 - a) * b * wide[i, j + 1] + a * b * wide[i + 1, j + 1]


def _labels(mask: np.ndarray) -> np.ndarray:
    """Of each set pixel the number of the group of set pixels that touch each other, corners too; -1 elsewhere."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), -1)
    while True:
        wide, new = np.pad(label, 1, constant_values=-1), label
        for i in range(3):
            for j in range(3):
                new = np.maximum(new, wide[i : i + mask.shape[0], j : j + mask.shape[1]])
        new = np.where(mask, new, -1)
        flat = new.ravel()
        while (jump := np.where(flat >= 0, flat[np.maximum(flat, 0)], -1)).tobytes() != flat.tobytes():
            flat = jump
        if (flat == label.ravel()).all():
            return label
        label = flat.reshape(mask.shape)


def _hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points (x, y), in order."""
    points = sorted(set(map(tuple, points.tolist())))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def half(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]) if len(points) > 2 else points, float)


def _simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed line with the points that lie further than the tolerance from what the others give."""

    def keep(a: int, b: int) -> list[int]:
        if b - a < 2:
            return []
        p, q = line[a], line[b % len(line)]
        inner, side = line[a + 1 : b] - p, q - p
        length = np.hypot(*side)
        far = np.abs(side[0] * inner[:, 1] - side[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        at = a + 1 + int(np.argmax(far))
        return [*keep(a, at), at, *keep(at, b)] if far.max() > tolerance else []

    first = int(np.argmax(np.hypot(*(line - line[0]).T)))
    start = int(np.argmax(np.hypot(*(line - line[first]).T)))
    line = np.roll(line, -start, axis=0)
    other = (first - start) % len(line)
    return line[sorted({0, *keep(0, other), other, *keep(other, len(line))})] if other else line[:1]


def document_corners(image: np.ndarray) -> np.ndarray | None:
    """The four corners of the outline that holds the largest area among the image's edges; none if it is no quadrilateral."""
    label = _labels(edges(image) > 0)
    best, area = None, 0.0
    y, x = np.nonzero(label >= 0)
    order = np.argsort(label[y, x], kind="stable")
    y, x = y[order], x[order]
    for group in np.split(np.stack([x, y], axis=1), np.flatnonzero(np.diff(label[y, x])) + 1) if len(y) else ():
        hull = _hull(group)
        if len(hull) > 2:
            own = abs(np.sum(hull[:, 0] * np.roll(hull[:, 1], -1) - hull[:, 1] * np.roll(hull[:, 0], -1))) / 2
            if own > area:
                best, area = hull, own
    if best is None:
        return None
    around = np.hypot(*(best - np.roll(best, -1, axis=0)).T).sum()
    corners = _simplified(best, 0.02 * around)
    return corners if len(corners) == 4 else None


def rectify(image: np.ndarray, corners: np.ndarray | None = None) -> np.ndarray:
    """The quadrilateral of four corners (x, y) as a rectangle; without corners those of the document; other numbers of corners: as it is."""
    corners = document_corners(image) if corners is None else corners
    if corners is None:
        return image
    corners = np.asarray(corners, float)
    if corners.shape != (4, 2):
        return image
    by_x = corners[np.lexsort((corners[:, 1], corners[:, 0]))]
    (tl, bl), (tr, br) = by_x[:2][np.argsort(by_x[:2, 1])], by_x[2:][np.argsort(by_x[2:, 1])]
    width, height = int(max(np.hypot(*(br - bl)), np.hypot(*(tr - tl)))), int(max(np.hypot(*(tr - br)), np.hypot(*(tl - bl))))
    target = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    rows, right = [], []
    for (u, v), (x, y) in zip(target, (tl, tr, br, bl), strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    v, u = np.mgrid[:height, :width]
    x, y, z = np.tensordot(m, np.stack([u, v, np.ones_like(u)]).astype(float), 1)
    return _bytes(sample(image, y / z, x / z))


def rotate(image: np.ndarray, degrees: float, keep_size: bool = False) -> np.ndarray:
    """Turned counterclockwise; the canvas grows unless keep_size."""
    h, w = image.shape[:2]
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    new_w, new_h = (w, h) if keep_size else (int(h * abs(sin) + w * abs(cos)), int(h * abs(cos) + w * abs(sin)))
    y, x = np.mgrid[:new_h, :new_w].astype(float)
    x, y = x - (w // 2 if keep_size else new_w / 2), y - (h // 2 if keep_size else new_h / 2)
    return _bytes(sample(image, sin * x + cos * y + h // 2, cos * x - sin * y + w // 2))


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Gradient edges: thinned along the gradient, weak ones kept where they touch strong ones."""
    one = to_gray(image)
    gx, gy = (_weighted(one, np.array(k, float), 3, "edge") for k in ([-1, 0, 1, -2, 0, 2, -1, 0, 1], [-1, -2, -1, 0, 0, 0, 1, 2, 1]))
    size = np.abs(gx) + np.abs(gy)
    wide, (h, w) = np.pad(size, 1), size.shape
    at = lambda i, j: wide[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    flat, steep = np.abs(gy) <= 0.4142 * np.abs(gx), np.abs(gy) >= 2.4142 * np.abs(gx)
    same = gx * gy > 0
    before = np.select([flat, steep, same], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, same], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    thin = (size > before) & (size >= after) & (size > low)
    strong = thin & (size > high)
    while True:
        grown = thin & (morphology(strong.astype(np.uint8), "dilate") > 0)
        if (grown == strong).all():
            return np.where(strong, 255, 0).astype(np.uint8)
        strong = grown


def deskew(image: np.ndarray) -> np.ndarray:
    """Turned by the median angle of the strong straight lines, if that is over half a degree."""
    y, x = np.nonzero(edges(image))
    if not len(y):
        return image
    angles = np.arange(180)
    radius = np.rint(np.outer(x, np.cos(np.radians(angles))) + np.outer(y, np.sin(np.radians(angles)))).astype(int)
    found = [a for a in angles if np.bincount(radius[:, a] - radius[:, a].min()).max() > 100]
    if not found:
        return image
    turn = float(np.median(np.array(found) - 90))
    return rotate(image, turn, keep_size=True) if abs(turn) > 0.5 else image


def upscale(image: np.ndarray, scale: int, method: str = "bicubic") -> np.ndarray:
    """nearest, bilinear, bicubic (a = -0.75) or lanczos (radius 4)."""
    if method == "nearest":
        return image.repeat(scale, axis=0).repeat(scale, axis=1)
    radius = {"bilinear": 1, "bicubic": 2, "lanczos": 4}[method]

    def weight(d: np.ndarray) -> np.ndarray:
        d = np.abs(d)
        if method == "bilinear":
            return np.clip(1 - d, 0, None)
        if method == "lanczos":
            return np.where(d < 4, np.sinc(d) * np.sinc(d / 4), 0)
        a = -0.75
        return np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))

    def spread(n: int) -> np.ndarray:
        at = (np.arange(n * scale) + 0.5) / scale - 0.5
        out = np.zeros((n * scale, n))
        for k in range(-radius + 1, radius + 1):
            near = np.floor(at).astype(int) + k
            np.add.at(out, (np.arange(n * scale), np.clip(near, 0, n - 1)), weight(at - near))
        return out / out.sum(axis=1, keepdims=True)

    return _bytes(np.einsum("ih,hw...,jw->ij...", spread(image.shape[0]), image.astype(float), spread(image.shape[1])))


def edge_preserving(image: np.ndarray, scale: int) -> np.ndarray:
    return bilateral(upscale(image, scale, "bicubic"), 9, 102, 50)


def adaptive_upscale(image: np.ndarray, scale: int, method: str = "auto") -> np.ndarray:
    if method == "auto":
        method = "text" if (edges(image) > 0).mean() > 0.1 else "photo"
    return edge_preserving(image, scale) if method == "text" else upscale(image, scale, "lanczos" if method == "mixed" else "bicubic")


def upscale_with_fallback(image: np.ndarray, scale: int) -> np.ndarray:
    """The first method that gives an image; the image itself if none does."""
    for f in (edge_preserving, *(lambda x, s, m=m: upscale(x, s, m) for m in ("bicubic", "bilinear", "nearest"))):
        try:
            out = f(image, scale)
            if out.size:
                return out
        except (ValueError, IndexError, ZeroDivisionError):
            continue
    return image


def smart_upscale(image: np.ndarray, least: int = 1000) -> np.ndarray:
    small = min(image.shape[:2])
    if small >= least:
        return image
    scale = min(4, -(-least // small))
    try:
        return adaptive_upscale(image, scale)
    except (ValueError, IndexError, ZeroDivisionError):
        return upscale_with_fallback(image, scale)


def equalize_tiles(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles with clipped histograms, mixed between tile centres."""
    one = to_gray(image)
    h, w = one.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(one, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if th * tiles - h < h and tw * tiles - w < w else "edge")
    tables = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            top = max(1, int(clip * th * tw / 256))
            over = np.clip(hist - top, 0, None).sum()
            tables[i, j] = np.cumsum(np.minimum(hist, top) + over / 256) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    a, b = (y - i)[:, None], (x - j)[None, :]
    at = lambda i, j: tables[np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None, :], one]
    return _bytes((1 - a) * ((1 - b) * at(i, j) + b * at(i, j + 1)) + a * ((1 - b) * at(i + 1, j) + b * at(i + 1, j + 1)))


def national_id(image: np.ndarray, limit: int = 90) -> np.ndarray:
    return to_rgb(otsu(binarize(image, limit, inverted=True), inverted=True))


def tax_card(image: np.ndarray) -> np.ndarray:
    return national_id(image, 155)


def passport(image: np.ndarray, side: int = 256) -> np.ndarray:
    """float32 of shape (1, side, side, 3) in 0..1, nearest neighbours."""
    h, w = image.shape[:2]
    small = image[np.arange(side) * h // side][:, np.arange(side) * w // side]
    return (to_rgb(small) if small.ndim == 2 else small[..., :3]).astype(np.float32)[None] / 255


def zone(image: np.ndarray) -> np.ndarray:
    return to_rgb(adaptive(equalize_tiles(bilateral(to_gray(image), 11, 17, 17)), 13, 7))


def basic(image: np.ndarray) -> np.ndarray:
    return adaptive(_bytes(_blurred(to_gray(image), 5)), 11, 2)


STEPS: dict[str, Callable[..., np.ndarray]] = {
    "grayscale_conversion": to_gray,
    "noise_reduction": denoise,
    "contrast_enhancement": lambda image, alpha=1.5, beta=0.0: _bytes(np.abs(image.astype(float) * alpha + beta)),
    "brightness_adjustment": lambda image, **_: image,
    "deskewing": deskew,
    "binarization": binarize,
    "adaptive_binarization": adaptive,
    "morphological_operations": morphology,
    "resize_normalization": lambda image, width=None, height=None: normalize(resize(image, width, height)) if width and height else image,
    "shadow_removal": remove_shadow,
    "perspective_correction": rectify,
    "sharpening": sharpen,
    "nid": national_id,
    "tax": tax_card,
    "mrz": zone,
    "basic": basic,
    "enhance": enhance,
    "region": region_ready,
}
#: Step lists by name. Fixed values.
PIPELINES = {
    "general": [("grayscale_conversion", {}), ("noise_reduction", {"method": "gaussian"}), ("contrast_enhancement", {})],
    "id_card": [("grayscale_conversion", {}), ("noise_reduction", {"method": "bilateral"}), ("contrast_enhancement", {}), ("deskewing", {})],
    "passport": [("grayscale_conversion", {}), ("shadow_removal", {}), ("noise_reduction", {"method": "gaussian"}), ("contrast_enhancement", {})],
    "receipt": [("grayscale_conversion", {}), ("deskewing", {}), ("noise_reduction", {"method": "median"}), ("contrast_enhancement", {})],
}


def run_steps(image: np.ndarray, steps: list[tuple[str, dict]]) -> tuple[np.ndarray, list[str]]:
    """The image after the steps, and the names of steps that failed and were skipped."""
    skipped = []
    for name, options in steps:
        try:
            image = STEPS[name](image, **options)
        except (KeyError, TypeError, ValueError, IndexError, ZeroDivisionError, np.linalg.LinAlgError):
            skipped.append(name)
    return image, skipped


def apply_steps(images: DataFrame, steps: list[tuple[str, dict]], batch_images: int = 16) -> DataFrame:
    """images (doc_id, height, width, channels, data: binary) -> the same after the steps, and skipped: array<string>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_images):
                part = batch.slice(at, batch_images)
                rows = []
                for h, w, c, data in zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    image = np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c))
                    out, skipped = run_steps(image, steps)
                    rows.append((out.shape[0], out.shape[1], 1 if out.ndim == 2 else out.shape[2], np.ascontiguousarray(out).tobytes(), skipped))
                types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", "height", "width", "channels", "data", "skipped"])

    picked = images.select("doc_id", "height", "width", "channels", "data")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, height int, width int, channels int, data binary, skipped array<string>")


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of boxes (doc_id, ord, x1, y1, x2, y2) with the pixels of each region, made ready: height, width, channels, data.

    An image is sent to its document's boxes once, as one group of bounded size; a box without an area has no row.
    """
    packed = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2"))).alias("boxes"))
    joined = images.select("doc_id", "height", "width", "channels", "data").join(packed, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (h, w, c, data, own) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)):
                image = np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c))
                rows = [(b, region_ready(crop(image, b["x1"], b["y1"], b["x2"], b["y2"]))) for b in own]
                rows = [(b["ord"], x.shape[0], x.shape[1], c, np.ascontiguousarray(x).tobytes()) for b, x in rows if x.size]
                if rows:
                    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(rows))), *columns], names=["doc_id", "ord", "height", "width", "channels", "data"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, ord int, height int, width int, channels int, data binary")
