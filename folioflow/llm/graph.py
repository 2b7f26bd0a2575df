"""Connected components over a table of links, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): root is the smallest node reachable. Only nodes that have a link appear.

    Alternates large-star and small-star steps until the links are stars. The minimum over a node's
    neighbours is aggregated before the shuffle; the join that brings it back is a plain equi-join,
    so adaptive execution can split the node of a hot star. Each round is cut by a written table.
    """
    edges = stored(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        # large star: every larger neighbour moves to the least node around
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "edges")
        dropped(least)
        # small star: every smaller neighbour and the node itself move to the least smaller neighbour
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "least")
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct(), "edges")
        for table in (edges, large, low):
            dropped(table)
        edges = new
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(20,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    ends = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(ends)
