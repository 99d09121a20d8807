"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import written


def _minima(pairs: DataFrame) -> DataFrame:
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "minima")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: each node with the smallest node it reaches.

    Any orderable key type. Loops, repeated edges and edges with a null end are
    ignored; a node without an edge to another node has no row. Rounds of large
    and small stars (O(log n) of them in practice) hang every node under the
    smallest neighbour. Minima are aggregated before the shuffle and written,
    so that a hot star centre meets a join that AQE can split.
    """
    pairs = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % F.lit(1 << 31))).first()
        if mark == seen or mark[0] == 0:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                pairs.select("lo", "lo").distinct()
            )
        seen = mark
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        large = _minima(both)
        # large star: every larger neighbour of u hangs under the smallest of u and its neighbours
        pairs = written(
            both.filter("v > u").join(large, "u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo")).distinct(),
            "large",
        )
        # small star: u and its smaller neighbours hang under the smallest of them
        down = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        joined = down.join(_minima(down), "u")
        pairs = written(
            joined.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .union(joined.select("u", "m"))
            .filter("hi <> lo")
            .distinct(),
            "small",
        )
