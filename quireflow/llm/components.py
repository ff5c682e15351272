"""Connected components of a graph of integer nodes, by alternating large-star and small-star steps (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014). Every step is an aggregation with map-side combining and an
equi-join whose hot partitions adaptive execution can split; nothing is gathered or broadcast but whether it is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quireflow.llm.common import cut, drop_table


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): u's neighbours. Links the larger (large) or all (small: they are smaller) neighbours of u to the
    least node around u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = pairs.join(least.hint("merge"), "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _unfinished(pairs: DataFrame) -> bool:
    """Whether pairs (u > v) are anything but stars. They are stars if every u has one v, which is no u itself: then v
    is the least node of its component, as steps neither join nor part components."""
    ends = pairs.groupBy("u").agg(F.count("*").alias("n"))
    if ends.where("n > 1").limit(1).count():
        return True
    return bool(pairs.select("v").distinct().join(ends.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").limit(1).count())


def components(edges: DataFrame, a: str, b: str, most: int = 50) -> DataFrame:
    """(node, component) for every node of an edge: component is the least node that can be reached. Loops and
    repeated edges are harmless, null ends are ignored, no edges give no rows. Fails if `most` rounds don't suffice,
    which would take a path of about 2**most nodes."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _star(both, True)
        small = _star(big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        after = cut(small, "stars")
        drop_table(now)
        now = after
        if not _unfinished(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components: no fixpoint after {most} rounds")
