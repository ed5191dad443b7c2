"""Connected components of an edge table by alternating large-star and small-star steps.

Every step replaces edges by edges to a smaller node, so components never mix and no step makes
more edges than it reads; a logarithmic number of rounds leaves one star per component, centred
on its smallest node. Minima are combined before the shuffle, and what follows them is a plain
join that Spark splits for a node that holds a large part of the edges: no neighbourhood is ever
gathered. Each round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
    joined = both.where("b > a").join(least, F.col("a") == F.col("of"))
    return joined.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
    joined = down.join(least, F.col("a") == F.col("of"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b): component is the smallest node
    reachable. Loops, null ends, repeated edges and either direction are fine; a node that only
    has a loop, and an empty table, give no rows."""
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        # Order-free fingerprint of the edge set: it stops changing when all are stars.
        said = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if said == seen or said[0] == 0:
            break
        seen = said
        now = stored(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("node", "component"))
