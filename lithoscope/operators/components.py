"""Connected components over an edge table, by alternating star contractions.

Each round joins nodes to the smallest node that they see (large star over all
neighbours, small star over smaller ones) until nothing changes; the number of
rounds grows with the logarithm of the largest component. Rounds are written to
the shared folder. Hubs are no problem: a round only needs each node's minimum and
sends every edge on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lithoscope.session import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, u: str, v: str, max_rounds: int = 50) -> DataFrame:
    """`node, component` of every node that has an edge; a component is named by its smallest node.

    Self edges and nulls are left out; repeated edges count once.
    """
    now = materialise(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u != v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = materialise(_small_star(_large_star(now)), "edges")
        s = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(s) == mark:
            break
        mark = tuple(s)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
