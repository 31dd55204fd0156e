"""Connected components of large link tables by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import stored


def _least_neighbour(rows: DataFrame, salts: int = 32) -> DataFrame:
    """``rows(u, v)`` with ``m``, the least v of each u; a hot u is spread over ``salts`` tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    part = salted.groupBy("u", "_salt").agg(F.min("v").alias("_m"))
    spread = part.select("u", "_salt").join(part.groupBy("u").agg(F.min("_m").alias("m")), "u")
    return salted.join(spread, ["u", "_salt"]).select("u", "v", "m")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links(a, b)`` reaches; nodes without links are absent.

    Every round replaces links by links to smaller nodes and keeps what hangs together; the links
    become stars around the least nodes in about the logarithm of the longest path, and the rounds end only
    when nothing changes. Each round's links are a stored table, never on the driver. Self-links and links
    with a null end join nothing; repeated links count once.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = _least_neighbour(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti").withColumn("component", F.col("node")))
