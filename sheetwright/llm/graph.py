"""Connected components of links between rows, by alternating large and small stars.

Each step is two groupings and two joins; its result is written, so lineage
stays short and nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.session import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours, those above it (large) or below it (small), are linked to its smallest neighbour."""
    sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = sides.join(least, "u").where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = met if large else met.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node but the roots: ``root`` is the smallest node of its component.

    ``links`` has two long columns ``u`` and ``v``, in any order and with
    repeats. Ends when a round changes nothing.
    """
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        now = written(_star(_star(now, True), False), "links")
