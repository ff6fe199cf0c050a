"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import store


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the smallest node among it and its neighbours."""
    near = _both_ways(links)
    low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b of type long), root being the least node of its component.

    A round is two aggregates and two joins on the links; the number of rounds grows with the logarithm of the
    component's size. Each round's links are written to the shared folder, and only their count and checksum reach
    the driver. Self-links and NULL ends are ignored; repeated links count once.
    """
    now = store(links.where("a <> b").select("a", "b").distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        now = store(_small_star(_large_star(now)), "links")
        then, seen = seen, mark(now)
        if then == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
