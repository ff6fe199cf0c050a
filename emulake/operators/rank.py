"""Exact seeded ranks and cuts without a single-task sort.

A rank by hash needs only counts per hash prefix plus an order inside each prefix. Selecting "the
first k rows in hash order" needs even less: one threshold hash. Cuts therefore never shuffle the
table; they cost counting scans of the key columns and end as literals in a plain projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulake.functions.hashing import seeded_hash
from emulake.session import bounded, join_on

FIRST, NEXT = 3, 4  # hex digits added per counting pass: at most 4096 cells, then 65,536 per cut, reach the driver
CELL_ROWS = 100_000  # rows one ranking task sorts
MAX_WIDTH = 6  # hex digits of the finest cell: 16.8 million cells
LEAF = 4096  # stop refining once the cell holding a cut has this few rows


def _with_cells(df: DataFrame, strata: Sequence[str], cell_rows: int) -> DataFrame:
    """Add ``__b``, a prefix of ``__h`` as long as the row's stratum needs for cells of about ``cell_rows`` rows.

    Small strata get one cell, a hot one up to 16^6; the number of cells stays near rows / cell_rows.
    """
    def width(n: Column) -> Column:
        return F.greatest(F.least(F.ceil(F.log(16.0, F.greatest(n / cell_rows, F.lit(1.0)))), F.lit(MAX_WIDTH)), F.lit(0))

    if not strata:
        n = df.count()
        return df.withColumn("__b", F.substring("__h", 1, max(1, min(MAX_WIDTH, math.ceil(math.log(max(n / cell_rows, 1), 16))))))
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n")).select(*strata, width(F.col("__n")).cast("int").alias("__w"))
    return join_on(df, bounded(sizes), strata, "inner").withColumn("__b", F.col("__h").substr(F.lit(1), F.col("__w"))).drop("__w")


def hash_rank(
    df: DataFrame, keys: Sequence[str], seed: int | Column = 42, strata: Sequence[str] = (), rank: str = "rank",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in hash order, per stratum.

    ``keys`` must be unique inside a stratum. Rows are spread over hash cells of about ``cell_rows`` rows,
    so one huge stratum still sorts in many tasks.
    """
    strata = list(strata)
    celled = _with_cells(df.withColumn("__h", seeded_hash(seed, *keys)), strata, cell_rows)
    return rank_in_cells(celled, F.col("__b"), strata, ["__h", *keys], rank).drop("__h", "__b")


def rank_in_cells(df: DataFrame, cell: Column, group: Sequence[str], order: Sequence[str], rank: str) -> DataFrame:
    """Position in each group, for cells that split a group into consecutive pieces of the order.

    Cells are counted map-side and their offsets joined back on the same (group, cell) key that partitions
    the window, so a large offset table costs no second shuffle of the rows; a small one is broadcast.
    """
    group = list(group)
    key = F.struct(*group, cell.alias("__cell"))  # a struct matches NULL group values too
    tagged = df.withColumn("__g", key)
    counts = tagged.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    fields = [F.col("__g")[c] for c in group]
    before = Window.partitionBy(*fields).orderBy(F.col("__g")["__cell"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__g").orderBy(*order)
    placed = tagged.join(bounded(offsets), "__g")
    return placed.withColumn(rank, F.col("__off") + F.row_number().over(inside)).drop("__g", "__off")


class HashCuts:
    """Thresholds for "first r rows in hash order"; ``n`` is the row count seen while fitting."""

    def __init__(self, keys: Sequence[str], seed: int, n: int, ranks: Sequence[int], hashes: Sequence[str | None], stored: str | None = None):
        self.keys, self.seed, self.n, self.stored = list(keys), seed, n, stored
        self.ranks, self.hashes = list(ranks), list(hashes)

    def at_most(self, i: int, h: Column) -> Column:
        """True for rows inside the first ``ranks[i]`` rows."""
        bound = self.hashes[i]
        return F.lit(False) if bound is None else h <= F.lit(bound)

    def hash(self) -> Column:
        return F.col(self.stored) if self.stored else seeded_hash(self.seed, *self.keys)

    def piece(self, h: Column) -> Column:
        """0-based piece number when the cuts divide the table into consecutive pieces."""
        number = F.lit(0)
        for i in range(len(self.ranks)):
            number = number + F.when(self.at_most(i, h), 0).otherwise(1)
        return number


def hash_cuts(df: DataFrame, keys: Sequence[str], seed: int, ranks_of, stored: str | None = None) -> HashCuts:
    """Find the hash at each wanted rank. ``ranks_of(n)`` gives the ranks once the row count is known.

    ``stored`` names a column of ``df`` that has the rows' seeded hash already, which spares every scan making the keys and hashing them.

    Each pass counts rows per hash prefix (a map-side aggregate with a fixed number of groups) and only
    the cells holding a cut are looked at again, so 10^12 rows need three scans of the key columns.
    """
    hashed = df.select((F.col(stored) if stored else seeded_hash(seed, *keys)).alias("h"))

    def count_cells(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
        got = rows.groupBy(F.substring("h", 1, width).alias("p")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        p, n = np.array(got["p"].to_pylist(), dtype=object), got["n"].to_numpy()
        order = np.argsort(p)
        return p[order], n[order]

    prefixes, counts = count_cells(hashed, FIRST)
    n = int(counts.sum())
    ranks = [int(r) for r in ranks_of(n)]
    found: dict[int, str | None] = {r: None for r in ranks if r <= 0}
    found.update({r: "g" for r in ranks if r >= n and r > 0})  # "g" sorts after every hex digit
    todo: dict[int, tuple[str, int, int]] = {}

    def locate(wanted: list[tuple[int, int]]) -> None:
        ends = np.cumsum(counts)
        for r, local in wanted:
            i = int(np.searchsorted(ends, local))
            todo[r] = (prefixes[i], int(local - (ends[i] - counts[i])), int(counts[i]))

    locate([(r, r) for r in set(ranks) if r not in found])
    width = FIRST
    while todo and width < 32 and max(size for _, _, size in todo.values()) > LEAF:
        cells = {p for p, _, _ in todo.values()}
        all_p, all_n = count_cells(hashed.where(F.substring("h", 1, width).isin(*cells)), min(32, width + NEXT))
        pending, todo_old = dict(todo), width
        for r, (cell, local, _) in pending.items():
            keep = np.array([p[:todo_old] == cell for p in all_p], dtype=bool)
            prefixes, counts = all_p[keep], all_n[keep]
            locate([(r, local)])
        width = min(32, width + NEXT)
    if todo:  # copies of one key share a hash, so they arrive as one counted row
        cells = {p for p, _, _ in todo.values()}
        all_p, all_n = count_cells(hashed.where(F.substring("h", 1, width).isin(*cells)), 32)
        for r, (cell, local, _) in todo.items():
            keep = np.array([p[:width] == cell for p in all_p], dtype=bool)
            found[r] = all_p[keep][int(np.searchsorted(np.cumsum(all_n[keep]), local))]
    return HashCuts(keys, seed, n, ranks, [found[r] for r in ranks], stored)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows beyond the first of each key; zero means every rank and split is exact."""
    copies = df.select(seeded_hash(0, *keys).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return copies.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).first()[0]


def sample_exact(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows if there are no more), same rows on every run."""
    cuts = hash_cuts(df, keys, seed, lambda total: [min(n, total)])
    return df.where(cuts.at_most(0, cuts.hash()))


def stratum_cuts(
    df: DataFrame, keys: Sequence[str], strata: Sequence[str], seed: int | Column, targets: dict[str, Column],
    cell_rows: int = LEAF,
) -> DataFrame:
    """One row per stratum with the threshold hash of each target rank (an expression over ``n``).

    A target of zero rows gives NULL. The data itself is never shuffled: cells are counted map-side,
    and only rows in the cell that holds a cut are ordered.
    """
    strata = list(strata)
    hashed = _with_cells(df.select(*strata, seeded_hash(seed, *keys).alias("__h")), strata, cell_rows)
    cells = hashed.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*strata)
    cum = cells.withColumn("__end", F.sum("__n").over(upto)).withColumn("n", F.sum("__n").over(whole))
    wanted = cum.select(
        "*", F.explode(F.array(*[F.struct(F.lit(name).alias("cut"), e.cast("bigint").alias("r")) for name, e in targets.items()]))
        .alias("t")
    ).where((F.col("t.r") <= F.col("__end")) & (F.col("t.r") > F.col("__end") - F.col("__n")))
    wanted = wanted.select(
        *strata, "__b", F.col("t.cut").alias("__cut"), (F.col("t.r") - F.col("__end") + F.col("__n")).alias("__r")
    )
    near = join_on(hashed, bounded(wanted), strata + ["__b"], "inner")
    order = Window.partitionBy(*strata, "__b", "__cut").orderBy("__h")
    hits = near.withColumn("__i", F.row_number().over(order)).where("__i = __r")
    picked = [F.max(F.when(F.col("__cut") == name, F.col("__h"))).alias(name) for name in targets]
    return hits.groupBy(*strata).agg(*picked)
