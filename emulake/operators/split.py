"""Exact, seeded train/validation/test splits, folds, batches and chunks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.functions.hashing import seeded_hash
from emulake.operators.rank import HashCuts, hash_cuts, hash_rank, stratum_cuts
from emulake.session import bounded, join_on

MAX_FRACTION = 0.9  # fixed value: fractions are clamped to this


def split_sizes(n: int, test: float = 0.2, val: float = 0.2) -> tuple[int, int, int]:
    """(train, val, test) row counts: the test part rounds up, then the validation share of what is left."""
    test = min(max(test, 0.0), MAX_FRACTION)
    val = min(max(val, 0.0), MAX_FRACTION)
    if val == 0:
        raise ValueError("the validation fraction must be above zero")
    n_test = math.ceil(test * n) if test > 0 else 0
    share = min(max(val / (1.0 - test), 0.0), MAX_FRACTION)
    n_val = math.ceil(share * (n - n_test))
    if n - n_test - n_val <= 0:
        raise ValueError(f"{n} rows leave no training rows at test={test}, val={val}")
    return n - n_test - n_val, n_val, n_test


class SplitPlan:
    """A fitted split: two threshold hashes. Applying it is a projection, on a table or on a stream."""

    def __init__(self, cuts: HashCuts, sizes: tuple[int, int, int]):
        self.cuts, self.sizes = cuts, sizes

    def apply(self, df: DataFrame, name: str = "split") -> DataFrame:
        h = F.col("__h")  # hashed once per row, compared twice
        label = F.when(self.cuts.at_most(0, h), "test").when(self.cuts.at_most(1, h), "val").otherwise("train")
        return df.withColumn("__h", self.cuts.hash()).withColumn(name, label).drop("__h")


def fit_split(df: DataFrame, keys: Sequence[str], test: float = 0.2, val: float = 0.2, seed: int = 42, stored: str | None = None) -> SplitPlan:
    """Shuffled split with exact sizes. Rows that share a key always share a split. ``stored``: see ``hash_cuts``."""
    cuts = hash_cuts(df, keys, seed, lambda n: [split_sizes(n, test, val)[2], sum(split_sizes(n, test, val)[1:])], stored)
    return SplitPlan(cuts, split_sizes(cuts.n, test, val))


def split_shuffled(df: DataFrame, keys: Sequence[str], test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    return fit_split(df, keys, test, val, seed).apply(df)


def split_tail(df: DataFrame, row_idx: str, test: float = 0.2, val: float = 0.2) -> DataFrame:
    """Unshuffled split over a dense 0-based row index: test is the tail, validation the tail of the rest."""
    n = df.count()
    n_train, n_val, _ = split_sizes(n, test, val)
    i = F.col(row_idx)
    return df.withColumn("split", F.when(i < n_train, "train").when(i < n_train + n_val, "val").otherwise("test"))


def _fold_ends(n: int, k: int) -> list[int]:
    """Ends of the first k-1 folds; the first ``n mod k`` folds are one row larger."""
    if not 2 <= k <= n:
        raise ValueError(f"cannot cut {n} rows into {k} folds")
    base, extra = divmod(n, k)
    return [base * (i + 1) + min(i + 1, extra) for i in range(k - 1)]


def kfold(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffled k-fold assignment with exact fold sizes; no shuffle of the table."""
    cuts = hash_cuts(df, keys, seed, lambda n: _fold_ends(n, k))
    return df.withColumn("__h", cuts.hash()).withColumn(name, cuts.piece(F.col("__h"))).drop("__h")


def repeated_kfold(df: DataFrame, keys: Sequence[str], k: int = 5, repeats: int = 3, seed: int = 42) -> DataFrame:
    """One row per (row, repeat) with its fold; repeat r shuffles with seed + r."""
    parts = [hash_cuts(df, keys, seed + r, lambda n: _fold_ends(n, k)) for r in range(repeats)]
    hashed = df.withColumns({f"__h{r}": c.hash() for r, c in enumerate(parts)})
    folds = F.array(*[F.struct(F.lit(r).alias("repeat"), c.piece(F.col(f"__h{r}")).alias("fold")) for r, c in enumerate(parts)])
    return hashed.select(*df.columns, F.inline(folds))


def split_stratified(
    df: DataFrame, keys: Sequence[str], label: str, test: float = 0.2, val: float = 0.2, seed: int = 42
) -> DataFrame:
    """Per-label exact split: each label's first ceil(test*n) rows are test, the next share validation."""
    n = F.col("n")
    n_test = F.ceil(F.lit(test) * n)
    n_val = F.ceil(F.lit(val / (1.0 - test)) * (n - n_test))
    cuts = stratum_cuts(df, keys, [label], seed, {"__t": n_test, "__v": n_test + n_val})
    joined = join_on(df, bounded(cuts), [label], "left").withColumn("__h", seeded_hash(seed, *keys))
    h = F.col("__h")
    split = F.when(h <= F.col("__t"), "test").when(h <= F.col("__v"), "val").otherwise("train")
    return joined.withColumn("split", split).drop("__t", "__v", "__h")


def epoch_sample(df: DataFrame, keys: Sequence[str], fraction: float, epoch: int, seed: int = 42) -> DataFrame:
    """The epoch's training rows: max(1, int(n * fraction)) of them, reshuffled every epoch."""
    cuts = hash_cuts(df, keys, seed * 1_000_003 + epoch, lambda n: [max(1, int(n * fraction))])
    return df.where(cuts.at_most(0, cuts.hash()))


def batches(df: DataFrame, keys: Sequence[str], size: int, seed: int | None = None, row_idx: str | None = None) -> DataFrame:
    """Add ``batch_id`` and ``pos``: fixed-size batches in hash order, or in row order without a seed."""
    if seed is None:
        if row_idx is None:
            raise ValueError("unshuffled batches need a row index")
        at = F.col(row_idx)
        ranked = df
    else:
        ranked = hash_rank(df, keys, seed, rank="__rank")
        at = F.col("__rank") - 1
    out = ranked.withColumn("batch_id", F.floor(at / size).cast("bigint")).withColumn("pos", (at % size).cast("bigint"))
    return out.drop("__rank")


def batch_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per batch with its values as a float32 matrix; a batch is at most ``size`` rows."""
    row = F.struct("pos", F.array(*[F.col(c).cast("float") for c in columns]).alias("x"))
    packed = df.groupBy("batch_id").agg(F.array_sort(F.collect_list(row)).alias("__m"))
    return packed.select("batch_id", F.size("__m").alias("n_rows"), F.transform("__m", lambda r: r["x"]).alias("features"))


def row_chunks(df: DataFrame, row_idx: str, chunk: int | None = None, max_mb: float | None = None) -> DataFrame:
    """``chunk_id`` by row count, or by megabytes from the mean size of all rows."""
    if chunk is None:
        if max_mb is None:
            raise ValueError("give chunk or max_mb")
        bytes_per_row = df.agg(F.avg(F.length(F.to_json(F.struct("*"))))).first()[0]
        chunk = max(1, math.floor(max_mb * 1024 * 1024 / bytes_per_row)) if bytes_per_row else 1
    return df.withColumn("chunk_id", F.floor(F.col(row_idx) / chunk).cast("bigint"))


def row_range(df: DataFrame, row_idx: str, start: int, stop: int) -> DataFrame:
    """Rows with start <= row_idx < stop; a plain comparison, so file statistics prune the scan."""
    return df.where((F.col(row_idx) >= start) & (F.col(row_idx) < stop))
