"""Drift over a stream: one stateful aggregate per window or block, judged by a projection.

The same functions run on a static table, so a replayed batch gives the rows of the stream. Rows later than
the watermark are dropped by Spark. ``follow_blocks`` keeps the open blocks only and appends each block once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emulake.functions.numeric import known
from emulake.models.base import matrix
from emulake.operators.drift import LISTED_INPUTS, R2_DROP, RMSE_RATIO
from emulake.operators.metrics import r2_from


def block_state(df: DataFrame, by: Column, ranges: Sequence, pair: tuple[str, str] | None) -> DataFrame:
    """Minima and maxima of the role columns and error sums of one truth/prediction pair, per block."""
    cols = [r["column"] for r in ranges]
    clean = df.select(by.alias("block"), *[known(F.col(c).cast("double")).alias(f"__c{i}") for i, c in enumerate(cols)],
                      *([F.col(pair[0]).cast("double").alias("__t"), F.col(pair[1]).cast("double").alias("__p")] if pair else []))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(len(cols)):
        aggs += [F.min(f"__c{i}").alias(f"lo{i}"), F.max(f"__c{i}").alias(f"hi{i}")]
    if pair:
        e = F.col("__p") - F.col("__t")
        aggs += [F.sum(e * e).alias("sse"), (F.var_pop("__t") * F.count("__t")).alias("sst"), F.count("__t").alias("n_pairs")]
    return clean.groupBy("block").agg(*aggs)


def judge(state: DataFrame, ranges: Sequence, reference: Mapping[str, float] | None, r2_drop: float = R2_DROP, rmse_ratio: float = RMSE_RATIO,
          more: Sequence[str] = ()) -> DataFrame:
    """Range lists, accuracy and triggers of each block, by arithmetic on its own row."""
    def outside(i: int) -> Column:
        lo, hi = ranges[i]["lo"], ranges[i]["hi"]
        return F.coalesce((F.col(f"lo{i}") < F.lit(lo)) | (F.col(f"hi{i}") > F.lit(hi)), F.lit(False))

    def names(role: str) -> Column:
        hits = [F.when(outside(i), F.lit(r["column"])) for i, r in enumerate(ranges) if r["role"] == role]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    out = state.withColumns({"inputs_out_all": names("input"), "outputs_out": names("output")})
    fell = F.lit(False)
    if reference is not None and "sse" in state.columns:
        out = out.withColumns({"r2": r2_from(F.col("sse"), F.col("sst")), "rmse": F.sqrt(F.try_divide(F.col("sse"), F.col("n_pairs")))})
        fell = F.coalesce(F.col("r2") < F.lit(reference["r2"] - r2_drop), F.lit(False))
        if reference["rmse"] > 0:
            fell = fell | F.coalesce(F.col("rmse") > F.lit(reference["rmse"] * rmse_ratio), F.lit(False))
    else:
        out = out.withColumns({"r2": F.lit(None).cast("double"), "rmse": F.lit(None).cast("double")})
    triggers = F.array_compact(F.array(
        F.when(F.size("inputs_out_all") > 0, F.lit("input_ood")), F.when(F.size("outputs_out") > 0, F.lit("output_ood")), F.when(fell, F.lit("accuracy_drop"))))
    out = out.withColumn("triggers", triggers)
    return out.select("block", "n", "r2", "rmse", F.size("inputs_out_all").alias("n_inputs_out"), F.slice("inputs_out_all", 1, LISTED_INPUTS).alias("inputs_out"),
                      "outputs_out", "triggers", (F.size("triggers") > 0).alias("drift_detected"), *more)


def watch_blocks(df: DataFrame, row_idx: str, size: int, ranges: DataFrame, pair: tuple[str, str] | None = None, reference: Mapping[str, float] | None = None) -> DataFrame:
    """Fixed-size blocks by row index; on a stream use update or complete output."""
    rows = ranges.orderBy("role", "ord").collect()  # one row per role column
    return judge(block_state(df, F.floor(F.col(row_idx) / size).cast("bigint"), rows, pair), rows, reference)


def watch_windows(df: DataFrame, ts: str, window: str, ranges: DataFrame, pair: tuple[str, str] | None = None,
                  reference: Mapping[str, float] | None = None, watermark: str | None = None) -> DataFrame:
    """Event-time windows; with a watermark a stream can append each window once it is closed."""
    rows = ranges.orderBy("role", "ord").collect()
    timed = df.withWatermark(ts, watermark) if watermark else df
    out = judge(block_state(timed, F.window(ts, window), rows, pair), rows, reference)
    return out.withColumns({"window_start": F.col("block.start"), "window_end": F.col("block.end")}).drop("block")


# --- blocks with state: sums of each task, merged by shard --------------------------------------------------

PARTIAL = "shard bigint, block bigint, n bigint, low array<double>, high array<double>, n_pairs bigint, sse double, mean double, m2 double"


def block_sums(df: DataFrame, row_idx: str, size: int, columns: Sequence[str], pair: tuple[str, str] | None, shards: int) -> DataFrame:
    """Sums of each block in each Arrow batch (schema PARTIAL), so a shuffle moves a few rows of a block however large it is.

    Missing numbers and, as in ``block_state``, values that are not known take no part; a block without any has NULL extremes.
    """
    cells = [known(F.col(c).cast("double")) for c in columns] + ([F.col(c).cast("double") for c in pair] if pair else [])
    wanted = df.select(F.floor(F.col(row_idx) / size).cast("bigint").alias("block"), F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in cells]).alias("v"))
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, v = batch.column("block").to_numpy(zero_copy_only=False), matrix(batch.column("v"))
            rows = []
            for b in np.unique(block[~pd.isna(block)]):
                own = v[block == b]
                empty = np.isnan(own[:, :k]).all(axis=0)
                low = np.where(empty, np.nan, np.where(np.isnan(own[:, :k]), np.inf, own[:, :k]).min(axis=0))
                high = np.where(empty, np.nan, np.where(np.isnan(own[:, :k]), -np.inf, own[:, :k]).max(axis=0))
                n = sse = mean = m2 = 0.0
                if pair:
                    t = own[:, k][~np.isnan(own[:, k])]
                    e = own[:, k + 1] - own[:, k]
                    n, sse = len(t), float(np.nansum(e * e))
                    mean = float(t.mean()) if n else 0.0
                    m2 = float(((t - mean) ** 2).sum())
                rows.append((int(b) % shards, int(b), len(own), low.tolist(), high.tolist(), int(n), sse, mean, m2))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["shard", "block", "n", "low", "high", "n_pairs", "sse", "mean", "m2"]), preserve_index=False)

    return wanted.where("block IS NOT NULL").mapInArrow(run, PARTIAL)


def _merged(a: tuple, b: tuple) -> tuple:
    """Two sums of one block: n, low, high, n_pairs, sse, mean, m2."""
    with np.errstate(invalid="ignore"):
        low, high = np.fmin(a[1], b[1]).tolist(), np.fmax(a[2], b[2]).tolist()
    n = a[3] + b[3]
    shift = b[5] - a[5]
    mean = a[5] + (shift * b[3] / n if n else 0.0)
    return a[0] + b[0], low, high, n, a[4] + b[4], mean, a[6] + b[6] + (shift * shift * a[3] * b[3] / n if n else 0.0)


def follow_blocks(
    stream: DataFrame, row_idx: str, size: int, ranges: DataFrame, pair: tuple[str, str] | None = None, reference: Mapping[str, float] | None = None,
    total_rows: int | None = None, lag: int | None = None, shards: int = 64,
) -> DataFrame:
    """Blocks of ``size`` rows by row index, each appended once when it is full, as ``judge`` gives them, with ``late_rows``.

    The state has one row for each of ``shards``, block b being in shard b mod shards: the open blocks' sums and the numbers
    of those that are done. A full block's sums are dropped. Rows may come in any order: a block stays open until it is full.
    Only with a ``lag``, blocks that stay open although one ``lag`` blocks later has begun are appended as they are, so that no
    shard holds more than ``lag`` of them. ``total_rows``, where known, says how many rows the last block has. Rows of a block that is done are not added: a row with n = 0 tells their number in late_rows.
    Rows without an index are left out. Runs on a stream in append mode only.
    """
    rows = ranges.orderBy("role", "ord").collect()  # one row per role column
    names = [r["column"] for r in rows]
    last = None if total_rows is None else (total_rows - 1) // size
    schema = "block bigint, n bigint, low array<double>, high array<double>, n_pairs bigint, sse double, sst double, late_rows bigint"
    state_schema = "next bigint, done array<bigint>, open array<struct<block:bigint,n:bigint,low:array<double>,high:array<double>,n_pairs:bigint,sse:double,mean:double,m2:double>>"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        # blocks of this shard below ``floor`` are done, and those in ``done``
        floor, done, held = state.get if state.exists else (shard, [], [])
        done, open_blocks, late = set(done or []), {h[0]: tuple(h)[1:] for h in held or []}, {}
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.block < floor or r.block in done:
                    late[r.block] = late.get(r.block, 0) + r.n
                    continue
                new = (r.n, r.low.tolist(), r.high.tolist(), r.n_pairs, r.sse, r.mean, r.m2)  # plain numbers, as the state takes no others
                open_blocks[r.block] = _merged(open_blocks[r.block], new) if r.block in open_blocks else new
        newest = max([*open_blocks, *done, floor - 1])
        full = lambda b: open_blocks[b][0] >= (size if b != last else total_rows - last * size)
        out = []
        for b in sorted(open_blocks):
            if full(b) or (lag is not None and b + lag <= newest):
                n, low, high, pairs, sse, _, m2 = open_blocks.pop(b)
                out.append((b, n, low, high, pairs, sse, m2, 0))
                done.add(b)
        if lag is not None and newest >= lag:
            floor = max(floor, (newest - lag) // shards * shards + shard)
        while floor in done:
            floor += shards
        done = {b for b in done if b >= floor}
        out += [(b, 0, None, None, 0, None, None, n) for b, n in sorted(late.items())]
        state.update((floor, sorted(done), [(b, *v) for b, v in sorted(open_blocks.items())]))
        yield pd.DataFrame(out, columns=["block", "n", "low", "high", "n_pairs", "sse", "sst", "late_rows"])

    sums = block_sums(stream, row_idx, size, names, pair, shards)
    kept = sums.groupBy("shard").applyInPandasWithState(update, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
    number = lambda c, i: F.nanvl(F.get(c, F.lit(i)), F.lit(None).cast("double"))
    wide = kept.select("block", "n", "late_rows", *[number("low", i).alias(f"lo{i}") for i in range(len(names))], *[number("high", i).alias(f"hi{i}") for i in range(len(names))],
                       *(["n_pairs", "sse", "sst"] if pair else []))
    return judge(wide, rows, reference, more=["late_rows"])
