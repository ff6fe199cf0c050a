"""Profiling and validation of wide tables: moments, exact quantiles, histograms, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulake.functions.numeric import finite, known
from emulake.operators.scale import WIDE, column_stats, long_values
from emulake.session import bounded

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
PERCENTILE_ROWS = 250_000  # values one exact-percentile buffer may hold
PERCENTILE_COLUMNS = 16  # columns whose buffers live in one aggregate
MARGIN = 5e-4  # half-width, in rank fraction, of an approximate bracket


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], limit: int = PERCENTILE_ROWS,
                    counts: dict[str, int] | None = None) -> dict[str, list[float]]:
    """Linear-interpolation quantiles of every column, exact at any size.

    Columns with at most ``limit`` values use the built-in exact percentile. Larger ones are bracketed
    by approximate percentiles; the bracket is counted, narrowed until it holds few values, and the exact
    percentile runs inside it. Buffers stay below ``limit`` values whatever the table's size.
    """
    out: dict[str, list[float]] = {}
    for start in range(0, len(columns), PERCENTILE_COLUMNS):
        out.update(_quantiles(df, list(columns[start:start + PERCENTILE_COLUMNS]), list(probs), limit, counts))
    return out


def _quantiles(df: DataFrame, columns: list[str], probs: list[float], limit: int, known_counts: dict[str, int] | None) -> dict[str, list[float]]:
    clean = df.select(*[known(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    if known_counts is None:
        known_counts = dict(zip(columns, clean.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))]).first()))
    n = [known_counts[c] for c in columns]
    cells = [(i, j) for i in range(len(columns)) for j in range(len(probs)) if n[i] > 0]
    bracket: dict[tuple[int, int], tuple[float, float] | None] = {c: None for c in cells}
    below = dict.fromkeys(cells, 0)
    inside = {c: n[c[0]] for c in cells}

    def value(cell) -> Column:
        x = F.col(f"c{cell[0]}")
        if bracket[cell] is None:
            return x
        lo, hi = bracket[cell]
        return F.when((x >= lo) & (x <= hi), x)

    def position(cell) -> float:
        return (n[cell[0]] - 1) * probs[cell[1]]

    margin = dict.fromkeys(cells, MARGIN)
    settled: set[tuple[int, int]] = set()
    while True:
        wide = [c for c in cells if inside[c] > limit and c not in settled]
        if not wide:
            break
        spans: dict[tuple, list[tuple]] = {}  # cells that still look at the same values share one sketch
        for c in wide:
            spans.setdefault((c[0], bracket[c]), []).append(c)
        asks = []
        for k, group in enumerate(spans.values()):
            ends = []
            for c in group:
                q = (position(c) - below[c]) / inside[c]
                ends += [max(0.0, q - margin[c]), min(1.0, q + margin[c])]
            asks.append(F.percentile_approx(value(group[0]), ends, 10_000).alias(f"q{k}"))
        got = clean.agg(*asks).first()
        trial = {c: (got[f"q{k}"][2 * i], got[f"q{k}"][2 * i + 1]) for k, group in enumerate(spans.values()) for i, c in enumerate(group)}
        counts = []
        for k, c in enumerate(wide):
            x, (lo, hi) = F.col(f"c{c[0]}"), trial[c]
            counts += [F.count(F.when(x < lo, 1)).alias(f"b{k}"), F.count(F.when((x >= lo) & (x <= hi), 1)).alias(f"i{k}")]
        got = clean.agg(*counts).first()
        for k, c in enumerate(wide):
            under, held, h = got[f"b{k}"], got[f"i{k}"], int(position(c))
            if not (under <= h and min(h + 1, n[c[0]] - 1) < under + held):
                margin[c] *= 4  # the approximation missed: look wider
                continue
            if held >= inside[c] or trial[c][0] == trial[c][1]:
                settled.add(c)  # only ties are left, so the percentile buffer is small
            bracket[c], below[c], inside[c] = trial[c], under, held
    small = {i for i, _ in cells if n[i] <= limit}
    asks = [F.percentile(f"c{i}", probs).alias(f"all{i}") for i in sorted(small)]
    asks += [F.percentile(value(c), _inner(position(c), below[c], inside[c])).alias(f"q{c[0]}_{c[1]}") for c in cells if c[0] not in small]
    got = clean.agg(*asks).first() if asks else {}
    out: dict[str, list[float]] = {c: [None] * len(probs) for c in columns}
    for i, j in cells:
        out[columns[i]][j] = got[f"all{i}"][j] if i in small else got[f"q{i}_{j}"]
    return out


def _inner(position: float, below: int, inside: int) -> float:
    """Rank fraction inside the bracket."""
    return min(1.0, max(0.0, (position - below) / (inside - 1))) if inside > 1 else 0.0


def describe(df: DataFrame, columns: Sequence[str] | None = None, sample: tuple[int, Sequence[str]] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max and variance per numeric column.

    ``sample=(n, keys)`` describes an exact seeded sample instead of the whole table.
    """
    from emulake.operators.rank import sample_exact

    if sample:
        df = sample_exact(df, sample[0], sample[1])
    columns = [c for c in (columns or df.columns) if c in numeric_columns(df)]
    base = column_stats(df, columns, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75], counts={c: base[c]["count"] for c in columns})
    rows = []
    for c in columns:
        b, q = base[c], quart[c]
        std = b["std"]
        rows.append((c, b["count"], b["mean"], std, b["min"], *q, b["max"], None if std is None else std * std))
    schema = "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double, variance double"
    return df.sparkSession.createDataFrame(rows, schema)


def table_summary(df: DataFrame) -> DataFrame:
    """Shape and type facts as (kind, name, value)."""
    n = df.count()
    rows = [("shape", "rows", n), ("shape", "columns", len(df.columns))]
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    rows += [("dtype", k, v) for k, v in kinds.items()]
    numbers = set(numeric_columns(df))
    rows += [("numeric_column", c, i) for i, c in enumerate(df.columns) if c in numbers]
    rows += [("categorical_column", f.name, i) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    return df.sparkSession.createDataFrame(rows, "kind string, name string, value bigint")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``n_duplicates``: rows beyond the first of each distinct row. NULL and NaN are one value here.

    Rows meet as 32-byte digests, so the shuffle does not carry the table, and copies collapse map-side.
    """
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = known(c) + F.lit(0.0)  # -0.0 equals 0.0
        text = F.to_json(F.struct(c.alias("v"))) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
        parts += [F.length(text).cast("string"), text]
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x00")) for p in parts]), 256)
    copies = df.select(digest.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("c"))
    return copies.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def mixed_text_columns(df: DataFrame) -> DataFrame:
    """(column, n_classes, n_integer, n_number, n_text) for text columns; mixed when n_classes > 1."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in texts])
    long = df.select(F.inline(cells)).where("v IS NOT NULL")
    kind = F.when(F.col("v").try_cast("bigint").isNotNull(), "integer").when(
        F.col("v").try_cast("double").isNotNull(), "number").otherwise("text")
    counts = long.select("column", kind.alias("k")).groupBy("column").agg(
        *[F.count(F.when(F.col("k") == k, 1)).alias(f"n_{k}") for k in ("integer", "number", "text")])
    present = sum((F.col(f"n_{k}") > 0).cast("bigint") for k in ("integer", "number", "text"))
    return counts.withColumn("n_classes", present)


def validate(df: DataFrame) -> DataFrame:
    """Findings as (check, column, count): missing, infinite, duplicate rows, mixed text; empty is an error."""
    from emulake.operators.roles import cell_counts

    nothing = F.lit(None).cast("string")

    def item(check: str, column: Column, count: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), column.alias("column"), count.cast("bigint").alias("count"))

    first = F.col("column") == df.columns[0]
    cells = cell_counts(df, "t").select(F.inline(F.array_compact(F.array(
        F.when((F.col("n_rows") == 0) & first, item("empty", nothing, F.lit(0))),
        F.when(F.col("n_missing") > 0, item("missing", F.col("column"), F.col("n_missing"))),
        F.when(F.col("n_inf") > 0, item("infinite", F.col("column"), F.col("n_inf")))))))
    dup = duplicate_rows(df).where("n_duplicates > 0").select(F.lit("duplicates").alias("check"), nothing.alias("column"), F.col("n_duplicates").alias("count"))
    found = cells.unionByName(dup)
    if any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
        mixed = mixed_text_columns(df).where("n_classes > 1").select(F.lit("mixed").alias("check"), "column", F.col("n_classes").alias("count"))
        found = found.unionByName(mixed)
    return found


def signal_to_noise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean(|x|) / population std per column; 0 where the column does not vary."""
    long = long_values(df, columns).withColumn("value", known("value"))
    s = F.stddev_pop("value")
    return long.groupBy("column").agg(F.when(s > 0, F.avg(F.abs("value")) / s).otherwise(F.lit(0.0)).alias("snr"))


PAIRS_IN_ONE_AGG = 400


def correlations(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson r of every input with every output: (input, output, n, r). Only finite values count."""
    pairs = [(a, b) for a in inputs for b in outputs]
    if len(pairs) > PAIRS_IN_ONE_AGG:
        return _correlations_wide(df, inputs, outputs)
    names = list(dict.fromkeys([*inputs, *outputs]))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    clean = df.select(*[finite(F.col(c).cast("double")).alias(at[c]) for c in names])
    aggs = []
    for k, (a, b) in enumerate(pairs):
        aggs.append(F.struct(
            F.lit(a).alias("input"), F.lit(b).alias("output"),
            F.count(F.when(F.col(at[a]).isNotNull() & F.col(at[b]).isNotNull(), 1)).alias("n"),
            F.corr(at[a], at[b]).alias("r")).alias(f"p{k}"))
    one = clean.agg(*aggs)
    return one.select(F.inline(F.array(*[F.col(f"p{k}") for k in range(len(pairs))]))).withColumn("r", known("r"))


def _correlations_wide(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Block form: each task adds up masked cross products with numpy, Spark adds the tasks together.

    Values are shifted by the column mean first, which keeps the sums of squares well conditioned.
    """
    names = list(dict.fromkeys([*inputs, *outputs]))
    clean = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in names])
    centre = column_stats(clean, names, {"m": F.avg})
    shifted = clean.select(*[(F.col(c) - F.lit(centre[c]["m"] or 0.0)).alias(f"c{i}") for i, c in enumerate(names)])
    xi, yi = [names.index(c) for c in inputs], [names.index(c) for c in outputs]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            v = pdf.to_numpy(dtype=np.float64)
            ok = np.isfinite(v)
            z = np.where(ok, v, 0.0)
            x, y, mx, my = z[:, xi], z[:, yi], ok[:, xi].astype(float), ok[:, yi].astype(float)
            part = np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])
            total = part if total is None else total + part
        if total is not None:
            p, q = total.shape[1:]
            i, j = np.divmod(np.arange(p * q), q)
            flat = total.reshape(6, -1)
            yield pd.DataFrame({"i": i, "j": j, "n": flat[0], "sx": flat[1], "sy": flat[2], "sxx": flat[3], "syy": flat[4], "sxy": flat[5]})

    schema = "i bigint, j bigint, n double, sx double, sy double, sxx double, syy double, sxy double"
    s = shifted.mapInPandas(blocks, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.nullif(F.col("n"), F.lit(0.0))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.nullif(F.col("n"), F.lit(0.0))
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.nullif(F.col("n"), F.lit(0.0))
    r = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    ins, outs = F.array(*[F.lit(c) for c in inputs]), F.array(*[F.lit(c) for c in outputs])
    return s.select(F.get(ins, F.col("i").cast("int")).alias("input"), F.get(outs, F.col("j").cast("int")).alias("output"),
                    F.col("n").cast("bigint").alias("n"), r.alias("r"))


def strongest_pair(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """The pair with the largest |r| (first in column order on ties) and its regression line, raw and z-scored."""
    order = F.create_map(*[x for i, c in enumerate(dict.fromkeys([*inputs, *outputs])) for x in (F.lit(c), F.lit(i))])
    best = correlations(df, inputs, outputs).where("r IS NOT NULL").orderBy(
        F.abs("r").desc(), order[F.col("input")], order[F.col("output")]).limit(1).first()
    if best is None:
        raise ValueError("no valid correlation")
    x, y = known(F.col(best["input"]).cast("double")), known(F.col(best["output"]).cast("double"))
    both = df.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    line = both.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return line.select(F.lit(best["input"]).alias("input"), F.lit(best["output"]).alias("output"), F.lit(best["r"]).alias("r"),
                       "slope", "intercept", F.lit(best["r"]).alias("z_slope"), F.lit(0.0).alias("z_intercept"))


def profile_mean_std(df: DataFrame, array_col: str) -> DataFrame:
    """Mean and population std at each position of an array profile."""
    long = df.select(F.posexplode(array_col).alias("pos", "value"))
    v = known(F.col("value").cast("double"))
    return long.select("pos", v.alias("value")).groupBy("pos").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin with a closed last bin; a flat range is widened by half a unit each way."""
    left = F.when(hi > lo, lo).otherwise(lo - 0.5)
    width = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.greatest(F.least(F.floor((x - left) / width * bins), F.lit(bins - 1)), F.lit(0)).cast("bigint")


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 12) -> DataFrame:
    """(column, bin, lo, hi, n): equal-width counts between each column's extremes; empty bins are absent."""
    lim = column_stats(df, columns, {"lo": F.min, "hi": F.max})
    got = {c: v for c, v in lim.items() if v["lo"] is not None}
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), _bin(known(F.col(c).cast("double")), F.lit(v["lo"]), F.lit(v["hi"]), bins).alias("bin"))
        for c, v in got.items()])
    counts = df.select(F.inline(cells)).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    edges = F.create_map(*[x for c, v in got.items() for x in (
        F.lit(c), F.array(F.lit(v["lo"]), F.lit(v["hi"])))])
    e = edges[F.col("column")]
    return counts.select("column", "bin", "n", e[0].alias("lo"), e[1].alias("hi"))


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median and range per column: the summary beside a density plot."""
    d = describe(df, columns)
    return d.select("column", "count", "mean", F.col("q50").alias("median"), "min", "max")


def density_2d(pred: DataFrame, bins: int = 50, by: Sequence[str] = ("model", "split", "output"), shared: Sequence[str] = ()) -> DataFrame:
    """Counts on a truth x prediction grid. Limits span both values plus 5 %, one pair per ``shared`` group."""
    ok = pred.where("abs(y_true) < double('inf') AND abs(y_pred) < double('inf')")
    low, high = F.min(F.least("y_true", "y_pred")), F.max(F.greatest("y_true", "y_pred"))
    lim = ok.groupBy(*shared).agg(low.alias("a"), high.alias("b"))
    pad = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) * 0.05).otherwise(F.lit(0.01))
    lim = lim.select(*shared, (F.col("a") - pad).alias("__lo"), (F.col("b") + pad).alias("__hi"))
    if shared:
        boxed = ok.join(bounded(lim), list(shared))
    else:
        edge = lim.first()
        boxed = ok.withColumns({"__lo": F.lit(edge["__lo"]), "__hi": F.lit(edge["__hi"])})
    return boxed.select(
        *by, _bin(F.col("y_true"), F.col("__lo"), F.col("__hi"), bins).alias("bin_true"),
        _bin(F.col("y_pred"), F.col("__lo"), F.col("__hi"), bins).alias("bin_pred"),
    ).groupBy(*by, "bin_true", "bin_pred").agg(F.count(F.lit(1)).alias("n"))


def sample_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, mean and max per column."""
    long = long_values(df, columns).withColumn("value", known("value"))
    return long.groupBy("column").agg(F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
