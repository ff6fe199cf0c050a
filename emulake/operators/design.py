"""Experiment designs: seeded samples, Latin hypercubes, run expansion, rendered inputs, search spaces."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.functions import text
from emulake.functions.hashing import uniform
from emulake.operators.rank import hash_rank


@dataclass
class Param:
    """One varied parameter with inclusive bounds."""

    name: str
    low: float
    high: float
    integer: bool = False
    log: bool = False

    def value(self, u: Column) -> Column:
        """Map a draw from [0, 1) into the parameter's range; integers round half to even last."""
        if self.log:
            a, b = math.log(self.low), math.log(self.high)
            x = F.exp(u * F.lit(b - a) + F.lit(a))
        else:
            x = u * F.lit(float(self.high) - float(self.low)) + F.lit(float(self.low))
        return F.bround(x) if self.integer else x


def draws(ids: DataFrame, params: Sequence[Param], seed: int, key: Sequence[str] = ("sample",)) -> DataFrame:
    """Independent uniform samples for the rows of ``ids``; each value depends on seed, name and key only."""
    return ids.withColumns({p.name: p.value(uniform(seed, F.lit(p.name), *key)) for p in params})


def random_design(spark: SparkSession, n: int, params: Sequence[Param], seed: int = 42) -> DataFrame:
    """(sample, one column per parameter), samples 1..n."""
    return draws(spark.range(1, n + 1).withColumnRenamed("id", "sample"), params, seed)


def latin_draws(ids: DataFrame, params: Sequence[Param], seed: int, key: Sequence[str] = ("sample",), n: int | None = None) -> DataFrame:
    """A Latin hypercube over the rows of ``ids``, whose ``key`` is unique: every parameter has exactly one row in each of its n equal strata.

    The stratum order of each parameter is a hash permutation, ranked for all parameters in one pass. Other columns are left out.
    """
    key = list(key)
    n = ids.count() if n is None else n
    names = F.array(*[F.lit(p.name) for p in params])
    long = ids.select(*key, F.explode(names).alias("dim"))
    placed = hash_rank(long, ["dim", *key], seed, strata=["dim"], rank="stratum")
    u = (F.col("stratum") - 1 + uniform(seed + 1, "dim", *key)) / F.lit(n)
    placed = placed.withColumn("u", u)
    return placed.groupBy(*key).agg(*[p.value(F.max(F.when(F.col("dim") == p.name, F.col("u")))).alias(p.name) for p in params])


def latin_design(spark: SparkSession, n: int, params: Sequence[Param], seed: int = 42) -> DataFrame:
    """Latin hypercube of samples 1..n, see latin_draws."""
    return latin_draws(spark.range(1, n + 1).withColumnRenamed("id", "sample"), params, seed, n=n)


def design(spark: SparkSession, n: int, params: Sequence[Param], method: str = "lhs", seed: int = 42) -> DataFrame:
    if method in ("random", "uniform"):
        return random_design(spark, n, params, seed)
    if method == "lhs":
        return latin_design(spark, n, params, seed)
    raise ValueError(f"unknown sampling method {method!r}")


def grid_runs(cases: DataFrame, levels: Mapping[str, Sequence[float]]) -> DataFrame:
    """``cases`` times every combination of ``levels``: run from 0, and a double per parameter.

    The run number is read as a number of mixed radix, its last digit being the level of the last parameter; nothing is joined,
    and no combination is held anywhere.
    """
    if not levels or any(len(v) == 0 for v in levels.values()):
        raise ValueError("every parameter needs a level")
    size = math.prod(len(v) for v in levels.values())
    runs = cases.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))))
    cols, stride = {}, size
    for name, values in levels.items():
        stride //= len(values)
        digit = F.floor(F.col("run") / stride) % len(values)
        cols[name] = F.get(F.array(*[F.lit(float(v)) for v in values]), digit.cast("int"))
    return runs.withColumns(cols)


def expand_runs(cases: DataFrame, samples: DataFrame, n_runs: int, mode: str = "set") -> DataFrame:
    """Runs over cases ``(case)`` and samples ``(sample, ...)``.

    set: every case in every run; fixed: the first case in every run; per_case: n_runs runs of each case.
    Runs are generated per case and then joined to the samples on their number.
    """
    if mode == "fixed":
        cases = cases.agg(F.min("case").alias("case")).where("case IS NOT NULL")
    elif mode not in ("set", "per_case"):
        raise ValueError("mode must be set, fixed or per_case")
    runs = cases.select("case", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_runs).cast("bigint"))).alias("sample"))
    number = F.concat(F.lit("run"), F.col("sample"))
    path = F.concat_ws("/", "case", "run") if mode == "per_case" else F.concat_ws("/", "run", "case")
    return runs.withColumn("run", number).join(samples, "sample").withColumn("path", path)


def per_case_samples(cases: DataFrame, n_runs: int, params: Sequence[Param], seed: int = 42, vary_by_case: bool = False) -> DataFrame:
    """Random samples per case and run. By default all cases repeat the same draws, as the seed is shared."""
    runs = cases.select("case", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_runs).cast("bigint"))).alias("sample"))
    return draws(runs, params, seed, ("case", "sample") if vary_by_case else ("sample",))


def set_parameters(lines: DataFrame, params: Sequence[str]) -> DataFrame:
    """Rewrite lines that set a parameter as ``lhs = value``; values come from columns of the same name."""
    line = F.col("line")
    out = line
    for p in params:
        out = F.when(text.assigns(line, p), F.concat(F.trim(text.left_side(line)), F.lit(" = "), text.number_text(F.col(f"`{p}`")))).otherwise(out)
    return lines.withColumn("line", out)


def render_inputs(template: DataFrame, runs: DataFrame, params: Sequence[str]) -> DataFrame:
    """Template lines ``(case, line_no, line)`` for every run of the case with its parameter values."""
    return set_parameters(template.join(runs, "case"), params).select("run", "case", "line_no", "line")


def unset_parameters(template: DataFrame, params: Sequence[str]) -> DataFrame:
    """(case, param) pairs whose template never sets the parameter: a replacement there is an error."""
    hits = [F.count_if(text.assigns(F.col("line"), p)).alias(f"h{i}") for i, p in enumerate(params)]
    counts = template.groupBy("case").agg(*hits)
    cells = F.array(*[F.struct(F.lit(p).alias("param"), F.col(f"h{i}").alias("n")) for i, p in enumerate(params)])
    return counts.select("case", F.inline(cells)).where("n = 0").select("case", "param")


def rendered_text(rendered: DataFrame) -> DataFrame:
    """One row per input file: its lines joined in order. A file is one case's input, small by nature."""
    g = rendered.groupBy("run", "case").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("a"))
    return g.select("run", "case", F.array_join(F.transform("a", lambda s: s["line"]), "\n").alias("text"))


# --- search spaces -------------------------------------------------------------------------------------


def _int_value(u: Column, low: int, high: int, step: int = 1) -> Column:
    return (F.lit(low) + F.floor(u * ((high - low) // step + 1)) * step).cast("bigint")


def _log_int(u: Column, low: int, high: int, step: int = 1) -> Column:
    a, b = math.log(low), math.log(high)
    x = F.exp(u * F.lit(b - a) + F.lit(a))
    return F.greatest(F.least(F.bround(x / step) * step, F.lit(high)), F.lit(low)).cast("bigint")


def sample_space(spark: SparkSession, space: Mapping[str, Mapping[str, Any]], n_trials: int, seed: int = 42) -> DataFrame:
    """One row per trial: ``number`` from 0, a typed column per parameter, and ``params`` (name -> JSON text).

    Lists come back under their own name, so the best trial's list can be used as it is.
    """
    return sample_rows(spark.range(n_trials).withColumnRenamed("id", "number"), space, seed)


def sample_rows(trials: DataFrame, space: Mapping[str, Mapping[str, Any]], seed: int = 42) -> DataFrame:
    """``sample_space`` for the trials of a table with the column ``number``; a trial's values depend on its number and the seed only."""

    def u(name: str) -> Column:
        return uniform(seed, F.lit(name), "number")

    cols: dict[str, Column] = {}
    texts: dict[str, Column] = {}
    for name, s in space.items():
        kind = s.get("type")
        if kind == "int":
            cols[name] = _int_value(u(name), int(s["low"]), int(s["high"]), int(s.get("step", 1)))
        elif kind in ("float", "loguniform"):
            log = kind == "loguniform" or bool(s.get("log", False))
            cols[name] = Param(name, float(s["low"]), float(s["high"]), log=log).value(u(name))
        elif kind == "categorical":
            options = [json.dumps(c) for c in s["choices"]]
            at = F.floor(u(name) * len(options)).cast("int")
            texts[name] = F.get(F.array(*[F.lit(o) for o in options]), at)
            cols[name] = texts[name]
        elif kind == "variable_list":
            length = _int_value(u(s.get("num_layers_name", f"{name}_num_layers")), int(s["num_layers"]["low"]), int(s["num_layers"]["high"]))
            e = s["element"]
            make = {"int": _int_value, "logint": _log_int}.get(e.get("type"))
            if make is None:
                raise ValueError(f"unsupported list element type {e.get('type')!r}")
            items = [make(u(f"{name}_{i}"), int(e["low"]), int(e["high"]), int(e.get("step", 1))) for i in range(int(s["num_layers"]["high"]))]
            cols[name] = F.slice(F.array(*items), F.lit(1), length.cast("int"))
        else:
            raise ValueError(f"unsupported parameter type {kind!r}")
    out = trials.withColumns(cols)
    pairs = []
    for name in space:
        if name in texts:
            value = F.col(name)
        elif space[name]["type"] == "variable_list":
            value = F.to_json(F.col(name))
        else:
            value = F.col(name).cast("string")
        pairs += [F.lit(name), value]
    return out.withColumn("params", F.create_map(*pairs))


def architecture(trials: DataFrame) -> DataFrame:
    """Hidden layers of each trial: the tuned list if present, else ``<n>`` numbered widths."""
    p = F.col("params")
    listed = F.from_json(F.try_element_at(p, F.lit("hidden_layers")), "array<bigint>")
    n = F.try_element_at(p, F.lit("mlp_num_hidden_layers")).try_cast("int")
    numbered = F.when(n > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda i: F.try_element_at(p, F.concat(F.lit("hidden_layers_"), i.cast("string"))).try_cast("bigint")))
    layers = F.coalesce(F.when(F.size(listed) > 0, listed), numbered, F.array().cast("array<bigint>"))
    return trials.withColumn("hidden_layers", layers).withColumn("num_hidden_layers", F.size("hidden_layers"))
