"""Campaign tables: case catalogue, status, chunk plans, reports and input verification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emulake.functions import text, times
from emulake.operators.ordered import order_bucket
from emulake.operators.rank import rank_in_cells
from emulake.session import join_on, materialize

# Directory names, marker files and states of a campaign.
CASE_PREFIX = "sparc_"
OUTPUT_FILE = "C1.h5"
STATUSES = ("finished", "inflight", "started", "pending")
WINDOW_SECONDS = 6 * 3600
TOLERANCE = 1e-6


def parse_paths(files: DataFrame, path: str = "path", prefix: str = CASE_PREFIX) -> DataFrame:
    """Split ``.../run<k>/<case>/<leaf>`` into run, case and leaf; other paths are dropped."""
    parts = files.withColumn("__p", F.split(path, "/"))
    named = parts.withColumns({n: F.try_element_at("__p", F.lit(at)) for n, at in (("run", -3), ("case", -2), ("leaf", -1))})
    return named.where(F.col("run").startswith("run") & F.col("case").startswith(prefix) & (F.col("leaf") != "")).drop("__p")


def natural(c: Column) -> Column:
    """The number in a name, for natural ordering."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint")


def number_cases(cases: DataFrame) -> DataFrame:
    """Add ``case_id``: 1, 2, ... over runs then cases in natural order."""
    tagged = cases.withColumns({c: F.coalesce(natural(F.col(of)), F.lit(0)) for c, of in (("__o", "run"), ("__c", "case"))})
    span = float((tagged.agg(F.max("__c")).first()[0] or 0) + 1)
    about = F.col("__o").cast("double") * span + F.col("__c").cast("double")  # never decreases along the exact order; it only forms cells
    return rank_in_cells(tagged, order_bucket(tagged, about), [], ["__o", "__c", "run", "case"], "case_id").drop("__o", "__c")


def scan_cases(files: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """Catalogue of cases from a file listing ``(path, length, mtime)`` and queued ids ``(case_id)``.

    finished: a marker or a non-empty output file; else inflight if queued; else started if marked;
    else pending. Start and finish stamps are the marker files' modification times.
    """
    f = parse_paths(files)
    leaf = F.col("leaf")
    cases = f.groupBy("run", "case").agg(
        F.bool_or((leaf == "finished") | ((leaf == OUTPUT_FILE) & (F.col("length") > 0))).alias("done"),
        F.bool_or(leaf == "started").alias("begun"),
        F.min(F.when(leaf == "started", F.col("mtime"))).alias("started_ts"),
        F.min(F.when(leaf == "finished", F.col("mtime"))).alias("finished_ts"))
    numbered = number_cases(materialize(cases, "cases"))  # numbering reads the cases three times
    if queued is not None:
        numbered = numbered.join(queued.select("case_id").distinct().withColumn("__q", F.lit(True)), "case_id", "left")
    else:
        numbered = numbered.withColumn("__q", F.lit(None).cast("boolean"))
    status = F.when(F.col("done"), "finished").when(F.col("__q"), "inflight").when(F.col("begun"), "started").otherwise("pending")
    return numbered.select("case_id", "run", F.col("case").alias("eq"), status.alias("status"), "started_ts", "finished_ts")


def run_marker_status(files: DataFrame) -> DataFrame:
    """Per run: finished, queued and pending cases and their percentages, from marker files alone."""
    return case_marker_status(files).groupBy("run").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("finished", "queued", "pending")]
    ).withColumns({f"{s}_pct": text.percent(F.col(s), F.col("total")) for s in ("finished", "queued", "pending")})


def case_marker_status(files: DataFrame) -> DataFrame:
    """(run, case, status) by marker: any output or finished file, else queued file, else pending."""
    f = parse_paths(files)
    leaf = F.col("leaf")
    marks = f.groupBy("run", "case").agg(
        F.bool_or(leaf.isin("finished", OUTPUT_FILE)).alias("d"), F.bool_or(leaf == "queued").alias("q"))
    return marks.select("run", "case", F.when(F.col("d"), "finished").when(F.col("q"), "queued").otherwise("pending").alias("status"))


def queued_ids(lines: DataFrame, column: str = "line") -> DataFrame:
    """Distinct ids of queue listings such as ``[1-3,7%4]``."""
    tokens = lines.where(F.trim(F.col(column)) != "-").select(F.explode(text.id_tokens(F.col(column))).alias("t"))
    return tokens.select(F.explode(text.expand_ids(F.col("t"))).alias("case_id")).distinct()


# --- reports -------------------------------------------------------------------------------------------


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_by_run(cases: DataFrame) -> DataFrame:
    """Counts of each state per run and what remains (pending + started + inflight)."""
    g = cases.groupBy("run").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return g.withColumn("remaining", F.col("pending") + F.col("started") + F.col("inflight"))


def top_runs(by_run: DataFrame, n: int = 10) -> DataFrame:
    return by_run.orderBy(F.col("remaining").desc(), "run").limit(n)


def _timed(cases: DataFrame) -> DataFrame:
    s, f = F.coalesce(F.col("started_ts"), F.lit(0)), F.coalesce(F.col("finished_ts"), F.lit(0))
    return cases.where((s != 0) & (f != 0) & (f > s))


def runtime_stats(cases: DataFrame) -> DataFrame:
    """Count, mean, min and max run time, as seconds and as text, and the last finish."""
    d = F.col("finished_ts") - F.col("started_ts")
    g = _timed(cases).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("avg_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"),
                          F.max("finished_ts").alias("last"))
    return g.select("n", "avg_s", "min_s", "max_s", text.duration(F.floor("avg_s")).alias("avg"), text.duration(F.col("min_s")).alias("min"),
                    text.duration(F.col("max_s")).alias("max"), times.iso_time(F.col("last")).alias("last_finish"))


def throughput(cases: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """Cases finished in the window ending at the last finish, and the hourly rate."""
    timed = _timed(cases).select("finished_ts")
    last = timed.agg(F.max("finished_ts")).first()[0]
    recent = timed.where(F.col("finished_ts") >= F.lit(last) - window)
    return recent.agg(F.count(F.lit(1)).alias("n_recent")).withColumn("per_hour", F.col("n_recent") / (window / 3600))


def run_completion(cases: DataFrame, queued: DataFrame) -> DataFrame:
    """Per run: cases, queued cases, and whether every case is finished."""
    q = queued.select("case_id").distinct().withColumn("__q", F.lit(1))
    j = cases.join(q, "case_id", "left")
    return j.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_cases"), F.bool_and(F.col("status") == "finished").alias("completed"),
        F.count("__q").alias("n_queued"))


def campaign_summary(completion: DataFrame) -> DataFrame:
    """Totals over runs. A run both complete and queued is subtracted twice from what remains, as reported."""
    done = F.col("completed")
    g = completion.agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(done).alias("completed_runs"), F.count_if(F.col("n_queued") > 0).alias("queued_runs"),
        F.sum("n_cases").alias("total_cases"), F.coalesce(F.sum(F.when(done, F.col("n_cases"))), F.lit(0)).alias("completed_cases"),
        F.sum("n_queued").alias("queued_cases"))
    left = F.greatest(F.col("total_runs") - F.col("completed_runs") - F.col("queued_runs"), F.lit(0))
    return g.withColumn("remaining_runs", left).withColumn("completed_pct", text.percent(F.col("completed_runs"), F.col("total_runs")))


def runs_with_queued(cases: DataFrame, queued: DataFrame) -> DataFrame:
    """Runs that have at least one queued case."""
    return cases.join(queued.select("case_id").distinct(), "case_id", "left_semi").select("run").distinct()


def id_ranges(ids: DataFrame, group: Sequence[str], column: str = "id", page: int = 65_536) -> DataFrame:
    """Maximal runs of consecutive ids per group: (group..., lo, hi).

    Runs are found inside id pages, then only the pieces that touch a page edge (two per page at most)
    are stitched together, so one large group is spread over its pages.
    """
    group = list(group)
    d = ids.select(*group, F.col(column).cast("bigint").alias("id")).distinct().withColumn("p", F.floor(F.col("id") / page))
    inside = Window.partitionBy(*group, "p").orderBy("id")
    isl = d.withColumn("k", F.col("id") - F.row_number().over(inside)).groupBy(*group, "p", "k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    edge = (F.col("lo") == F.col("p") * page) | (F.col("hi") == (F.col("p") + 1) * page - 1)
    whole = isl.where(~edge).select(*group, "lo", "hi")
    along = Window.partitionBy(*group).orderBy("lo")
    pieces = isl.where(edge).select(*group, "lo", "hi").withColumn("new", F.when(F.lag("hi").over(along) + 1 == F.col("lo"), 0).otherwise(1))
    pieces = pieces.withColumn("k", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = pieces.groupBy(*group, "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*group, "lo", "hi")
    return whole.unionByName(stitched)


def range_lines(ranges: DataFrame, group: Sequence[str], width: int = 100_000) -> DataFrame:
    """Text such as ``1-3, 7``: one line per group and ``width`` ids, so no line grows without bound."""
    part = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    cells = ranges.withColumn("line", F.floor(F.col("lo") / width)).groupBy(*group, "line").agg(
        F.array_sort(F.collect_list(F.struct("lo", part.alias("t")))).alias("a"))
    return cells.select(*group, "line", F.array_join(F.transform("a", lambda s: s["t"]), ", ").alias("ids"))


def cases_by_run(cases: DataFrame, page: int = 1000) -> DataFrame:
    """Cases of each run in case order, ``page`` consecutive case ids per row."""
    g = cases.withColumn("page", F.floor(F.col("case_id") / page)).groupBy("run", "page").agg(
        F.array_sort(F.collect_list(F.struct("case_id", "eq"))).alias("a"))
    return g.select("run", "page", F.transform("a", lambda s: s["eq"]).alias("cases"))


# --- chunk planning ------------------------------------------------------------------------------------


def _steps(ids: np.ndarray, starts: np.ndarray, hi: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start: the slice [i, j) of ``ids`` its chunk takes, and the start with which it leaves
    the page (-1 while it stays). Empty windows are skipped whole."""
    i = np.searchsorted(ids, starts)
    ahead = ids[np.minimum(i, len(ids) - 1)]
    skip = np.where(i < len(ids), (ahead - starts) // chunk, -(-(hi + 1 - starts) // chunk))
    w = starts + chunk * np.maximum(skip, 0) * (starts <= hi)
    leaves = (w > hi) | (i == len(ids))
    return np.searchsorted(ids, w), np.searchsorted(ids, w + chunk - 1, side="right"), np.where(leaves, w, -1)


PAGE_MAP = "page bigint, out array<int>, n array<bigint>"


def page_maps(paged: DataFrame, origin: int, chunk: int, page: int, pages: int) -> DataFrame:
    """(page, out, n) for every page: the entry into the next page and the chunks begun, for each of the ``chunk`` possible entries.

    ``paged`` has the pending ids of each page, those of the next page's first ``chunk`` places included. A page without
    pending ids skips whole windows.
    """

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(key[0])
        ids = np.sort(pdf["case_id"].to_numpy())
        lo, hi = origin + p * page, origin + (p + 1) * page - 1
        _, after, leave = (a.tolist() for a in _steps(ids, ids + 1, hi, chunk))
        out, n = list(leave), [0] * len(ids)  # of the chain that goes on after each id, last id first
        for k in range(len(ids) - 1, -1, -1):
            if leave[k] < 0:
                out[k], n[k] = out[after[k] - 1], n[after[k] - 1] + 1
        _, j, exit_at = _steps(ids, np.arange(lo, lo + chunk), hi, chunk)
        got = [((x if x >= 0 else out[k - 1]) - hi - 1, 0 if x >= 0 else n[k - 1] + 1) for k, x in zip(j.tolist(), exit_at.tolist())]
        return pd.DataFrame({"page": [p], "out": [[g[0] for g in got]], "n": [[g[1] for g in got]]})

    full = paged.groupBy("page").applyInPandas(exits, PAGE_MAP)
    entries = F.sequence(F.lit(0), F.lit(chunk - 1))
    every = paged.sparkSession.range(pages).withColumnRenamed("id", "page").join(full, "page", "left")
    return every.select(
        "page", F.coalesce("out", F.transform(entries, lambda e: F.pmod(e - page, F.lit(chunk)).cast("int"))).alias("out"),
        F.coalesce("n", F.transform(entries, lambda e: F.lit(0).cast("bigint"))).alias("n"))


def page_entries(maps: DataFrame, pages: int) -> DataFrame:
    """(page, entry, done): where the plan that begins at entry 0 of page 0 enters every page, and the chunks begun before.

    The maps are composed by doubling: after round k a page's map stands for the 2 ** k pages up to it, and joins the map of the page
    2 ** k before. A round is one join of rows of fixed size; there are as many as the logarithm of the number of pages.
    """
    step = 1
    while step < pages:
        before = maps.select((F.col("page") + step).alias("page"), F.col("out").alias("out_a"), F.col("n").alias("n_a"))
        both = maps.join(before, "page", "left")
        then = lambda c: F.transform("out_a", lambda e: F.get(c, e))
        maps = materialize(both.select(
            "page", F.when(F.col("out_a").isNull(), F.col("out")).otherwise(then("out")).alias("out"),
            F.when(F.col("out_a").isNull(), F.col("n")).otherwise(F.zip_with("n_a", then("n"), lambda x, y: x + y)).alias("n")), "page-maps")
        step *= 2
    first = maps.sparkSession.createDataFrame([(0, 0, 0)], "page bigint, entry int, done bigint")
    return first.unionByName(maps.select((F.col("page") + 1).alias("page"), F.get("out", F.lit(0)).alias("entry"), F.get("n", F.lit(0)).alias("done")))


def plan_chunks(cases: DataFrame, chunk: int, configs: Sequence[str], start_config: int = 0, max_chunks: int | None = None,
                page: int = 65_536) -> DataFrame:
    """Job chunks over pending cases: (chunk, first_id, last_id, case_ids, config).

    A chunk takes the pending ids of a window of ``chunk`` ids; the next window starts after the last id
    taken, an empty window is skipped whole, and configurations rotate. Where a window starts depends on
    the one before, but a start can enter an id page at only ``chunk`` offsets. So each page of ``page`` ids works out
    where every possible entry leaves it (in parallel), these maps are composed by doubling, and
    each page then emits its chunks from its known entry. ``cases`` is read three times, so pass a stored table.
    """
    if chunk <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= start_config < len(configs):
        raise ValueError("start_config is outside the configurations")
    spark = cases.sparkSession
    pending = cases.where("status = 'pending'").select("case_id")
    span = pending.agg(F.min("case_id").alias("a"), F.max("case_id").alias("b")).first()
    schema = "chunk bigint, first_id bigint, last_id bigint, case_ids array<bigint>, config string"
    if span.a is None:
        return spark.createDataFrame([], schema)
    origin, page = span.a, max(page, chunk)
    pages = (span.b - origin) // page + 1
    rel = F.col("case_id") - origin
    own = F.floor(rel / page)
    ahead = F.when((rel % page < chunk - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    paged = pending.withColumn("page", F.explode(ahead))
    maps = materialize(page_maps(paged, origin, chunk, page, pages), "page-maps")
    entries = page_entries(maps, pages)
    labels = list(configs)

    def emit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(key[0])
        ids = np.sort(pdf["case_id"].to_numpy())
        hi = origin + (p + 1) * page - 1
        begin, after, leave = (a.tolist() for a in _steps(ids, ids + 1, hi, chunk))
        i, j, x = (int(a[0]) for a in _steps(ids, np.array([origin + p * page + int(pdf["entry"].iloc[0])]), hi, chunk))
        got = []
        while x < 0:
            got.append((i, j))
            i, j, x = begin[j - 1], after[j - 1], leave[j - 1]
        first = int(pdf["done"].iloc[0])
        return pd.DataFrame(
            [(first + k, ids[i], ids[j - 1], ids[i:j].tolist(), labels[(start_config + first + k) % len(labels)])
             for k, (i, j) in enumerate(got)],
            columns=["chunk", "first_id", "last_id", "case_ids", "config"])

    out = paged.join(entries, "page").groupBy("page").applyInPandas(emit, schema)
    return out if max_chunks is None or max_chunks <= 0 else out.where(F.col("chunk") < max_chunks)


def chunk_lines(plan: DataFrame, cases: DataFrame) -> DataFrame:
    """One log line per chunk: ``run[case,case];run[case]``. A chunk is at most ``chunk`` cases."""
    long = plan.select("chunk", "config", "first_id", "last_id", F.explode("case_ids").alias("case_id"))
    j = long.join(cases.select("case_id", "run", "eq"), "case_id")
    per_run = j.groupBy("chunk", "config", "first_id", "last_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("case_id", "eq"))).alias("a"))
    item = F.concat("run", F.lit("["), F.array_join(F.transform("a", lambda s: s["eq"]), ","), F.lit("]"))
    g = per_run.select("chunk", "config", "first_id", "last_id", F.col("a")[0]["case_id"].alias("k"), item.alias("t"), F.size("a").alias("n"))
    g = g.groupBy("chunk", "config", "first_id", "last_id").agg(F.sum("n").alias("n_cases"), F.array_sort(F.collect_list(F.struct("k", "t"))).alias("b"))
    return g.select("chunk", "config", F.concat_ws("-", "first_id", "last_id").alias("array_range"), "n_cases",
                    F.array_join(F.transform("b", lambda s: s["t"]), ";").alias("runs"))


# --- verification --------------------------------------------------------------------------------------


@dataclass
class BatchMeta:
    """What a batch promised: parameters with inclusive ranges and integer flags, and the number of runs."""

    params: list[str]
    ranges: list[tuple[float, float] | None]
    integers: list[bool] = field(default_factory=list)
    n_runs: int = 0
    equilibrium: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        flags = self.integers or [False] * len(self.params)
        rows = [(p, *(r or (None, None)), bool(f)) for p, r, f in zip(self.params, self.ranges, flags)]
        return spark.createDataFrame(rows, "param string, lo double, hi double, is_int boolean")


def parse_parameters(lines: DataFrame, params: Sequence[str], by: Sequence[str] = ("run", "case")) -> DataFrame:
    """(by..., param, value): the first line that sets each parameter; text that is no number gives NULL.

    ``lines`` has (by..., line_no, line). The lines are shuffled by file first: files rarely share a task, so an aggregate before
    the shuffle would hold all that a task reads, however few tasks there are.
    """
    line = F.col("line")
    hits = F.array_compact(F.array(*[F.when(text.assigns(line, p), F.lit(p)) for p in params]))
    found = lines.where(line.contains("=")).select(*by, "line_no", text.assigned_number(line).alias("value"), F.explode(hits).alias("param"))
    return found.repartition(*by).groupBy(*by, "param").agg(F.min_by("value", "line_no").alias("value"))


def _value_problem(value: Column, lo: Column, hi: Column, is_int: Column) -> Column:
    return (
        F.when(value.isNull(), "not_found").when((value < lo) | (value > hi), "out_of_range")
        .when(is_int & (F.abs(value - F.bround(value)) > TOLERANCE), "not_integer"))


def _missing_runs(cases: DataFrame, run_dirs: DataFrame, n_runs: int) -> DataFrame:
    """Expected runs without a directory (error) or without cases (warning)."""
    spark = cases.sparkSession
    want = spark.range(1, n_runs + 1).select(F.concat(F.lit("run"), F.col("id")).alias("run"))
    none = F.lit(None).cast("string")
    absent = want.join(run_dirs.select("run").distinct(), "run", "left_anti").select("run", none.alias("case"), none.alias("param"), F.lit("error").alias("severity"), F.lit("run_missing").alias("kind"))
    empty = want.join(run_dirs.select("run").distinct(), "run", "left_semi").join(cases.select("run").distinct(), "run", "left_anti")
    empty = empty.select("run", none.alias("case"), none.alias("param"), F.lit("warning").alias("severity"), F.lit("no_cases").alias("kind"))
    return absent.unionByName(empty)


def _spread(cases: DataFrame, meta: BatchMeta) -> DataFrame:
    """One row per case and parameter."""
    flags = meta.integers or [False] * len(meta.params)
    cells = F.array(*[
        F.struct(F.lit(p).alias("param"), F.lit(r[0] if r else None).cast("double").alias("lo"), F.lit(r[1] if r else None).cast("double").alias("hi"), F.lit(bool(f)).alias("is_int"))
        for p, r, f in zip(meta.params, meta.ranges, flags)])
    return cases.select("*", F.inline(cells))


def verify_set(run_dirs: DataFrame, cases: DataFrame, lines: DataFrame, meta: BatchMeta) -> DataFrame:
    """Findings (run, case, param, severity, kind) of a batch whose cases share their run's parameters.

    ``run_dirs``: (run); ``cases``: (run, case, has_input); ``lines``: (run, case, line_no, line). The first
    case of a run is checked against the ranges, the others against the first.
    """
    wanted = cases.where(natural(F.col("run")).between(1, meta.n_runs)).repartition("run", "case")  # the aggregate sorts what a task reads
    first = wanted.groupBy("run").agg(F.min("case").alias("first"), F.min_by("has_input", "case").alias("first_ok"))
    tagged = join_on(wanted, first, ["run"], "inner")
    none = F.lit(None).cast("string")
    lost = tagged.where(~F.col("has_input") & ((F.col("case") == F.col("first")) | F.col("first_ok"))).select(
        "run", "case", none.alias("param"), F.lit("error").alias("severity"), F.lit("input_missing").alias("kind"))
    values = parse_parameters(lines, meta.params)
    cells = join_on(_spread(tagged.where("has_input AND first_ok"), meta), values, ["run", "case", "param"], "left")
    is_first = F.col("case") == F.col("first")
    lead = cells.where(is_first).select("run", "param", F.col("value").alias("expected"))
    both = join_on(cells, lead, ["run", "param"], "left")
    v, e = F.col("value"), F.col("expected")
    lead_problem = F.when(v.isNull(), "not_found").when(F.col("lo").isNotNull(), _value_problem(v, F.col("lo"), F.col("hi"), F.col("is_int")))
    other = F.when(e.isNotNull(), F.when(v.isNull(), "not_found").when(F.abs(v - e) > TOLERANCE, "differs_from_first").when(
        F.col("is_int") & (F.abs(v - F.bround(v)) > TOLERANCE), "not_integer"))
    bad = both.withColumn("kind", F.when(is_first, lead_problem).otherwise(other)).where("kind IS NOT NULL")
    bad = bad.select("run", "case", "param", F.lit("error").alias("severity"), "kind")
    return _missing_runs(wanted, run_dirs, meta.n_runs).unionByName(lost).unionByName(bad)


def verify_fixed(run_dirs: DataFrame, cases: DataFrame, lines: DataFrame, meta: BatchMeta) -> DataFrame:
    """Findings of a batch with one case per run: count and name of the case (warnings), then its parameters."""
    wanted = cases.where(natural(F.col("run")).between(1, meta.n_runs)).repartition("run", "case")  # the aggregate sorts what a task reads
    first = wanted.groupBy("run").agg(F.min("case").alias("case"), F.count(F.lit(1)).alias("n"), F.min_by("has_input", "case").alias("has_input"))
    none = F.lit(None).cast("string")

    def note(rows: DataFrame, severity: str, kind: str) -> DataFrame:
        return rows.select("run", "case", none.alias("param"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"))

    out = _missing_runs(wanted, run_dirs, meta.n_runs).unionByName(note(first.where("n <> 1"), "warning", "case_count"))
    if meta.equilibrium:
        out = out.unionByName(note(first.where(F.col("case") != meta.equilibrium), "warning", "case_name"))
    out = out.unionByName(note(first.where(~F.col("has_input")), "error", "input_missing"))
    cells = join_on(_spread(first.where("has_input"), meta), parse_parameters(lines, meta.params), ["run", "case", "param"], "left")
    kind = _value_problem(F.col("value"), F.col("lo"), F.col("hi"), F.col("is_int"))
    return out.unionByName(cells.withColumn("kind", kind).where("kind IS NOT NULL").select("run", "case", "param", F.lit("error").alias("severity"), "kind"))


def verdict(findings: DataFrame) -> DataFrame:
    """Errors, warnings and the verdict."""
    g = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return g.withColumn("verdict", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "pass with warnings").otherwise("pass"))


def siblings_differ(values: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Cases whose parameter differs from the first case of their run: (run, case, param, value, expected)."""
    lead = values.groupBy("run", "param").agg(F.min_by("value", "case").alias("expected"))
    j = join_on(values, lead, ["run", "param"], "inner")
    return j.where(F.abs(F.col("value") - F.col("expected")) > tolerance).select("run", "case", "param", "value", "expected")


def missing_parameters(cases: DataFrame, values: DataFrame, params: Sequence[str]) -> DataFrame:
    """(run, case, param) expected but not parsed."""
    want = cases.select("run", "case", F.explode(F.array(*[F.lit(p) for p in params])).alias("param"))
    return want.join(values.where("value IS NOT NULL").select("run", "case", "param"), ["run", "case", "param"], "left_anti")

