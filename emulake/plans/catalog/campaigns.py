"""Designs, campaign catalogue, chunk plans, reports and verification, on tables made from orders and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulake.functions import text, times
from emulake.operators import campaign, design
from emulake.plans.catalog.base import S, register, sig, sig_all, table
from emulake.session import materialize

# --- a campaign: each order is a case of run 1..40 --------------------------------------------------------

STAT = """CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'pending' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'inflight' ELSE 'started' END END"""
SNAP = f"""snap AS (SELECT row_number() OVER (ORDER BY o_custkey % 40 + 1, o_orderkey) AS case_id, 'run' || (o_custkey % 40 + 1) AS run, 'sparc_' || o_orderkey AS eq,
  {STAT} AS status, epoch(o_orderdate)::BIGINT AS started_ts, CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate)::BIGINT + o_totalprice::BIGINT END AS finished_ts FROM orders)"""


def snapshot(spark, sf):
    o = table(spark, sf, "orders")
    run = F.col("o_custkey") % 40 + 1
    st = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "pending").when(
        F.col("o_orderkey") % 3 == 0, "inflight").otherwise("started")
    t0 = times.epoch_of(F.col("o_orderdate"))
    rows = o.select(F.concat(F.lit("run"), run).alias("run"), F.concat(F.lit("sparc_"), F.col("o_orderkey")).alias("case"), st.alias("status"),
                    t0.alias("started_ts"), F.when(F.col("o_orderstatus") == "F", t0 + F.bround("o_totalprice").cast("bigint")).alias("finished_ts"))
    return materialize(campaign.number_cases(rows).withColumnRenamed("case", "eq"), "snapshot")


def listing(spark, sf):
    """A file listing of the campaign: an input per case, and the marker files its state implies."""
    o = table(spark, sf, "orders")
    base = F.concat(F.lit("/batch/run"), F.col("o_custkey") % 40 + 1, F.lit("/sparc_"), F.col("o_orderkey"), F.lit("/"))
    k = F.col("o_orderkey")
    t0 = times.epoch_of(F.col("o_orderdate"))
    files = F.array_compact(F.array(
        F.struct(F.concat(base, F.lit("C1input")).alias("path"), F.lit(10).cast("bigint").alias("length"), t0.alias("mtime")),
        F.when(F.col("o_orderstatus") != "P", F.struct(F.concat(base, F.lit("started")).alias("path"), F.lit(0).cast("bigint").alias("length"), t0.alias("mtime"))),
        F.when(F.col("o_orderstatus") == "F", F.struct(F.concat(base, F.lit("finished")).alias("path"), F.lit(0).cast("bigint").alias("length"), (t0 + 60).alias("mtime"))),
        F.when(k % 11 == 0, F.struct(F.concat(base, F.lit("C1.h5")).alias("path"), F.when(k % 2 == 0, 5).otherwise(0).cast("bigint").alias("length"), t0.alias("mtime"))),
        F.when(k % 7 == 0, F.struct(F.concat(base, F.lit("queued")).alias("path"), F.lit(0).cast("bigint").alias("length"), t0.alias("mtime")))))
    return o.select(F.inline(files))


QUEUE = "q AS (SELECT case_id FROM snap WHERE case_id % 5 = 0)"


def queue(spark, sf):
    n = table(spark, sf, "orders").count()
    return spark.range(5, n + 1, 5).withColumnRenamed("id", "case_id")


@register("s9_case_catalogue", f"""WITH {SNAP}, o AS (SELECT 'sparc_' || o_orderkey AS eq, o_orderkey AS k, o_orderstatus AS s, epoch(o_orderdate)::BIGINT AS t FROM orders)
 SELECT case_id, run, snap.eq, CASE WHEN s = 'F' OR (k % 11 = 0 AND k % 2 = 0) THEN 'finished' WHEN case_id % 5 = 0 THEN 'inflight' WHEN s <> 'P' THEN 'started' ELSE 'pending' END AS status,
 CASE WHEN s <> 'P' THEN t END AS started_ts, CASE WHEN s = 'F' THEN t + 60 END AS finished_ts FROM snap JOIN o USING (eq)""")
def _(spark, sf):
    return campaign.scan_cases(listing(spark, sf), queue(spark, sf))


@register("a37_marker_status", f"""WITH m AS (SELECT 'run' || (o_custkey % 40 + 1) AS run, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 11 = 0 THEN 'finished' WHEN o_orderkey % 7 = 0 THEN 'queued' ELSE 'pending' END AS s FROM orders),
 c AS (SELECT run, count(*) AS total, count(*) FILTER (s = 'finished') AS finished, count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'pending') AS pending FROM m GROUP BY 1)
 SELECT *, printf('%.1f%%', finished * 100.0::DOUBLE / total) AS finished_pct, printf('%.1f%%', queued * 100.0::DOUBLE / total) AS queued_pct, printf('%.1f%%', pending * 100.0::DOUBLE / total) AS pending_pct FROM c""")
def _(spark, sf):
    return campaign.run_marker_status(listing(spark, sf))


@register("a37_marker_lists", """SELECT 'run' || (o_custkey % 40 + 1) AS run, 'sparc_' || o_orderkey AS "case", CASE WHEN o_orderkey % 7 = 0 THEN 'queued' ELSE 'pending' END AS status
 FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 11 <> 0""")
def _(spark, sf):
    return campaign.case_marker_status(listing(spark, sf)).where("status <> 'finished'")


@register("s8_parse_case_paths", "SELECT 'run' || (o_custkey % 40 + 1) AS run, 'sparc_' || o_orderkey AS \"case\" FROM orders")
def _(spark, sf):
    f = campaign.parse_paths(listing(spark, sf))
    return f.where("leaf = 'C1input'").select("run", "case")


@register("w7_number_cases", f"WITH {SNAP} SELECT case_id, run, eq FROM snap")
def _(spark, sf):
    return snapshot(spark, sf).select("case_id", "run", "eq")


@register("a24_status_counts", f"WITH {SNAP} SELECT status, count(*) AS n FROM snap GROUP BY 1")
def _(spark, sf):
    return campaign.status_counts(snapshot(spark, sf))


BYRUN = """br AS (SELECT run, count(*) FILTER (status = 'finished') AS finished, count(*) FILTER (status = 'inflight') AS inflight, count(*) FILTER (status = 'started') AS started,
 count(*) FILTER (status = 'pending') AS pending FROM snap GROUP BY 1), brr AS (SELECT *, pending + started + inflight AS remaining FROM br)"""


@register("a25_status_by_run", f"WITH {SNAP}, {BYRUN} SELECT * FROM brr")
def _(spark, sf):
    return campaign.status_by_run(snapshot(spark, sf))


@register("k2_top_runs", f"WITH {SNAP}, {BYRUN} SELECT run, remaining FROM brr ORDER BY remaining DESC, run LIMIT 10")
def _(spark, sf):
    return campaign.top_runs(campaign.status_by_run(snapshot(spark, sf)), 10).select("run", "remaining")


def _hms(x):
    return f"printf('%02d:%02d:%02d', ({x}) // 3600, ({x}) % 3600 // 60, ({x}) % 60)"


@register("a26_runtime_stats", f"""WITH {SNAP}, d AS (SELECT finished_ts - started_ts AS d, finished_ts FROM snap WHERE finished_ts > started_ts AND started_ts <> 0)
 SELECT count(*) AS n, {S('avg(d)')} AS avg_s, min(d) AS min_s, max(d) AS max_s, {_hms('floor(avg(d))::BIGINT')} AS avg, {_hms('min(d)')} AS min, {_hms('max(d)')} AS max,
 strftime(make_timestamp(max(finished_ts) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS last_finish FROM d""")
def _(spark, sf):
    return sig_all(campaign.runtime_stats(snapshot(spark, sf)), "avg_s")


@register("w8_throughput", f"""WITH {SNAP}, d AS (SELECT finished_ts FROM snap WHERE finished_ts > started_ts AND started_ts <> 0)
 SELECT count(*) AS n_recent, count(*) / 6.0::DOUBLE AS per_hour FROM d WHERE finished_ts >= (SELECT max(finished_ts) FROM d) - 21600""")
def _(spark, sf):
    return campaign.throughput(snapshot(spark, sf))


COMPLETE = f"""cp AS (SELECT run, count(*) AS n_cases, bool_and(status = 'finished' OR run IN ('run3', 'run8')) AS completed, count(q.case_id) AS n_queued FROM snap LEFT JOIN q USING (case_id) GROUP BY 1)"""


@register("a27_campaign_summary", f"""WITH {SNAP}, {QUEUE}, {COMPLETE}, g AS (SELECT count(*) AS total_runs, count(*) FILTER (completed) AS completed_runs, count(*) FILTER (n_queued > 0) AS queued_runs,
 sum(n_cases)::BIGINT AS total_cases, coalesce(sum(n_cases) FILTER (completed), 0)::BIGINT AS completed_cases, sum(n_queued)::BIGINT AS queued_cases FROM cp)
 SELECT *, greatest(total_runs - completed_runs - queued_runs, 0) AS remaining_runs, printf('%.1f%%', completed_runs * 100.0::DOUBLE / total_runs) AS completed_pct FROM g""")
def _(spark, sf):
    s = snapshot(spark, sf).withColumn("status", F.when(F.col("run").isin("run3", "run8"), "finished").otherwise(F.col("status")))
    return campaign.campaign_summary(campaign.run_completion(s, queue(spark, sf)))


@register("j6_runs_with_queued", f"WITH {SNAP} SELECT DISTINCT run FROM snap WHERE case_id % 500 = 0")
def _(spark, sf):
    q = queue(spark, sf).where("case_id % 500 = 0")
    return campaign.runs_with_queued(snapshot(spark, sf), q)


@register("w6_id_ranges", """WITH i AS (SELECT o_orderstatus AS grp, o_orderkey AS id, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders)
 SELECT grp, min(id) AS lo, max(id) AS hi FROM i GROUP BY grp, k""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("id"))
    return campaign.id_ranges(o, ["grp"], page=100)


@register("w6_range_text", """WITH i AS (SELECT o_orderkey AS id, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'),
 r AS (SELECT min(id) AS lo, max(id) AS hi FROM i GROUP BY k)
 SELECT lo // 1000 AS line, string_agg(CASE WHEN lo = hi THEN lo || '' ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ids FROM r GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.lit("all").alias("grp"), F.col("o_orderkey").alias("id"))
    return campaign.range_lines(campaign.id_ranges(o, ["grp"]), ["grp"], 1000).select("line", "ids")


@register("w11_cases_by_run", f"WITH {SNAP} SELECT run, case_id // 100 AS page, string_agg(eq, ',' ORDER BY case_id) AS cases FROM snap GROUP BY 1, 2")
def _(spark, sf):
    return campaign.cases_by_run(snapshot(spark, sf), 100).withColumn("cases", F.array_join("cases", ","))


WALK = f"""pend AS (SELECT case_id AS id FROM snap WHERE status = 'pending'),
 nx AS (SELECT id, lead(id) OVER (ORDER BY id) AS q FROM pend),
 wn AS (SELECT id, q, id + 1 + 12 * ((q - id - 1) // 12) AS w FROM nx WHERE q IS NOT NULL UNION ALL SELECT min(id) - 1, min(id), min(id) FROM pend),
 st AS (SELECT wn.id, wn.q, wn.w, p.id AS last FROM wn ASOF JOIN pend p ON wn.w + 11 >= p.id),
 walk AS (SELECT 0::BIGINT AS chunk, q AS first_id, last, w FROM st WHERE id = (SELECT min(id) - 1 FROM pend)
   UNION ALL SELECT chunk + 1, st.q, st.last, st.w FROM walk JOIN st ON st.id = walk.last)"""


@register("w5_chunk_plan", f"""WITH RECURSIVE {SNAP}, {WALK}
 SELECT chunk, first_id, last AS last_id, count(*) AS n_cases, sum(pend.id)::BIGINT AS id_sum, ['small', 'wide', 'long'][(chunk + 1) % 3 + 1] AS config
 FROM walk JOIN pend ON pend.id BETWEEN first_id AND last GROUP BY ALL""")
def _(spark, sf):
    plan = campaign.plan_chunks(snapshot(spark, sf), 12, ["small", "wide", "long"], start_config=1, page=1000)
    total = F.aggregate("case_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return plan.select("chunk", "first_id", "last_id", F.size("case_ids").cast("bigint").alias("n_cases"), total.alias("id_sum"), "config")


@register("r3_chunk_lines", f"""WITH RECURSIVE {SNAP}, {WALK}, m AS (SELECT chunk, first_id, last, pend.id, run, eq FROM walk JOIN pend ON pend.id BETWEEN first_id AND last JOIN snap ON case_id = pend.id),
 g AS (SELECT chunk, first_id, last, run, min(id) AS k, count(*) AS n, run || '[' || string_agg(eq, ',' ORDER BY id) || ']' AS t FROM m GROUP BY 1, 2, 3, 4)
 SELECT chunk, first_id || '-' || last AS array_range, sum(n)::BIGINT AS n_cases, string_agg(t, ';' ORDER BY k) AS runs FROM g GROUP BY 1, first_id, last""")
def _(spark, sf):
    s = snapshot(spark, sf)
    plan = campaign.plan_chunks(s, 12, ["small"], page=1000)
    return campaign.chunk_lines(plan, s).select("chunk", "array_range", "n_cases", "runs")


@register("e5_campaign_report", f"""WITH {SNAP}, {QUEUE}, {BYRUN}, d AS (SELECT finished_ts - started_ts AS d FROM snap WHERE finished_ts > started_ts),
 t AS (SELECT finished_ts FROM snap WHERE finished_ts > started_ts AND started_ts <> 0),
 cp AS (SELECT run, count(*) AS n_cases, bool_and(status = 'finished') AS completed, count(q.case_id) AS n_queued FROM snap LEFT JOIN q USING (case_id) GROUP BY 1),
 g AS (SELECT count(*) AS total_runs, count(*) FILTER (completed) AS completed_runs, count(*) FILTER (n_queued > 0) AS queued_runs, sum(n_cases) AS total_cases,
  coalesce(sum(n_cases) FILTER (completed), 0) AS completed_cases, sum(n_queued) AS queued_cases, greatest(count(*) - count(*) FILTER (completed) - count(*) FILTER (n_queued > 0), 0) AS remaining_runs FROM cp)
 SELECT 'status' AS section, status AS name, count(*)::DOUBLE AS value FROM snap GROUP BY 2
 UNION ALL SELECT 'remaining', run, remaining::DOUBLE FROM brr
 UNION ALL SELECT 'runtime', 'avg_s', {S('avg(d)')} FROM d UNION ALL SELECT 'runtime', 'min_s', min(d)::DOUBLE FROM d UNION ALL SELECT 'runtime', 'max_s', max(d)::DOUBLE FROM d
 UNION ALL SELECT 'throughput', 'per_hour', count(*) / 6.0::DOUBLE FROM t WHERE finished_ts >= (SELECT max(finished_ts) FROM t) - 21600
 {''.join(f"UNION ALL SELECT 'summary', '{c}', {c}::DOUBLE FROM g " for c in ('total_runs', 'completed_runs', 'queued_runs', 'total_cases', 'completed_cases', 'queued_cases', 'remaining_runs'))}""")
def _(spark, sf):
    from emulake.plans.reports import campaign_report

    r = campaign_report(snapshot(spark, sf), queue(spark, sf))
    return r.select("section", "name", F.when(F.col("name") == "avg_s", sig("value")).otherwise(F.col("value")).alias("value"))


# --- text rules ----------------------------------------------------------------------------------------


@register("x3_slug", """SELECT p_partkey, coalesce(nullif(left(regexp_replace(p_name || '/' || p_brand || ' (' || p_type || ')', '[^a-zA-Z0-9_.-]+', '_', 'g'), 120), ''), 'model') AS slug FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat("p_name", F.lit("/"), "p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return p.select("p_partkey", text.slug(name).alias("slug"))


@register("x4_queued_ids", """SELECT DISTINCT unnest(range(p_partkey, p_partkey + p_size % 4 + 1)) AS case_id FROM part UNION SELECT p_partkey + 50000 FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    line = F.concat(F.lit("["), k.cast("string"), F.lit("-"), (k + F.col("p_size") % 4).cast("string"), F.lit(","), (k + 50000).cast("string"), F.lit("%4,x-y,9-2]"))
    return campaign.queued_ids(p.select(line.alias("line"))).select("case_id")


@register("x5_names_from_files", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, 'forest_' || o_custkey AS model FROM orders")
def _(spark, sf):
    from emulake.sources.artifacts import file_model, file_split

    o = table(spark, sf, "orders")
    split = F.when(F.col("o_orderkey") % 3 == 0, "train").when(F.col("o_orderkey") % 3 == 1, "val").otherwise("test")
    f = o.select("o_orderkey", F.concat(F.lit("/r/predictions/forest_"), F.col("o_custkey").cast("string"), F.lit("_"), split, F.lit(".parquet")).alias("f"))
    return f.select("o_orderkey", file_split(F.col("f")).alias("split"), file_model(F.col("f")).alias("model"))


@register("x6_duration_percent", f"SELECT o_orderkey, {_hms('floor(o_totalprice)::BIGINT')} AS hms, printf('%.1f%%', o_custkey * 100.0::DOUBLE / 1501) AS pct FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", text.duration(F.floor("o_totalprice")).alias("hms"), text.percent(F.col("o_custkey"), F.lit(1501)).alias("pct"))


@register("x15_iso_time", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", times.iso_time(times.epoch_of(F.col("o_orderdate"))).alias("iso"))


# --- designs ------------------------------------------------------------------------------------------

PARAMS = [design.Param("ntor", 1, 10, integer=True), design.Param("pscale", 0.5, 2.0), design.Param("freq", 1.0, 100.0, log=True)]


def _u(seed, *parts):
    return f"(('0x' || left(md5(concat_ws('|', {seed}, {', '.join(parts)})), 13))::BIGINT / 4503599627370496::DOUBLE)"


def _vals(u_of):
    return f"""round_even({u_of('ntor')} * 9 + 1, 0)::DOUBLE AS ntor, {S(u_of('pscale') + ' * 1.5 + 0.5')} AS pscale, {S('exp(' + u_of('freq') + ' * ln(100.0::DOUBLE))')} AS freq"""


@register("g1_random_draws", f"SELECT o_orderkey, {_vals(lambda d: _u(7, repr(d), 'o_orderkey'))} FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return sig_all(design.draws(o, PARAMS, 7, ("o_orderkey",)), "pscale", "freq")


@register("g2_latin_hypercube", f"""WITH n AS (SELECT count(*) AS n FROM part), d AS (SELECT unnest(['ntor', 'pscale', 'freq']) AS dim),
 r AS (SELECT p_partkey, dim, row_number() OVER (PARTITION BY dim ORDER BY md5(concat_ws('|', 11, dim, p_partkey))) AS st FROM part, d),
 u AS (SELECT p_partkey, dim, (st - 1 + {_u(12, 'dim', 'p_partkey')}) / (SELECT n FROM n) AS u FROM r),
 w AS (SELECT p_partkey, max(u) FILTER (dim = 'ntor') AS a, max(u) FILTER (dim = 'pscale') AS b, max(u) FILTER (dim = 'freq') AS c FROM u GROUP BY 1)
 SELECT p_partkey, {_vals(lambda d: dict(ntor='a', pscale='b', freq='c')[d])} FROM w""")
def _(spark, sf):
    return sig_all(design.latin_draws(table(spark, sf, "part").select("p_partkey"), PARAMS, 11, ["p_partkey"]), "pscale", "freq")


def _case_names(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_name").alias("case"))


for _mode, _cases, _path in (
    ("set", "(SELECT s_name AS c FROM supplier)", "'run' || i || '/' || c"),
    ("fixed", "(SELECT min(s_name) AS c FROM supplier)", "'run' || i || '/' || c"),
    ("per_case", "(SELECT s_name AS c FROM supplier)", "c || '/run' || i"),
):
    @register(f"j9_expand_runs_{_mode}", f"SELECT 'run' || i AS run, c AS \"case\", {_path} AS path, {_vals(lambda d: _u(7, repr(d), 'i'))} FROM {_cases}, (SELECT unnest(range(1, 21)) AS i)")
    def _(spark, sf, mode=_mode):
        samples = design.random_design(spark, 20, PARAMS, 7)
        r = design.expand_runs(_case_names(spark, sf), samples, 20, mode)
        return sig_all(r, "pscale", "freq").select("run", "case", "path", "ntor", "pscale", "freq")


@register("j9_random_runs", f"SELECT s_name AS \"case\", i AS sample, {_vals(lambda d: _u(7, repr(d), 'i'))} FROM supplier, (SELECT unnest(range(1, 31)) AS i)")
def _(spark, sf):
    """Runs of each case with draws that depend on the run alone: no table of samples, no join."""
    return sig_all(design.per_case_samples(_case_names(spark, sf), 30, PARAMS, 7), "pscale", "freq")


LEVELS = {"ntor": [1, 2, 3], "pscale": [0.5, 1.0, 1.5, 2.0], "rotation": [0, 1]}


@register("g1_grid_runs", """SELECT s_name AS "case", run, [1.0, 2.0, 3.0][run // 8 + 1]::DOUBLE AS ntor, [0.5, 1.0, 1.5, 2.0][run // 2 % 4 + 1]::DOUBLE AS pscale, [0.0, 1.0][run % 2 + 1]::DOUBLE AS rotation
 FROM supplier, (SELECT unnest(range(24)) AS run)""")
def _(spark, sf):
    """Every supplier's case with all 24 combinations of levels."""
    return design.grid_runs(_case_names(spark, sf), LEVELS)


@register("x13_log_map", f"SELECT event_id, {S('exp((value - floor(value)) * (ln(50.0::DOUBLE) - ln(0.5::DOUBLE)) + ln(0.5::DOUBLE))')} AS x, round_even((value - floor(value)) * 20, 0)::DOUBLE AS k FROM events")
def _(spark, sf):
    u = F.col("value") - F.floor("value")
    e = table(spark, sf, "events")
    return e.select("event_id", sig(design.Param("x", 0.5, 50.0, log=True).value(u)).alias("x"), design.Param("k", 0, 20, integer=True).value(u).alias("k"))


TEMPLATE_PARAMS = ["ntor", "pscale"]


def template(spark, sf):
    """Input lines per supplier case, with near-miss names and comments."""
    k = F.col("s_suppkey").cast("string")
    rows = F.array(*[F.lit(x) for x in ("&inputnl", " ntor = 3 ! toroidal mode", " ntor_max = 9", " pscale=1.5#scale", " note: pscale of run", " x.pscale = 2", "/")])
    return table(spark, sf, "supplier").select(F.col("s_name").alias("case"), F.posexplode(rows).alias("line_no", "line")).withColumn(
        "line", F.when(F.col("line_no") == 0, F.concat(F.col("line"), F.lit(" "), F.col("case"))).otherwise(F.col("line"))).select("case", "line_no", "line")


@register("x2_render_inputs", f"""WITH s AS (SELECT i AS sample, round_even({_u(7, "'ntor'", 'i')} * 9 + 1, 0)::BIGINT AS ntor, i / 4.0::DOUBLE AS pscale FROM (SELECT unnest(range(1, 6)) AS i)),
 t AS (SELECT s_name AS c, unnest([0, 1, 2, 3, 4, 5, 6]) AS line_no FROM supplier)
 SELECT 'run' || sample AS run, c AS "case", line_no::INTEGER AS line_no, CASE line_no WHEN 0 THEN '&inputnl ' || c WHEN 1 THEN 'ntor = ' || ntor WHEN 2 THEN ' ntor_max = 9'
   WHEN 3 THEN 'pscale = ' || (CASE WHEN pscale = floor(pscale) THEN pscale::BIGINT || '' ELSE pscale || '' END) WHEN 4 THEN ' note: pscale of run'
   WHEN 5 THEN 'x.pscale = ' || (CASE WHEN pscale = floor(pscale) THEN pscale::BIGINT || '' ELSE pscale || '' END) ELSE '/' END AS line FROM t, s""")
def _(spark, sf):
    samples = design.random_design(spark, 5, PARAMS[:1], 7).withColumn("pscale", F.col("sample") / 4)
    runs = design.expand_runs(_case_names(spark, sf), samples, 5, "set")
    return design.render_inputs(template(spark, sf), runs, TEMPLATE_PARAMS)


@register("x2_unset_parameters", "SELECT s_name AS \"case\", 'qscale' AS param FROM supplier")
def _(spark, sf):
    return design.unset_parameters(template(spark, sf), [*TEMPLATE_PARAMS, "qscale"])


@register("g3_rendered_files", "SELECT 'run' || i AS run, s_name AS \"case\", 7::BIGINT AS n_lines FROM supplier, (SELECT unnest(range(1, 6)) AS i)")
def _(spark, sf):
    samples = design.random_design(spark, 5, PARAMS[:2], 7)
    runs = design.expand_runs(_case_names(spark, sf), samples, 5, "set")
    t = design.rendered_text(design.render_inputs(template(spark, sf), runs, TEMPLATE_PARAMS))
    return t.select("run", "case", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))


SPACE = {
    "n_estimators": {"type": "int", "low": 50, "high": 300, "step": 50},
    "lr": {"type": "loguniform", "low": 1e-4, "high": 1e-1},
    "dropout": {"type": "float", "low": 0.0, "high": 0.5},
    "act": {"type": "categorical", "choices": ["relu", "tanh", [1, 2]]},
    "hidden_layers": {"type": "variable_list", "num_layers": {"low": 1, "high": 3}, "element": {"type": "logint", "low": 16, "high": 256, "step": 16}},
}


def _trials(spark, sf):
    return design.sample_rows(table(spark, sf, "customer").select(F.col("c_custkey").alias("number")), SPACE, 5)


def _el(i):
    x = f"exp({_u(5, repr(f'hidden_layers_{i}'), 'number')} * (ln(256.0::DOUBLE) - ln(16.0::DOUBLE)) + ln(16.0::DOUBLE))"
    return f"greatest(least(round_even({x} / 16, 0) * 16, 256), 16)::BIGINT"


TRIALS = f"""t AS (SELECT c_custkey AS number FROM customer), v AS (SELECT number, 50 + floor({_u(5, "'n_estimators'", 'number')} * 6)::BIGINT * 50 AS n_estimators,
 exp({_u(5, "'lr'", 'number')} * (ln(0.1::DOUBLE) - ln(0.0001::DOUBLE)) + ln(0.0001::DOUBLE)) AS lr, {_u(5, "'dropout'", 'number')} * 0.5 AS dropout,
 ['"relu"', '"tanh"', '[1, 2]'][floor({_u(5, "'act'", 'number')} * 3)::BIGINT + 1] AS act, 1 + floor({_u(5, "'hidden_layers_num_layers'", 'number')} * 3)::BIGINT AS nl,
 {_el(0)} AS h0, {_el(1)} AS h1, {_el(2)} AS h2 FROM t)"""


@register("g4_sample_space", f"WITH {TRIALS} SELECT number, n_estimators, {S('lr')} AS lr, {S('dropout')} AS dropout, act, array_to_string([h0, h1, h2][1:nl], ',') AS layers FROM v")
def _(spark, sf):
    t = _trials(spark, sf)
    return sig_all(t, "lr", "dropout").select("number", "n_estimators", "lr", "dropout", "act", F.array_join(F.col("hidden_layers").cast("array<string>"), ",").alias("layers"))


@register("x14_architecture", f"WITH {TRIALS} SELECT number, nl::INTEGER AS num_hidden_layers, array_to_string([h0, h1, h2][1:nl], ',') AS layers FROM v")
def _(spark, sf):
    a = design.architecture(_trials(spark, sf).select("number", "params"))
    return a.select("number", "num_hidden_layers", F.array_join(F.col("hidden_layers").cast("array<string>"), ",").alias("layers"))


# --- verification --------------------------------------------------------------------------------------
# run = part key modulo 60 (+1), of which 1..58 are expected; values come from the run, with planted errors.

META = campaign.BatchMeta(["ntor", "pscale", "bscale"], [(1, 10), (0.5, 2.0), None], [True, False, False], 62)


def _vcases(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    r = k % 60 + 1
    c = p.select(F.concat(F.lit("run"), r).alias("run"), F.concat(F.lit("sparc_"), F.lpad(k.cast("string"), 8, "0")).alias("case"), (k % 97 != 5).alias("has_input"), k.alias("k"), r.alias("r"))
    ntor = F.when(F.col("k") % 89 == 3, F.lit("2.5")).when(F.col("r") == 7, F.lit("99")).otherwise((F.col("r") % 10 + 1).cast("string"))
    pscale = F.when(F.col("k") % 83 == 4, F.lit("abc")).otherwise(F.lit("1.5"))
    lines = c.where("has_input").select("run", "case", F.posexplode(F.array_compact(F.array(
        F.concat(F.lit(" ntor = "), ntor, F.lit(" ! comment")), F.concat(F.lit("pscale="), pscale, F.lit(" # note")), F.lit("ntor_x = 7"),
        F.when(F.col("k") % 71 != 6, F.concat(F.lit("a.bscale = "), (F.col("r") * 0.5).cast("string"))), F.lit(" ntor = 55")))).alias("line_no", "line"))
    runs = c.select("run").distinct().unionByName(spark.createDataFrame([("run61",)], "run string"))
    return runs, c.select("run", "case", "has_input"), lines


VCASES = """vc AS (SELECT 'run' || (p_partkey % 60 + 1) AS run, p_partkey % 60 + 1 AS r, 'sparc_' || lpad(p_partkey || '', 8, '0') AS c, p_partkey AS k, p_partkey % 97 <> 5 AS ok FROM part),
 vv AS (SELECT *, CASE WHEN k % 89 = 3 THEN 2.5 WHEN r = 7 THEN 99 ELSE r % 10 + 1 END::DOUBLE AS ntor, CASE WHEN k % 83 = 4 THEN NULL ELSE 1.5 END::DOUBLE AS pscale, CASE WHEN k % 71 <> 6 THEN r * 0.5 END::DOUBLE AS bscale FROM vc)"""
LONGV = """lv AS (SELECT run, c, ok, 'ntor' AS param, ntor AS v, 1 AS lo, 10 AS hi, true AS is_int FROM vv UNION ALL SELECT run, c, ok, 'pscale', pscale, 0.5, 2.0, false FROM vv
   UNION ALL SELECT run, c, ok, 'bscale', bscale, NULL, NULL, false FROM vv)"""


@register("x1_parse_parameters", f"WITH {VCASES}, {LONGV} SELECT run, c AS \"case\", param, v AS value FROM lv WHERE ok AND NOT (param = 'bscale' AND v IS NULL)")
def _(spark, sf):
    _, _, lines = _vcases(spark, sf)
    return campaign.parse_parameters(lines, META.params)


@register("j7_siblings_differ", f"""WITH {VCASES}, {LONGV}, f AS (SELECT run, param, arg_min(v, c) AS e FROM lv WHERE ok AND v IS NOT NULL GROUP BY 1, 2)
 SELECT run, c AS "case", param, v AS value, e AS expected FROM lv JOIN f USING (run, param) WHERE ok AND v IS NOT NULL AND abs(v - e) > 1e-6""")
def _(spark, sf):
    _, _, lines = _vcases(spark, sf)
    return campaign.siblings_differ(campaign.parse_parameters(lines, META.params).where("value IS NOT NULL"))


@register("j8_missing_parameters", f"WITH {VCASES}, {LONGV} SELECT run, c AS \"case\", param FROM lv WHERE NOT ok OR v IS NULL")
def _(spark, sf):
    _, c, lines = _vcases(spark, sf)
    return campaign.missing_parameters(c, campaign.parse_parameters(lines, META.params), META.params)


FIND_SET = f"""{VCASES}, {LONGV}, f AS (SELECT run, min(c) AS fc, arg_min(ok, c) AS fok FROM vc GROUP BY 1),
 e AS (SELECT run, param, max(v) FILTER (c = fc) AS e FROM lv JOIN f USING (run) GROUP BY 1, 2),
 x AS (SELECT lv.*, c = fc AS lead, e.e FROM lv JOIN f USING (run) JOIN e USING (run, param) WHERE ok AND fok),
 fd AS (SELECT 'run62' AS run, NULL::VARCHAR AS "case", NULL::VARCHAR AS param, 'error' AS severity, 'run_missing' AS kind UNION ALL SELECT 'run61', NULL, NULL, 'warning', 'no_cases'
  UNION ALL SELECT run, c, NULL, 'error', 'input_missing' FROM vc JOIN f USING (run) WHERE NOT ok AND (c = fc OR fok)
  UNION ALL SELECT run, c, param, 'error', k FROM (SELECT run, c, param, CASE WHEN lead THEN CASE WHEN v IS NULL THEN 'not_found' WHEN lo IS NULL THEN NULL WHEN v < lo OR v > hi THEN 'out_of_range' WHEN is_int AND abs(v - round_even(v, 0)) > 1e-6 THEN 'not_integer' END
    WHEN e IS NULL THEN NULL WHEN v IS NULL THEN 'not_found' WHEN abs(v - e) > 1e-6 THEN 'differs_from_first' WHEN is_int AND abs(v - round_even(v, 0)) > 1e-6 THEN 'not_integer' END AS k FROM x) WHERE k IS NOT NULL)"""


@register("g5_verify_set", f"WITH {FIND_SET} SELECT * FROM fd")
def _(spark, sf):
    return campaign.verify_set(*_vcases(spark, sf), META)


@register("g5_verdict", f"WITH {FIND_SET}, g AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM fd) SELECT *, 'fail' AS verdict FROM g")
def _(spark, sf):
    return campaign.verdict(campaign.verify_set(*_vcases(spark, sf), META))


FIXED = campaign.BatchMeta(META.params, META.ranges, META.integers, 62, "sparc_00000003")


@register("g6_verify_fixed", f"""WITH {VCASES}, {LONGV}, f AS (SELECT run, min(c) AS fc, count(*) AS n, arg_min(ok, c) AS fok FROM vc GROUP BY 1)
 SELECT 'run62' AS run, NULL::VARCHAR AS "case", NULL::VARCHAR AS param, 'error' AS severity, 'run_missing' AS kind UNION ALL SELECT 'run61', NULL, NULL, 'warning', 'no_cases'
 UNION ALL SELECT run, fc, NULL, 'warning', 'case_count' FROM f WHERE n <> 1 UNION ALL SELECT run, fc, NULL, 'warning', 'case_name' FROM f WHERE fc <> 'sparc_00000003'
 UNION ALL SELECT run, fc, NULL, 'error', 'input_missing' FROM f WHERE NOT fok
 UNION ALL SELECT run, c, param, 'error', k FROM (SELECT lv.run, c, param, CASE WHEN v IS NULL THEN 'not_found' WHEN v < lo OR v > hi THEN 'out_of_range' WHEN is_int AND abs(v - round_even(v, 0)) > 1e-6 THEN 'not_integer' END AS k
   FROM lv JOIN f ON f.run = lv.run AND f.fc = lv.c WHERE ok) WHERE k IS NOT NULL""")
def _(spark, sf):
    return campaign.verify_fixed(*_vcases(spark, sf), FIXED)
