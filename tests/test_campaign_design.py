from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from emulake.functions import text
from emulake.operators import campaign, design
from emulake.sources import readers


def brute_chunks(pending: list[int], chunk: int) -> list[list[int]]:
    """The planning rule written as a plain loop."""
    if not pending:
        return []
    out, at, have, last = [], min(pending), set(pending), max(pending)
    while at <= last:
        got = [i for i in range(at, at + chunk) if i in have]
        if not got:
            at += chunk
            continue
        out.append(got)
        at = got[-1] + 1
    return out


@pytest.mark.parametrize("chunk,page,keep", [(3, 7, 2), (5, 5, 3), (4, 64, 5), (7, 10, 11), (1, 3, 2)])
def test_chunk_plan_equals_the_plain_loop(spark, chunk, page, keep):
    ids = [i for i in range(1, 200) if (i * 7919) % 13 % keep == 0 and not 60 < i < 110]
    cases = spark.range(1, 200).select(F.col("id").alias("case_id"), F.when(F.col("id").isin(*ids), "pending").otherwise("finished").alias("status"))
    plan = campaign.plan_chunks(cases, chunk, ["a", "b"], 1, page=page).orderBy("chunk").collect()
    assert [list(r.case_ids) for r in plan] == brute_chunks(ids, chunk)
    assert [r.chunk for r in plan] == list(range(len(plan)))
    assert [r.config for r in plan[:3]] == ["b", "a", "b"][: len(plan[:3])]


def test_chunk_plan_edges(spark):
    none = spark.createDataFrame([(1, "finished")], "case_id bigint, status string")
    assert campaign.plan_chunks(none, 5, ["a"]).count() == 0
    some = spark.range(1, 50).select(F.col("id").alias("case_id"), F.lit("pending").alias("status"))
    assert campaign.plan_chunks(some, 10, ["a"], max_chunks=2).count() == 2
    with pytest.raises(ValueError):
        campaign.plan_chunks(some, 0, ["a"])


def test_id_ranges_cross_pages(spark):
    ids = [1, 2, 3, 7, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 30]
    df = spark.createDataFrame([("g", i) for i in ids + ids], "g string, id bigint")
    got = sorted((r.lo, r.hi) for r in campaign.id_ranges(df, ["g"], page=5).collect())
    assert got == [(1, 3), (7, 7), (10, 21), (30, 30)]
    assert campaign.range_lines(campaign.id_ranges(df, ["g"]), ["g"]).first().ids == "1-3, 7, 10-21, 30"


def test_queue_lists(spark):
    lines = spark.createDataFrame([("[1-3,7%4]",), ("-",), (" 12 ",), ("9-8,x",)], "line string")
    assert sorted(r.case_id for r in campaign.queued_ids(lines).collect()) == [1, 2, 3, 7, 12]


def test_assignment_lines(spark):
    rows = [("ntor = 5 ! note", "ntor"), ("ntor_max = 9", "ntor"), ("a.ntor=3", "ntor"), ("x = ntor", "ntor"), ("ntor = 1.0d0", "ntor"), ("ntor = -2e-3#c", "ntor")]
    df = spark.createDataFrame(rows, "line string, name string")
    got = df.select(text.assigns(F.col("line"), "ntor").alias("hit"), text.assigned_number(F.col("line")).alias("v")).collect()
    assert [r.hit for r in got] == [True, False, True, False, True, True]
    assert got[0].v == 5.0 and got[4].v is None and got[5].v == -0.002


def test_percent_rounds_like_printf(spark):
    pairs = [(a, b) for b in (7, 16, 32, 40, 1501, 2000) for a in range(0, b + 1, max(1, b // 60))]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in df.select("a", "b", text.percent(F.col("a"), F.col("b")).alias("t")).collect():
        assert r.t == f"{100.0 * r.a / r.b:.1f}%"


def test_first_assignment_wins_even_when_it_is_no_number(spark):
    lines = spark.createDataFrame([("r", "c", 0, "p = oops"), ("r", "c", 1, "p = 4")], "run string, case string, line_no int, line string")
    assert campaign.parse_parameters(lines, ["p"]).first().value is None


def _tree(root) -> None:
    for run, case, leaves in (("run2", "sparc_1300", ["C1input", "finished"]), ("run2", "sparc_1301", ["C1input", "started"]),
                              ("run10", "sparc_2", ["C1input"]), ("run1", "sparc_9", ["C1input", "C1.h5"])):
        os.makedirs(root / run / case)
        for leaf in leaves:
            body = "ntor = 5\npscale = 1.0\nbatemanscale = 0.5\n" if leaf == "C1input" else ("data" if leaf == "C1.h5" else "")
            (root / run / case / leaf).write_text(body)


def test_catalogue_from_a_directory(spark, tmp_path):
    _tree(tmp_path)
    files = readers.list_files(spark, str(tmp_path))
    queued = spark.createDataFrame([(4,)], "case_id bigint")
    got = campaign.scan_cases(files, queued).orderBy("case_id").collect()
    assert [(r.run, r.eq, r.status) for r in got] == [
        ("run1", "sparc_9", "finished"), ("run2", "sparc_1300", "finished"), ("run2", "sparc_1301", "started"), ("run10", "sparc_2", "inflight")]
    assert got[1].finished_ts is not None and got[2].started_ts is not None
    found = readers.find_case_files(spark, str(tmp_path), "C1input", first_n=2).collect()
    assert [r.run for r in found] == ["run1", "run2"]


def test_verification_of_a_directory(spark, tmp_path):
    _tree(tmp_path)
    lines = readers.read_lines(spark, str(tmp_path / "run*" / "*" / "C1input"))
    cases = lines.select("run", "case").distinct().withColumn("has_input", F.lit(True))
    meta = campaign.BatchMeta(["ntor", "pscale"], [(1, 10), (0.5, 2.0)], [True, False], 2)
    good = campaign.verify_set(cases.select("run").distinct(), cases, lines, meta)
    assert campaign.verdict(good).first().verdict == "pass"
    strict = campaign.BatchMeta(["ntor", "missing"], [(6, 10), (0.0, 1.0)], [True, False], 3)
    kinds = {(r.run, r.kind) for r in campaign.verify_set(cases.select("run").distinct(), cases, lines, strict).collect()}
    assert ("run1", "out_of_range") in kinds and ("run1", "not_found") in kinds and ("run3", "run_missing") in kinds


PARAMS = [design.Param("ntor", 1, 10, integer=True), design.Param("pscale", 0.5, 2.0), design.Param("f", 1, 100, log=True)]


@pytest.mark.parametrize("method", ["lhs", "random"])
def test_designs_stay_in_bounds_and_repeat(spark, method):
    a = design.design(spark, 200, PARAMS, method, 3).orderBy("sample").collect()
    b = design.design(spark, 200, PARAMS, method, 3).orderBy("sample").collect()
    c = design.design(spark, 200, PARAMS, method, 4).orderBy("sample").collect()
    assert a == b and a != c
    assert all(1 <= r.ntor <= 10 and r.ntor == int(r.ntor) and 0.5 <= r.pscale <= 2 and 1 <= r.f <= 100 for r in a)
    assert sum(r.f < 10 for r in a) > 60  # half the log range lies below 10


def test_latin_design_has_one_point_per_stratum(spark):
    rows = design.latin_design(spark, 50, [design.Param("u", 0.0, 1.0), design.Param("v", 0.0, 1.0)], 1).collect()
    for name in ("u", "v"):
        assert sorted(int(r[name] * 50) for r in rows) == list(range(50))
    with pytest.raises(ValueError):
        design.design(spark, 5, PARAMS, "sobol")


def test_expansion_counts(spark):
    cases = spark.createDataFrame([("sparc_1300",), ("sparc_1301",)], "case string")
    s = design.random_design(spark, 3, PARAMS, 1)
    assert design.expand_runs(cases, s, 2, "set").count() == 4
    fixed = design.expand_runs(cases, s, 3, "fixed")
    assert fixed.count() == 3 and fixed.select("case").distinct().first()[0] == "sparc_1300"
    assert design.expand_runs(cases, s, 2, "per_case").select("path").distinct().count() == 4
    same = design.per_case_samples(cases, 2, PARAMS, 1).groupBy("sample").agg(F.countDistinct("pscale").alias("n")).collect()
    assert all(r.n == 1 for r in same)
    varied = design.per_case_samples(cases, 2, PARAMS, 1, vary_by_case=True).groupBy("sample").agg(F.countDistinct("pscale").alias("n")).collect()
    assert all(r.n == 2 for r in varied)


def test_search_space(spark):
    space = {"k": {"type": "int", "low": 2, "high": 8, "step": 3}, "c": {"type": "categorical", "choices": [[1, 2], "x"]},
             "h": {"type": "variable_list", "num_layers": {"low": 1, "high": 3}, "element": {"type": "int", "low": 4, "high": 8}}}
    rows = design.sample_space(spark, space, 60).collect()
    assert {r.k for r in rows} == {2, 5, 8} and {r.c for r in rows} == {"[1, 2]", '"x"'}
    assert {len(r.h) for r in rows} == {1, 2, 3} and all(4 <= v <= 8 for r in rows for v in r.h)
    with pytest.raises(ValueError):
        design.sample_space(spark, {"z": {"type": "nope"}}, 1)


def test_numbered_layers(spark):
    df = spark.createDataFrame([({"mlp_num_hidden_layers": "2", "hidden_layers_0": "16", "hidden_layers_1": "8"},), ({},)], "params map<string,string>")
    got = design.architecture(df).collect()
    assert list(got[0].hidden_layers) == [16, 8] and list(got[1].hidden_layers) == []
