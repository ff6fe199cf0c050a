from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emulake.operators import ordered, rank, scale, split


def counts(df, by="split"):
    return {r[by]: r["count"] for r in df.groupBy(by).count().collect()}


@given(n=st.integers(5, 10_000), test=st.floats(0, 0.9), val=st.floats(0.05, 0.9))
@settings(max_examples=200, deadline=None)
def test_sizes_partition_the_rows(n, test, val):
    try:
        sizes = split.split_sizes(n, test, val)
    except ValueError:
        return
    assert sum(sizes) == n and min(sizes) >= 0 and sizes[0] > 0


def test_documented_sizes():
    assert split.split_sizes(120, 0.2, 0.2) == (72, 24, 24)
    assert split.split_sizes(10, 0.0, 0.2)[2] == 0
    with pytest.raises(ValueError):
        split.split_sizes(100, 0.2, 0.0)


def test_split_is_exact_and_independent_of_partitioning(spark):
    base = spark.range(997).withColumnRenamed("id", "k")
    answers = []
    for p in (1, 4, 17):
        rows = split.split_shuffled(base.repartition(p), ["k"], 0.2, 0.1).collect()
        answers.append({r.k: r.split for r in rows})
    assert answers[0] == answers[1] == answers[2]
    sizes = split.split_sizes(997, 0.2, 0.1)
    assert tuple(list(answers[0].values()).count(s) for s in ("train", "val", "test")) == sizes


def test_other_seed_gives_another_split(spark):
    base = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k for r in split.split_shuffled(base, ["k"], seed=1).where("split = 'test'").collect()}
    b = {r.k for r in split.split_shuffled(base, ["k"], seed=2).where("split = 'test'").collect()}
    assert len(a) == len(b) == 100 and a != b


def test_copies_of_a_key_stay_together_and_stay_off_the_driver(spark):
    base = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    out = split.split_shuffled(base, ["k"])
    assert out.where("k = -1").select("split").distinct().count() == 1
    assert rank.duplicate_keys(base, ["k"]) == 999
    assert rank.duplicate_keys(spark.range(10), ["id"]) == 0


def test_cuts_refine_when_cells_are_large(spark, monkeypatch):
    base = spark.range(5000).withColumnRenamed("id", "k")
    want = {r.k for r in rank.sample_exact(base, 1234, ["k"], 3).collect()}
    monkeypatch.setattr(rank, "LEAF", 1)
    monkeypatch.setattr(rank, "FIRST", 1)
    monkeypatch.setattr(rank, "NEXT", 1)
    got = {r.k for r in rank.sample_exact(base, 1234, ["k"], 3).collect()}
    assert got == want and len(got) == 1234


def test_sample_larger_than_table(spark):
    assert rank.sample_exact(spark.range(10), 50, ["id"]).count() == 10
    assert rank.sample_exact(spark.range(10), 0, ["id"]).count() == 0


def test_hash_rank_is_a_permutation_per_stratum_even_with_null(spark):
    base = spark.range(900).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.lit("c")))
    got = rank.hash_rank(base, ["id"], 7, strata=["g"]).groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert len(got) == 3
    assert all(r.r == list(range(1, 301)) for r in got)


def test_stratified_split_with_a_hot_and_a_null_label(spark):
    base = spark.range(1000).withColumn("y", F.when(F.col("id") < 600, F.lit("hot")).when(F.col("id") < 700, F.lit(None)).otherwise(F.lit("cold")))
    got = split.split_stratified(base, ["id"], "y", 0.2, 0.2).groupBy("y", "split").count().collect()
    table = {(r.y, r.split): r["count"] for r in got}
    assert table[("hot", "test")] == 120 and table[(None, "test")] == 20 and table[("cold", "val")] == 60


def test_kfold_sizes(spark):
    out = split.kfold(spark.range(103), ["id"], 5)
    assert [counts(out, "fold")[i] for i in range(5)] == [21, 21, 21, 20, 20]
    with pytest.raises(ValueError):
        split.kfold(spark.range(3), ["id"], 5)


def test_batches_cover_the_table_in_row_order(spark):
    b = split.batches(spark.range(25).withColumn("x", F.col("id") * 1.0), ["id"], 10, row_idx="id")
    packed = {r.batch_id: r.features for r in split.batch_arrays(b, ["x"]).collect()}
    assert [len(packed[i]) for i in range(3)] == [10, 10, 5]
    assert packed[2][0] == [20.0]


def test_scaling_uses_population_deviation_and_train_only(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (2.0, 5.0, "train"), (3.0, 5.0, "train"), (100.0, 9.0, "test")], "x double, c double, split string")
    sc = scale.fit_standard(df.where("split = 'train'"), ["x", "c"])
    assert sc.params["x"][0] == 2.0 and abs(sc.params["x"][1] - (2 / 3) ** 0.5) < 1e-12
    assert sc.params["c"] == (5.0, 1.0)  # a constant column is divided by one
    back = sc.inverse(sc.transform(df)).collect()
    assert [round(r.x, 9) for r in back] == [1.0, 2.0, 3.0, 100.0]
    again = scale.Scaler.from_frame(sc.to_frame(spark))
    assert again.params == sc.params


def test_wide_tables_use_the_long_form(spark, monkeypatch):
    df = spark.range(50).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(6)])
    narrow = scale.fit_standard(df, df.columns).params
    monkeypatch.setattr(scale, "WIDE", 2)
    wide = scale.fit_standard(df, df.columns).params
    assert all(abs(narrow[c][0] - wide[c][0]) < 1e-9 and abs(narrow[c][1] - wide[c][1]) < 1e-9 for c in narrow)


def test_ordered_rank_splits_a_frequent_value_by_its_ties(spark):
    base = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id")).alias("o"))
    got = [r.rank for r in ordered.ordered_rank(base, "o", ties=["id"]).orderBy("o", "id").collect()]
    assert got == list(range(1, 2001))
    cells = base.withColumn("c", ordered.order_bucket(base, F.col("o"), F.col("id"))).groupBy("c").count().agg(F.max("count")).first()[0]
    assert cells < 200  # half the rows share one value, yet no cell holds more than a tenth


def test_order_cells_stay_ordered_when_cut_by_width(spark):
    base = spark.range(3000).select("id", ((F.col("id") * 7919) % 3001).alias("o"), F.pow(F.lit(1.01), F.col("id") % 1000).alias("e"))
    for c in ("o", "e"):
        cell = ordered.order_bucket(base, F.col(c), buckets=8, cell_rows=20)
        rows = base.select(c, cell.alias("b")).orderBy(c).collect()
        assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) > 60


def test_hash_rank_cells(spark):
    base = spark.range(2000).withColumn("g", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 50))
    a = rank.hash_rank(base, ["id"], 1, strata=["g"], cell_rows=3).orderBy("id").collect()
    b = rank.hash_rank(base, ["id"], 1, strata=["g"]).orderBy("id").collect()
    assert a == b
    assert rank.hash_rank(base, ["id"], 1, cell_rows=5).select("id", "rank").orderBy("id").collect() == rank.hash_rank(base, ["id"], 1).select("id", "rank").orderBy("id").collect()


def test_running_matches_a_plain_window(spark):
    from pyspark.sql import Window

    base = spark.range(600).select("id", (F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 101).alias("v"))
    w = Window.partitionBy("g").orderBy("id")
    want = base.withColumn("m", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = ordered.running(base, "id", ["g"], {"m": ("max", "v", False), "s": ("sum", "v", True)})
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_split_by_a_stored_hash_reads_no_keys(spark):
    """The split of a table that has its keys' hash stored is the split by the keys, and no scan hashes again."""
    from pyspark.sql import functions as F

    from emulake.functions.hashing import seeded_hash

    df = spark.range(5000).selectExpr("concat('k', id) AS k", "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    hashed = df.withColumn("h", seeded_hash(42, "k"))
    plan = split.fit_split(hashed, ["k"], 0.2, 0.2, stored="h")
    assert plan.cuts.hash()._jc.toString() == F.col("h")._jc.toString()
    a = {(r.id, r.split) for r in plan.apply(hashed).select("id", "split").collect()}
    assert a == {(r.id, r.split) for r in split.split_shuffled(df, ["k"], 0.2, 0.2).select("id", "split").collect()}


def test_large_tables_are_split_by_the_stored_hash(spark, monkeypatch):
    from emulake.plans.catalog import models_and_runs as m

    df = spark.range(900).selectExpr("concat('k', id) AS row_key", "id * 1D AS x")
    small = m.split_once(df, "small")
    monkeypatch.setattr(m, "SMALL_ROWS", 100)
    large = m.split_once(df, "large")
    assert large.columns == small.columns and large.exceptAll(small).isEmpty() and large.count() == 900
    assert "md5" not in large._jdf.queryExecution().optimizedPlan().toString()
