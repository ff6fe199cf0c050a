from __future__ import annotations

import random

from pyspark.sql import functions as F

from emulake.operators import metrics
from emulake.plans import catalog

SCHEMA = "row_key string, t double, a double, b double, u double, c double, d double"


def rows(n):
    rng = random.Random(11)
    value = lambda: rng.choice([None, float("nan"), float("inf"), -1.5, 0.0, *[rng.uniform(-9, 9) for _ in range(6)]])
    return [(rng.choice([None, "", "x", f"k{i}"]), *[value() for _ in range(6)]) for i in range(n)]


def test_cases_in_a_row_compare_as_their_long_predictions_do(spark):
    df = spark.createDataFrame(rows(400), SCHEMA)
    cells = [F.struct(F.lit(m).alias("model"), F.lit(o).alias("output"), F.col(y).alias("y_true"), F.col(p).alias("y_pred"))
             for o, y, m, p in (("one", "t", "A", "a"), ("one", "t", "B", "b"), ("two", "u", "A", "c"), ("two", "u", "B", "d"))]
    long = metrics.compare_models(df.select("row_key", F.inline(F.array(*cells))), "A", "B")
    wide = metrics.compare_wide(df, {"one": (F.col("t"), F.col("a"), F.col("b")), "two": (F.col("u"), F.col("c"), F.col("d"))})
    assert wide.columns == long.columns and wide.dtypes == long.dtypes
    read = lambda x: sorted(map(str, x.collect()))
    assert read(wide) == read(long) and wide.count() > 100


def test_a_comparison_shuffles_a_case_once_and_aggregates_no_keys_before(spark, sf):
    plan = catalog.QUERIES["j5_compare_models"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    before = plan.partition("Exchange ")[2]
    assert plan.count("Exchange ") == 1 and before and "Generate" not in before and "HashAggregate" not in before
    assert "y_true" not in before  # what isn't asked for isn't shuffled
