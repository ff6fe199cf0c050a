"""Random forest regression with Spark ML, one forest per output."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.models.base import REGISTRY, Model

# The defaults of a forest; Spark limits the depth to 30.
DEFAULTS = {"n_estimators": 200, "max_depth": 30, "min_samples_leaf": 1, "seed": 42, "max_features": "all", "max_bins": 64}


def _walkable(nodes: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each tree of a node table as (depth, feature, threshold, next, value): from node i a row goes on to next[2 i + 1] if it is at or
    below the threshold, else to next[2 i], and a leaf leads to itself."""
    trees = []
    for _, t in nodes.to_pandas().sort_values(["tree", "id"]).groupby("tree"):
        if not np.array_equal(t["id"].to_numpy(), np.arange(len(t))):
            raise ValueError("the nodes of a tree must be numbered from 0 without gaps")
        left, right = (t[c].to_numpy(dtype=np.intp) for c in ("left", "right"))
        leaf, at, depth = left < 0, np.zeros(1, dtype=np.intp), 0
        while len(at := at[~leaf[at]]):
            at, depth = np.concatenate([left[at], right[at]]), depth + 1
        follow = np.where(leaf, np.arange(len(t)), [right, left]).T.ravel()
        trees.append((depth, np.where(leaf, 0, t["feature"].to_numpy()).astype(np.intp), t["threshold"].to_numpy(dtype=float), follow, t["value"].to_numpy(dtype=float)))
    return trees


def _walk(x: np.ndarray, trees: Sequence[tuple]) -> np.ndarray:
    """Mean prediction of the trees for each row, added up in Spark's order; a missing number goes right."""
    flat, start, total = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    for depth, feature, threshold, follow, value in trees:
        at = np.zeros(len(x), dtype=np.intp)
        for _ in range(depth):
            at = follow.take(2 * at + (flat.take(start + feature.take(at)) <= threshold.take(at)))
        total += value.take(at)
    return total / len(trees)


class Forest(Model):
    key = "random_forest"
    aliases = ("rf", "rfr", "forest")
    has_std = True

    def _assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.inputs, outputCol="__features", handleInvalid="keep").transform(df)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> Forest:
        p = {**DEFAULTS, **self.params}
        data = self._assemble(train).select("__features", *[F.col(o).cast("double").alias(o) for o in self.outputs]).persist()

        def one(output: str) -> RandomForestRegressionModel:
            rf = RandomForestRegressor(
                featuresCol="__features", labelCol=output, predictionCol="__p", numTrees=int(p["n_estimators"]),
                maxDepth=min(int(p["max_depth"] or 30), 30), minInstancesPerNode=int(p["min_samples_leaf"]), seed=int(p["seed"]),
                featureSubsetStrategy=str(p["max_features"]), maxBins=int(p["max_bins"]))
            return rf.fit(data)

        try:  # outputs share the cached vectors; their fits are independent Spark jobs
            with ThreadPoolExecutor(max_workers=min(4, len(self.outputs))) as pool:
                self.models = list(pool.map(one, self.outputs))
        finally:
            data.unpersist()
        return self

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        out = self._assemble(df)
        cells = []
        for k, (o, m) in enumerate(zip(self.outputs, self.models)):
            out = m.setPredictionCol(f"__p{k}").setLeafCol("").transform(out)
            cells.append(F.struct(F.lit(o).alias("output"), F.col(f"__p{k}").alias("y_pred")))
        return out.select(*keep, F.inline(F.array(*cells)))

    def nodes(self, spark: SparkSession, output: str | None = None) -> DataFrame:
        """The node table of one output's trees, as tree_shapley.NODES has it; cover is the weight of the training rows."""
        from emulake.session import new_path

        path = new_path(spark, "forest-nodes")
        self.models[self.outputs.index(output or self.outputs[0])].write().overwrite().save(path)
        n = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), F.inline(F.array("nodeData")))
        return n.select(
            "tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("prediction").alias("value"), F.get("impurityStats", F.lit(0)).alias("cover"))

    def in_rows(self, spark: SparkSession) -> Callable[[np.ndarray], np.ndarray]:
        sent = spark.sparkContext.broadcast([_walkable(self.nodes(spark, o).toArrow()) for o in self.outputs])
        return lambda x: np.stack([_walk(x, trees) for trees in sent.value], axis=1)

    def _leaf_values(self, spark: SparkSession, output: str) -> list[np.ndarray]:
        """Prediction of every leaf, by tree and leaf number."""
        per = self.nodes(spark, output).where("left < 0").groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("a"))
        return [np.array([n["value"] for n in r["a"]]) for r in per.orderBy("tree").collect()]

    def shapley(self, df: DataFrame, key: Sequence[str], background: DataFrame | None = None) -> DataFrame:
        """Exact attributions (key..., output, feature, phi); ``background`` (few rows) takes the place of the training rows' shares."""
        from emulake.models.tree_shapley import tree_attributions

        z = None if background is None else np.array(background.select(*[F.col(c).cast("double") for c in self.inputs]).collect(), dtype=float)
        parts = [tree_attributions(self.nodes(df.sparkSession, o), df, key, self.inputs, o, z) for o in self.outputs]
        return reduce(DataFrame.unionByName, parts)

    def score_std(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Mean and population deviation over the trees. Spark finds each row's leaf in every tree; a numpy
        gather turns leaf numbers into predictions."""
        keep = list(keep)
        spark = df.sparkSession
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "output string, y_pred double, std double"])
        out = None
        for o, m in zip(self.outputs, self.models):
            values = self._leaf_values(spark, o)
            leaves = m.setPredictionCol("__p").setLeafCol("__leaf").transform(self._assemble(df)).select(*keep, vector_to_array("__leaf").alias("__leaf"))
            m.setLeafCol("")

            def gather(batches: Iterator[pd.DataFrame], values=values, o=o) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if not len(pdf):
                        continue
                    idx = np.stack(pdf["__leaf"].to_numpy()).astype(int)
                    trees = np.stack([v[idx[:, t]] for t, v in enumerate(values)], axis=1)
                    got = pdf[keep].copy()
                    got["output"], got["y_pred"], got["std"] = o, trees.mean(axis=1), trees.std(axis=1)
                    yield got

            part = leaves.mapInPandas(gather, schema)
            out = part if out is None else out.unionByName(part)
        return out

    def importances(self, spark: SparkSession) -> DataFrame:
        """(output, feature, importance)."""
        rows = [(o, f, float(v)) for o, m in zip(self.outputs, self.models) for f, v in zip(self.inputs, m.featureImportances.toArray())]
        return spark.createDataFrame(rows, "output string, feature string, importance double")

    def size(self) -> dict[str, int]:
        return {"nodes": int(sum(m.totalNumNodes for m in self.models)), "trees": int(sum(m.getNumTrees for m in self.models))}

    def state(self) -> dict[str, Any]:
        return {}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        for k, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}-output{k}")

    def restore(self, state: dict[str, Any]) -> Forest:
        self.models = [RandomForestRegressionModel.load(f"{state['__path']}-output{k}") for k in range(len(self.outputs))]
        return self


REGISTRY.register(Forest)
