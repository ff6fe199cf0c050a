"""Stacked ``.npy`` pairs as a Spark data source: every task maps its own row range of the files.

    spark.dataSource.register(StackedNpy)
    spark.read.format("stacked_npy").option("data", ...).option("target", ...).load()

Options: ``data`` and ``target`` paths, or ``dir`` and ``set_name``; ``input_names``/``output_names`` (comma
lists), ``start``/``stop`` rows, ``rows_per_partition``. Columns are ``row_idx``, inputs, outputs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

PREFIX = "data_nprev5_"  # fixed value: file name prefix of a named set
BATCH = 16_384


class RowRange(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__(start)
        self.start, self.stop = start, stop


def set_paths(folder: str, set_name: str = "set1") -> tuple[str, str]:
    """The data and target files of a named set; missing files are errors."""
    paths = tuple(os.path.join(folder, f"{PREFIX}{set_name}_{kind}.npy") for kind in ("data", "target"))
    for p in paths:
        if not os.path.exists(p):
            raise FileNotFoundError(f"expected {p}; check set_name")
    return paths


class StackedNpy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stacked_npy"

    def _layout(self):
        o = self.options
        data, target = (o["data"], o.get("target")) if "data" in o else set_paths(o["dir"], o.get("set_name", "set1"))
        shapes = [np.load(p, mmap_mode="r").shape for p in (data, target) if p]
        if len({s[0] for s in shapes}) > 1:
            raise ValueError("data and target have different row counts")
        names = []
        for key, label, shape in zip(("input_names", "output_names"), ("input", "output"), shapes):
            width = shape[1] if len(shape) > 1 else 1
            given = [n.strip() for n in o[key].split(",")] if o.get(key) else [f"{label}_{i}" for i in range(width)]
            if len(given) != width:
                raise ValueError(f"{key} has {len(given)} names for {width} columns")
            names.append(given)
        return data, target, shapes[0][0], names

    def schema(self) -> StructType:
        names = self._layout()[3]
        return StructType([StructField("row_idx", LongType()), *[StructField(n, DoubleType()) for part in names for n in part]])

    def reader(self, schema: StructType) -> NpyReader:
        data, target, n, _ = self._layout()
        start, stop = int(self.options.get("start", 0)), int(self.options.get("stop", n))
        return NpyReader(data, target, schema, max(0, start), min(stop, n), int(self.options.get("rows_per_partition", 1_000_000)))


class NpyReader(DataSourceReader):
    def __init__(self, data: str, target: str | None, schema: StructType, start: int, stop: int, step: int):
        self.files, self.schema, self.start, self.stop, self.step = [p for p in (data, target) if p], schema, start, stop, step

    def pushFilters(self, filters: list[Filter]):
        """Row-index comparisons narrow the range; everything else stays with Spark."""
        for f in filters:
            compared = isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))
            if compared and f.attribute == ("row_idx",) and isinstance(f.value, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.stop = min(self.stop, f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[RowRange]:
        if self.start >= self.stop:
            return [RowRange(self.start, self.start)]
        return [RowRange(a, min(a + self.step, self.stop)) for a in range(self.start, self.stop, self.step)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        maps = [np.load(p, mmap_mode="r") for p in self.files]
        names = [f.name for f in self.schema.fields]
        for a in range(partition.start, partition.stop, BATCH):
            b = min(a + BATCH, partition.stop)
            blocks = [np.asarray(m[a:b], dtype=np.float64).reshape(b - a, -1) for m in maps]
            cols = [pa.array(np.arange(a, b, dtype=np.int64))]
            cols += [pa.array(np.ascontiguousarray(blk[:, j])) for blk in blocks for j in range(blk.shape[1])]
            yield pa.RecordBatch.from_arrays(cols, names=names)
