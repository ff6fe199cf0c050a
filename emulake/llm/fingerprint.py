"""Order MinHash fingerprints: sketches that follow edit distance, since they keep the order of what they sample.

A text's k-mers are numbered by occurrence. For each of ``SLOTS`` hash functions the ``PICK`` numbered k-mers of least hash are
taken, put back into text order, and hashed together as one slot of the signature. The share of equal slots of two
signatures is their likeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emulake.llm.common import slices, store, texts_of, typed

K = 6
SLOTS = 64
PICK = 2
CHUNK = 32_768  # k-mers hashed at a time
PAD = np.full(K - 1, 0x110000, dtype=np.uint32)  # no code point; marks both ends, so that short texts have K-mers too
_ODD = np.random.default_rng(3).integers(1, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(4).integers(0, 1 << 32, SLOTS, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    """Full avalanche of 32-bit words, in place."""
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def numbered_kmers(points: np.ndarray) -> np.ndarray:
    """A hash of each k-mer and the number of its earlier occurrences; ``points`` are code points."""
    c = np.concatenate([PAD, points, PAD])
    n = len(c) - K + 1
    h = np.zeros(n, dtype=np.uint32)
    for i in range(K):
        h = h * np.uint32(0x9E3779B1) + c[i : i + n]
        h ^= h >> np.uint32(15)
    h = _mix(h)
    order = np.sort((h.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))
    place, value = (order & np.uint64(0xFFFFFFFF)).astype(np.int64), (order >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    if len(starts) < n:
        earlier = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        h[place] = _mix(value + earlier.astype(np.uint32) * np.uint32(0x85EBCA77))
    return h


def least(h: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the PICK least k-mers under each of the SLOTS functions, in blocks of CHUNK."""
    values, places = np.full((SLOTS, 0), 0, dtype=np.uint32), np.full((SLOTS, 0), 0, dtype=np.int64)
    rows = np.arange(SLOTS)
    for at in range(0, len(h), CHUNK):
        v = h[None, at : at + CHUNK] * _ODD[:, None]
        v += _ADD[:, None]
        v ^= v >> np.uint32(15)
        for _ in range(min(PICK, v.shape[1])):
            i = v.argmin(axis=1)
            values, places = np.hstack([values, v[rows, i][:, None]]), np.hstack([places, (base + at + i)[:, None]])
            v[rows, i] = 0xFFFFFFFF
        if values.shape[1] > PICK:
            values, places = least_of(values, places)
    return values, places


def least_of(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PICK least by (hash, place) of each row."""
    by = np.argsort((values.astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64), axis=1)[:, :PICK]
    return np.take_along_axis(values, by, 1), np.take_along_axis(places, by, 1)


def signature(points: np.ndarray) -> np.ndarray:
    """Order MinHash of a whole text, SLOTS 32-bit words."""
    h = numbered_kmers(points)
    _, places = least(h)
    picked = h[np.sort(places, axis=1)]
    out = np.zeros(SLOTS, dtype=np.uint32)
    for i in range(picked.shape[1]):
        out = _mix(out * np.uint32(0x9E3779B1) + picked[:, i] + np.uint32(i + 1))
    return out


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hex_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text; NULL text is empty. Equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hex_of(signature(points_of(t))) for t in texts_of(batch)])], names=[key, "fingerprint"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{typed(docs, key)}, fingerprint string")


def fingerprint_likeness(a: str = "fingerprint", b: str = "other"):
    """Share of equal slots of two fingerprint columns, as a column."""
    slot = lambda c: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.substring(F.col(c), i * 8 + 1, F.lit(8)))
    same = F.zip_with(slot(a), slot(b), lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(SLOTS))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Compare each text with an edited one and with the next document, in descending order of the key.

    The edited text has its last third (rounded down) replaced by the first as many code points (or all) of the next
    document; after the last comes the first. NULL text is empty, NULL keys come last, rows with equal keys are ordered
    by their text's hash; a single document is its own next.

    The texts are shuffled once, into ranges of the key. A task goes through its range in order with one text of
    look-ahead; the ends of the ranges are two rows per task and are joined afterwards.
    """
    own = ["row_first", "row_last"]

    def result(i: str | int | None, points: np.ndarray, sig: np.ndarray, nxt: np.ndarray, next_sig: np.ndarray) -> tuple:
        from hashlib import sha256

        cut = len(points) // 3
        edited = np.concatenate([points[: len(points) - cut], nxt[:cut]])
        edited_sig = signature(edited) if cut else sig
        digest = sha256(edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return i, len(points), digest, hex_of(sig), hex_of(edited_sig), likeness(sig, edited_sig), likeness(sig, next_sig)

    kind = typed(docs, key)
    fields = f"{kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def table(rows: list[tuple], id_arrow: pa.DataType) -> list[pa.Array]:
        kinds = [id_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        id_arrow = None
        for batch in slices(batches, 200):
            id_arrow, rows = batch.schema.field(0).type, []
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch)):
                points = points_of(t)
                now = i, points, signature(points), t
                if held is None:
                    first = now
                else:
                    rows.append(result(*held[:3], now[1], now[2]))
                held = now
            n = len(rows)
            yield pa.RecordBatch.from_arrays([*table(rows, id_arrow), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*names, *own])
        if held is not None:
            blank = [(held[0], None, None, None, None, None, None)]
            yield pa.RecordBatch.from_arrays([*table(blank, id_arrow), pa.array([first[3]], pa.string()), pa.array([held[3]], pa.string())], names=[*names, *own])

    ordered = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("__tie", F.xxhash64("text"))
    by = [F.col(key).desc_nulls_last(), F.col("__tie").desc()]
    swept = ordered.repartitionByRange(*by).sortWithinPartitions(*by).select(key, "text").mapInArrow(run, f"{fields}, row_first string, row_last string")
    done = store(swept, "swept")
    inner = done.where("row_last is null").select(*names)
    ends = done.where("row_last is not null").select(F.col(key), "row_first", "row_last", F.xxhash64("row_last").alias("__tie"))
    order = Window.orderBy(*by)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = ends.select(key, "__tie").withColumn("__n", F.row_number().over(order)).withColumn("__all", F.count(F.lit(1)).over(whole))  # one row per task
    placed = ends.join(numbers.withColumnRenamed(key, "__key"), (F.col("__key").eqNullSafe(ends[key])) & (ends["__tie"] == numbers["__tie"])).select(ends[key], "row_first", "row_last", "__n", "__all")
    nxt = placed.select(F.when(F.col("__n") == 1, F.col("__all")).otherwise(F.col("__n") - 1).alias("__n"), F.col("row_first").alias("__next"))
    pairs = placed.join(nxt, "__n").select(key, "row_last", "__next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                pa_, pb = points_of(a), points_of(b)
                rows.append(result(i, pa_, signature(pa_), pb, signature(pb)))
            yield pa.RecordBatch.from_arrays(table(rows, batch.schema.field(0).type), names=names)

    return inner.union(pairs.mapInArrow(finish, fields))
