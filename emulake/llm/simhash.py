"""SimHash near-duplicates: pigeonhole blocks find fingerprints that differ in few bits.

A fingerprint is cut into blocks; two that differ in at most ``radius`` bits agree in all blocks but ``radius``, so they
meet in a join on some choice of equal blocks, and the Hamming distance is verified there. Groups of near copies
crowd into the same blocks; a crowded block is not joined with itself. Its fingerprints each emit the values within
half the radius instead: two fingerprints within the radius share such a value, and those who share one are within
the radius, so a star per value keeps the components exact with rows in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import content_key, forget_values, fresh, slices, store, texts_of, typed
from emulake.llm.components import component_roots
from emulake.session import join_on

BITS = 64
BLOCKS = 4  # of 16 bits
#: Fingerprints in one block value up to which they are joined with each other.
CROWD = 32
CHUNK = 65_536  # shingles hashed at a time
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_of(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text as a signed 64-bit number; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at space and 09-0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(part) >= width else [b" ".join(part)]
        h = np.array([xxh64_intdigest(s, seed) for s in shingles], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, __text hash, fp) for every row; NULL text is empty. Only the two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for batch in slices(batches):
            fp = pa.array([fingerprint_of(t) for t in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fp], names=[key, "__text", "fp"])

    seen = docs.select(key, F.col(text).alias("text"), content_key(key, text)["text"].alias("__text"))
    return seen.mapInArrow(run, f"{typed(docs, key)}, __text long, fp long")


def _block(i: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF))


def close_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``distinct`` (column fp) at Hamming distance 1 to ``radius`` (2 at most).

    Every two such fingerprints are connected by links, directly or over others of the same component.
    """
    if radius != 2:
        raise ValueError("the half-radius values are those of radius 2")
    keys = [
        F.struct(F.lit(k).alias("which"), F.shiftleft(_block(i), 16).bitwiseOR(_block(j)).alias("value"))
        for k, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - radius))
    ]
    member = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.which", "k.value")
    sizes = member.groupBy("which", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = store(member.join(sizes, ["which", "value"]), "blocks")
    few = shared.where(F.col("n") <= CROWD)
    verified = (
        few.select("which", "value", F.col("fp").alias("a")).join(few.select("which", "value", F.col("fp").alias("b")), ["which", "value"])
        .where(F.col("a") < F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > CROWD).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(BITS)])).alias("mid"))
    stars = near.groupBy("mid").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # at most 65: those within one bit of mid
    links = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return verified.union(links)


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """Fingerprint and component of every row: key, __text (hash of the text), fp, component_id, keeper.

    component_id is the smallest key reachable over fingerprints at most ``radius`` bits apart; rows without a key
    count only where no row of the component has one (then it is NULL). keeper is the content key of the row that
    stands for the component. Texts without words have fingerprint 0. Equal fingerprints are one node, so copies cost
    one row each however many there are; their groups are aggregated before any shuffle.
    """
    rows = store(fingerprints(docs, key, text), "fingerprints")
    return placed_rows(rows, lambda nodes: close_links(nodes.select("fp"), radius), key)


def placed_rows(rows: DataFrame, links: Callable[[DataFrame], DataFrame], key: str, *more: Column) -> DataFrame:
    """``rows`` (key, __text, fp) with component_id and keeper, over ``links`` of the nodes: fp, first row, aggregates ``more``."""
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("__text").alias("text"))
    nodes = store(rows.groupBy("fp").agg(F.min(own).alias("first"), *more), "nodes")
    roots = component_roots(links(nodes))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = store(placed, "placed")
    keeper = placed.groupBy("root").agg(F.min("first").alias("keeper"))
    named = placed.join(keeper, "root").select("fp", "keeper")
    return rows.select(key, "__text", "fp").join(named, "fp").withColumn("component_id", F.col("keeper")["id"])


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their components, with all columns; one row of each group stays.

    The row with the smallest key stays; rows with the same key are told apart by their text's hash, and of rows equal
    in both one stays.
    """
    return keep_first(docs, near_duplicates(docs, key, text), key, text)


def keep_first(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are keepers in ``found``."""
    own = [fresh(docs, "__id"), fresh(docs, "__text")]
    keep = store(found.select("keeper").distinct().select(F.col("keeper.id").alias(own[0]), F.col("keeper.text").alias(own[1])), "keepers")
    repeated = found.groupBy(key, "__text").count().where("count > 1").limit(1).count()
    tagged = docs.withColumn(own[0], F.col(key)).withColumn(own[1], content_key(key, text)["text"])
    kept = join_on(tagged, keep, own, "left_semi")
    if repeated:
        kept = kept.dropDuplicates(own)
    return kept.select(*docs.columns)


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
