"""Line dedup in column expressions only: explode, hash, count documents, drop, reassemble by position.

Each text is split at line feeds; a line's key is the line without ASCII white space at its ends and with A-Z lower-cased.
Keys are hashed to 128 bits and counted over the corpus after a map-side aggregate, so a line that a third of all
documents share is one row for each task. Only digests found in enough documents are joined back to the places of their
lines; that join reads two shuffles and nothing above it needs a digest's rows together, so adaptive execution can
split a hot one. Texts move once, to meet the places of their dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import content_key, fresh, store
from emulake.session import join_on

#: Fixed values of the key: what is stripped, and what is lower-cased.
BLANK = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
MIN_DOCS = 2


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the function for plain ASCII is the faster one."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def line_keys(text: Column) -> Column:
    """The keys of a text's lines in order; NULL and the empty text have one empty line."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)))
    return F.transform(lines, lowered)


def line_places(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(doc, h, g, at) of every line with a key of ``min_chars`` code points: the content key of its row, 128 bits of the
    line's key as two numbers, and the line's position."""
    lines = docs.select(content_key(key, text).alias("doc"), F.posexplode(line_keys(F.col(text))).alias("at", "line"))
    long = lines.where(F.length("line") >= min_chars)
    return long.select("doc", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("line"), "line").alias("g"), "at")


def shared_lines(places: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h, g, first): digests in at least ``min_docs`` documents and the first document that holds each.

    Documents are counted by their keys, so rows with one key are one document, and so are all rows without one.
    For two documents the extremes say enough; more are counted one by one.
    """
    id_of = F.struct("doc.none", "doc.id")
    if min_docs == 2:
        counted = places.groupBy("h", "g").agg(F.min(id_of).alias("first"), F.max(id_of).alias("last")).where("first <> last")
    else:
        counted = places.groupBy("h", "g").agg(F.min(id_of).alias("first"), F.count_distinct(id_of).alias("n")).where(F.col("n") >= min_docs)
    return counted.select("h", "g", "first")


def dropped_lines(docs: DataFrame, key: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(doc, gone): for each document that loses lines, their positions."""
    places = store(line_places(docs, key, text, min_chars), "lines")
    shared = store(shared_lines(places, min_docs), "shared-lines")
    later = places.join(shared, ["h", "g"]).where(F.struct("doc.none", "doc.id") > F.col("first")).select("doc", "at")
    return store(later, "later-lines").groupBy("doc").agg(F.collect_set("at").alias("gone"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the kept lines as ``text``, joined by line feeds, and n_lines, n_dropped (long) and dropped_lines.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except in the
    document with the smallest key, which keeps each of its own. dropped_lines are the positions of the lost ones in
    the original text, in order. NULL text counts as one empty line and stays NULL. Rows with one key are one document;
    rows without a key are one that ranks last. A text that loses all its lines becomes empty. Columns named like the
    three new ones are replaced; an empty table gives none.
    """
    docs = docs.drop("n_lines", "n_dropped", "dropped_lines")
    names = docs.columns
    own, gone, cut = fresh(docs, "__doc"), fresh(docs, "__gone"), fresh(docs, "__lines")
    lost = dropped_lines(docs, key, text, min_docs, min_chars).select(F.col("doc").alias(own), F.col("gone").alias(gone))
    # the lines pass the join in the place of the text, so that the look-up below reads a column and splits nothing
    split = docs.withColumn(own, content_key(key, text)).withColumn(cut, F.split(F.col(text), "\n", -1)).drop(text)
    joined = join_on(split, lost, [own], "left")
    n = F.coalesce(F.size(cut), F.lit(1))
    left = F.array_except(F.sequence(F.lit(0), n - 1), gone)  # a hashed look-up, in order
    kept = F.when(F.col(gone).isNull(), F.col(cut)).otherwise(F.transform(left, lambda i: F.get(F.col(cut), i)))
    return joined.select(
        *[F.array_join(kept, "\n").alias(text) if c == text else F.col(c) for c in names],
        F.when(F.col(cut).isNull(), 1).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_sort(gone), F.array().cast("array<int>")).alias("dropped_lines"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, line counts and the digest of what is left; NULL text leaves the empty text."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
