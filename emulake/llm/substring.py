"""Repeated passages across documents, found by hashing short chains of the cells that a text falls into.

A text is cut into cells at line breaks, after sentence ends, and before words with a capital only in front; a cell that is
still long is cut further after pairs of words whose hash says so, which needs neither case nor punctuation. A passage set into
the middle of a foreign line thus falls into the same cells, but for its ends. From each cell on, and back from each cell, the
shortest chain of neighbouring cells that has ``min_words`` words is a unit. Units are normalised (white space, case) and hashed to
128 bits. All units of all documents are grouped by digest; the earliest by (document, place) is kept, and later ones go. Short
phrases that happen to be equal stay, as no unit is shorter than ``min_words`` and its cells stood together before.
What remains is the original text without the removed stretches, whose original offsets are returned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import SLICE_ROWS, binary_column, content_key, forget_values, fresh, slices, store, texts_of
from emulake.session import join_on

#: Words that a repeated passage needs. A character of a script without spaces counts as half a word.
MIN_WORDS = 8
UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я"
#: A line end, white space after a sentence's end or before a capital; it begins with the white space, which a search finds fast.
BREAK = re.compile(rf"\s(?:(?<=\n)\s*|(?<=\w[.!?]\s)[^\S\n]*|[^\S\n]*(?=[{UPPER}](?![{UPPER}])))")
#: Thai, Lao, Burmese, Khmer, Chinese and Japanese: every character is a word of its own.
DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3001-\u319f\u31c0-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
WORD = re.compile(rf"[{DENSE}]|[^\s{DENSE}]+")
IS_DENSE = re.compile(f"[{DENSE}]")
ASCII_WORD = re.compile(r"\S+")
#: Words from which on a cell is cut further, the mean distance of these cuts, and the words after which one is made anyway.
LONG, MEAN, MOST = 25, 8, 64


def _inner_cuts(words: list[str]) -> list[int]:
    """Places before which a long cell is cut; they depend only on the words shortly before."""
    cuts, last = [], 0
    raw, crc = [w.encode("utf-8", "surrogatepass") for w in words], zlib.crc32
    for k, two in enumerate(map(b"%b %b".__mod__, zip(raw, raw[1:-1])), 2):
        if crc(two) % MEAN == 0 or k - last == MOST:
            cuts.append(k)
            last = k
    return cuts


def _plain_cells(text: str) -> list[tuple[int, int, str, int]]:
    """``cells_of`` a text whose words are bounded by white space only: the words of a stretch are split, not searched one by one."""
    place, found, begin = [], [], 0
    for end in [*(m.end() for m in BREAK.finditer(text)), len(text)]:
        words = text[begin:end].lower().split()
        if words:
            cuts = [0]
            if len(words) >= LONG and (inner := _inner_cuts(words)):
                starts = [m.start() for m in ASCII_WORD.finditer(text, begin, end)]
                cuts += inner
                place += [begin, *(starts[k] for k in inner)]
            else:
                place.append(begin)
            cuts.append(len(words))
            found += [(" ".join(words[i:j]), 2 * (j - i)) for i, j in zip(cuts, cuts[1:])]
        begin = end
    if not found:
        return []
    place[0] = 0
    place.append(len(text))
    return [(place[n], place[n + 1], words, half) for n, (words, half) in enumerate(found)]


def cells_of(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, normalised, half words) of the cells of a text; end includes the break that follows."""
    if text.isascii() or not IS_DENSE.search(text):
        return _plain_cells(text)
    at = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in at]
    starts = {m.end() for m in BREAK.finditer(text)}
    rough = [0, *(i for i in range(1, len(at)) if at[i][0] in starts), len(at)]
    edges = []
    for i, j in zip(rough, rough[1:]):
        edges.append(i)
        if j - i >= LONG:
            edges += [i + k for k in _inner_cuts(words[i:j])]
    edges.append(len(at))
    place = [0, *(at[i][0] for i in edges[1:-1]), len(text)]
    out = []
    for n, (i, j) in enumerate(zip(edges, edges[1:])):
        out.append((place[n], place[n + 1], " ".join(words[i:j]), sum(1 if IS_DENSE.match(w) else 2 for w in words[i:j])))
    return out


def units_of(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of the units of a text: the shortest chains of cells with ``min_words`` words, from each cell on
    and back from each cell. They overlap and are sorted by start."""
    cells, need = cells_of(text), 2 * min_words
    chains, i, total = set(), 0, 0
    for j, cell in enumerate(cells):
        total += cell[3]
        while i <= j and total >= need:  # cells i to j - 1 have too few
            chains.add((i, j))
            total -= cells[i][3]
            i += 1
        if i and total < need:  # back from j, over cells that are done as starts
            back, k = total, i
            while back < need:
                k -= 1
                back += cells[k][3]
            chains.add((k, j))
    return [(cells[i][0], cells[j][1], " ".join(c[2] for c in cells[i : j + 1])) for i, j in sorted(chains)]


def removed_spans(units: list[tuple[int, int, str]], repeated: set[int], min_words: int) -> list[tuple[int, int]]:
    """Spans that the repeated units cover, but for those that overlap the kept first one. Units have ``min_words`` already."""
    spans: list[tuple[int, int]] = []
    kept: dict[str, int] = {}
    for i, (a, b, words) in enumerate(units):
        if i not in repeated:
            kept[words] = b
        elif kept.get(words, 0) <= a:
            if spans and a <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(b, spans[-1][1])
            else:
                spans.append((a, b))
    return spans


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, unit, digest) of every unit; doc is the content key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        from xxhash import xxh3_128_digest

        for batch in slices(batches, SLICE_ROWS // 5):
            rows, unit, parts = [], [], []
            for i, t in enumerate(texts_of(batch)):
                found = units_of(t, min_words)
                rows += [i] * len(found)
                unit += range(len(found))
                parts += [xxh3_128_digest(u[2].encode("utf-8", "surrogatepass")) for u in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(unit, pa.int32()), binary_column(parts)], names=["doc", "unit", "digest"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(content_key(key, text).alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, f"doc struct<none:boolean,id:{kind},text:bigint>, unit int, digest binary")


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, units): for each document, the units that occur earlier, in it or in another document.

    Digests are counted map-side, so a line that a third of all documents share is one row per task. Only digests that
    occur again are joined back; their join has no aggregate above it, so adaptive execution may split a hot one.
    """
    units = store(digests(docs, key, text, min_words), "units")
    first = units.groupBy("digest").agg(F.min(F.struct("doc", "unit")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = store(first.select("digest", "first"), "firsts")  # so that the join stands alone and a hot digest can be split
    later = units.join(first, "digest").where(F.struct("doc", "unit") > F.col("first")).select("doc", "unit")
    return store(later, "later").groupBy("doc").agg(F.collect_set("unit").alias("units"))


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", spans: str = "removed") -> DataFrame:
    """``docs`` with ``text`` without repeated passages, and the column ``spans``, the removed (start, end) of the original text.

    Every row stays, with all its columns; a text that repeats wholly becomes empty, and NULL text stays NULL. Rows
    equal in key and text act as one document. Rows without a key rank last, rows with the same key by their text's hash.
    A column ``spans`` that is already there is replaced.
    """
    docs = docs.drop(spans)
    own, again_in = fresh(docs, "__doc"), fresh(docs, "__units")
    later = repeated_units(docs, key, text, min_words).select(F.col("doc").alias(own), F.col("units").alias(again_in))
    joined = join_on(docs.withColumn(own, content_key(key, text)), later, [own], "left").drop(own)
    out = joined.withColumn(spans, F.lit(None).cast("array<struct<start:int,end:int>>")).drop(again_in)
    at, names = out.columns.index(text), out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for batch in slices(batches):
            texts, cuts = batch.column(text).to_pylist(), []
            for i, again in enumerate(batch.column(again_in).to_pylist()):
                gone = removed_spans(units_of(texts[i], min_words), set(again), min_words) if again and texts[i] else []
                if gone:
                    edges = [0, *(e for s in gone for e in s), len(texts[i])]
                    texts[i] = "".join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2]))
                cuts.append([{"start": a, "end": b} for a, b in gone])
            cols = [batch.column(c) for c in names[:-1]]
            cols[at] = pa.array(texts, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cuts, kind)], names=names)

    return joined.mapInArrow(run, out.schema)
