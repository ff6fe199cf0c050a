"""Best-fit packing of token sequences, planned on a histogram of lengths.

The plan never looks at documents. It takes the count of each length (at most ``size`` numbers), longest first, and
puts whole runs of equal pieces into runs of equal sequences: the open sequences with the least room that still holds
the length get as many pieces as fit. The outcome is a bounded list of slot ranges. Documents then take their slots by
an equi-join on (length, rank within length).
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import SLICE_ROWS, binary_column, slices, store, texts_of, typed, worker_value
from emulake.operators.rank import rank_in_cells

#: Words whose ids a worker keeps. Rarer words that come later are encoded each time they occur.
KEPT_WORDS = 400_000
CELL_ROWS = 200_000  # rows that one ranking window sorts
BLOCK_SLOTS = 65_536  # slots that one row of the plan makes at a time
#: Control characters that str.split takes for white space and the tokenizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: What the tokenizer's own pattern takes from a lower-case word of ASCII and the letters of Latin-1's upper part, which PLAIN admits.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\s]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
#: The two bytes of each such letter as characters of a byte-level vocabulary: what is no printable Latin-1 goes from 256 on, in order.
_REST = [i for i in range(256) if not (0x21 <= i < 0x7F or 0xA1 <= i < 0xAD or 0xAE <= i)]
LETTERS = {c: "".join(chr(256 + _REST.index(i) if i in _REST else i) for i in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordIds:
    """Token ids of whole texts as little-endian 32-bit bytes. The tokenizer drops white space and never joins over
    it, so a text's ids are the ids of its words, and a word's ids need computing only once. With ``control``, the names
    of added tokens in a text become these tokens, as in a plain call of the tokenizer; such texts are encoded whole."""

    def __init__(self, path: str, control: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not control
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if control else []
        self.whole = re.compile("|".join([ODD_SPACE.pattern, *added]), re.IGNORECASE)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words. Plain ones are put together from the pieces that the tokenizer's pattern cuts them into, each computed once.
        A word of one piece shares the piece's ids, and its text too where they are equal."""
        got, rest, pieces, tokenize = {}, [], self.pieces, self.tokenizer.model.tokenize
        for w in words:
            if not PLAIN.match(w):
                rest.append(w)
                continue
            parts = []
            for p in PIECES.findall(w.lower()):
                ids = pieces.get(p)
                if ids is None:
                    ids = b"".join([t.id.to_bytes(4, "little") for t in tokenize(p.translate(LETTERS))])
                    if len(pieces) < KEPT_WORDS:
                        pieces[w if p == w else p] = ids
                parts.append(ids)
            got[w] = parts[0] if len(parts) == 1 else b"".join(parts)
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                got[w] = np.array(e.ids, dtype="<u4").tobytes()
        return got

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        words = [None if self.whole.search(t) else t.split() for t in texts]
        new = set().union(*(ws for ws in words if ws)).difference(self.known)
        learnt, known = self._learn(new), self.known
        keep = len(known) + len(learnt) <= KEPT_WORDS
        known.update(learnt)
        out = [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if ws is None else b"".join(map(known.__getitem__, ws))
            for t, ws in zip(texts, words)
        ]
        if not keep:
            for w in learnt:
                del known[w]
        return out


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", control: bool = False) -> DataFrame:
    """Tokenise every whole text, add ``end_id``, and cut what is longer than ``size``.

    Returns key, piece (from 0), start (ids of the document before the piece), length, and ids as little-endian
    32-bit binary. NULL text is empty and gives the one id ``end_id``; repeated rows each give their own pieces.
    With ``control``, the names of added tokens in a text become these tokens.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_value("word_ids", (tokenizer, control), lambda: WordIds(tokenizer, control))
        for batch in slices(batches, SLICE_ROWS // 5):
            rows, piece, start, length, parts = [], [], [], [], []
            for i, raw in enumerate(ids.encode(texts_of(batch))):
                raw += end
                for p, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    rows.append(i), piece.append(p), start.append(at // 4), length.append(len(part) // 4), parts.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary_column(parts)],
                names=[key, "piece", "start", "length", "ids"],
            )

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{typed(docs, key)}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over counts: rows (length, first rank, pieces, first sequence, offset, pieces per sequence).

    Sequences that hold the same lengths are kept as one range, so the work and the plan grow with the number of
    lengths, not with the number of pieces.
    """
    room: list[int] = []  # distinct remaining sizes, sorted
    open_: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in open_:
                insort(room, left)
                open_[left] = []
            open_[left].append((first, n))

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 1
        while n:
            at = bisect_left(room, length)
            if at == len(room):
                left, bins = size, -(-n // (size // length))
                first, sequences = sequences, sequences + bins
            else:
                left = room[at]
                first, bins = open_[left].pop()
                if not open_[left]:
                    del open_[left], room[at]
            each = left // length
            full = min(bins, n // each)
            if full:
                out.append((length, rank, full * each, first, size - left, each))
                put(left - each * length, first, full)
                rank, n, first, bins = rank + full * each, n - full * each, first + full, bins - full
            if bins and n:
                out.append((length, rank, n, first, size - left, n))
                put(left - n * length, first, 1)
                n, first, bins = 0, first + 1, bins - 1
            put(left, first, bins)
    return out


def pack(pieces: DataFrame, size: int = 4096, order: Sequence[str] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """Give each row of ``pieces`` a sequence_id and an offset; sequences hold at most ``size`` and have no gaps.

    ``pieces`` is scanned twice (once for the histogram), so store it first when it is dear to make. Lengths are from
    1 to ``size``; others raise. Rows that tie in ``order`` take their slots in any order. Columns of the same names
    as the two new ones are replaced. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `size` rows
    if any(n is None or not 1 <= n <= size for n in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    ranges = spark.createDataFrame(plan(counts, size), "__length long, __rank long, __n long, __first long, __offset long, __each long")
    blocks = ranges.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {BLOCK_SLOTS}"))))
    j = F.explode(F.sequence(F.col("__block") * BLOCK_SLOTS, F.least(F.col("__n"), (F.col("__block") + 1) * BLOCK_SLOTS) - 1))
    slots = blocks.repartition("__first", "__offset", "__block").withColumn("__j", j).select(
        "__length", (F.col("__rank") + F.col("__j")).alias("__rank"), (F.col("__first") + F.expr("__j div __each")).alias("sequence_id"),
        (F.col("__offset") + F.col("__j") % F.col("__each") * F.col("__length")).alias("offset"),
    )
    cells = spark.createDataFrame([(n, -(-c // CELL_ROWS)) for n, c in counts.items()], "__length long, __cells long")
    by = [f"__by{i}" for i in range(len(order))]
    rows = pieces.select(F.struct(*pieces.columns).alias("__row"), F.col(length).cast("long").alias("__length"), *(F.col(c).alias(b) for c, b in zip(order, by)))
    celled = rows.join(F.broadcast(cells), "__length").withColumn("__cell", F.pmod(F.xxhash64(*by), "__cells"))
    ranked = rank_in_cells(celled.drop("__cells"), F.col("__cell"), ["__length"], by, "__rank")
    return ranked.join(slots, ["__length", "__rank"]).select("__row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, control: bool = False) -> DataFrame:
    """Pieces of all documents with their place and a checksum; the ids themselves stay in the stored piece table."""
    pieces = store(token_pieces(docs, tokenizer, size, end_id, control=control), "pieces")
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests, size)
