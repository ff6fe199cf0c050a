"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers see the same bytes, so their tokens are two lists of end offsets. An interval between two shared ends is cut
at a shared end near its middle, which bisection finds: from the middle end of one list to the next end of the other and
back, first to the right, then to the left. Both halves are cut in turn; an interval without a shared end inside is a leaf,
a group of tokens. All intervals of one depth, of all texts of a batch, are cut together.

A text is encoded in units: it is cut before a single space between two characters that are not white space, where
neither tokenizer has a token that reaches across. Each worker keeps the ids of the units it has met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import slices, store, texts_of, typed, worker_value

CUT = re.compile(r"(?<=\S) (?=\S)")
#: A text without these is cut at every space.
UNEVEN = re.compile(r"^\s|\s\s|\s$")
#: Units whose ids a worker keeps, and their characters at most. Others are encoded where they occur.
KEPT_UNITS, KEPT_CHARS = 150_000, 48
#: Characters of new units encoded together.
JOINED = 20_000
#: Tokens of the byte tokenizer aligned together, but for one longer text.
ALIGNED = 250_000
#: The space of sentence pieces, and the form of their byte pieces.
PIECE_SPACE, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, others follow from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens(NamedTuple):
    """Ids of one text by both tokenizers, and for each of its units how many of each."""

    a: np.ndarray
    b: np.ndarray
    units_a: np.ndarray
    units_b: np.ndarray


class TwoTokenizers:
    """Ids of texts by a byte-level BPE file (A, of space and text) and a sentence-piece model (B), and the bytes of their tokens."""

    def __init__(self, bpe_path: str, piece_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        hexed = [BYTE_PIECE.fullmatch(p) for p in pieces]
        self.bytes_b = [bytes([int(h[1], 16)]) if h else p.replace(PIECE_SPACE, " ").encode() for p, h in zip(pieces, hexed)]
        self.size_a, self.size_b = (np.array([len(t) for t in ts], dtype=np.int64) for ts in (self.bytes_a, self.bytes_b))
        # no piece goes on after a space inside, else texts stay whole
        self.cuts = not any(re.search(f"[^{PIECE_SPACE}]{PIECE_SPACE}", p) for p in pieces)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.odd: set[str] = set()  # units whose tokens stand for other bytes
        comma, bar, semicolon = (np.array([f"{i}{end}" for i in range(max(len(self.bytes_a), len(pieces)))], dtype=object) for end in ",|;")
        self.written = comma, bar, semicolon

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text behind a space, None where the tokens stand for other bytes."""
        spaced = " " + text
        of_a, of_b = self.a.encode_batch_fast([spaced], add_special_tokens=False)[0].ids, self.b.encode(text)
        want = spaced.encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[i] for i in of_a]) != want or b"".join([self.bytes_b[i] for i in of_b]) != want:
            return None
        return np.array(of_a, dtype="<i4"), np.array(of_b, dtype="<i4")

    def learn(self, units: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of units as little-endian 32-bit bytes; those that are not as they should be go to ``odd``.

        Units are encoded many at a time, as one text in which they stand one space apart, and cut where they end.
        """
        out: dict[str, tuple[bytes, bytes]] = {}
        group, size = [], 0
        for u in chain(units, [None]):
            if u is None or size > JOINED:
                self._learn_group(group, out)
                group, size = [], 0
            if u is not None:
                if self.cuts and not u[0].isspace() and not u[-1].isspace():
                    group.append(u)
                    size += len(u)
                else:
                    self._learn_group([u], out)
        return out

    def _learn_group(self, group: list[str], out: dict[str, tuple[bytes, bytes]]) -> None:
        found = self._encoded(" ".join(group)) if group else None
        if found is None:
            if len(group) == 1:
                self.odd.add(group[0])
                out[group[0]] = b"", b""
            for u in group if len(group) > 1 else []:
                self._learn_group([u], out)
            return
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in group])
        parts = []
        for ids, sizes in zip(found, (self.size_a, self.size_b)):
            places = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
            raw, edges = ids.tobytes(), [0, *(4 * places).tolist()]
            parts.append([raw[p:q] for p, q in zip(edges, edges[1:])])
        out.update(zip(group, zip(*parts)))

    def encode(self, texts: list[str]) -> list[Tokens]:
        """Tokens of each text; none where the text is empty or where they stand for other bytes."""
        cut = [([t] if not self.cuts else CUT.split(t) if UNEVEN.search(t) else t.split(" ")) if t else [] for t in texts]
        known = self.known
        learnt = self.learn(list(set(chain.from_iterable(cut)).difference(known)))
        short = {u: v for u, v in learnt.items() if len(u) <= KEPT_CHARS}
        if len(known) + len(short) <= KEPT_UNITS:
            known.update(short)
        out = []
        for units in cut:
            if self.odd and not self.odd.isdisjoint(units):
                units = []
            try:
                found = [known[u] for u in units]
            except KeyError:
                found = [known[u] if u in known else learnt[u] for u in units]
            of_a, of_b = zip(*found) if found else ((), ())
            counts = [np.fromiter(map(len, part), dtype=np.int64, count=len(part)) // 4 for part in (of_a, of_b)]
            out.append(Tokens(np.frombuffer(b"".join(of_a), dtype="<i4"), np.frombuffer(b"".join(of_b), dtype="<i4"), *counts))
        if len(self.odd) > KEPT_UNITS:
            self.odd.difference_update({u for u in self.odd if u not in known})
        return out


def leapfrog(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, olo: np.ndarray, ohi: np.ndarray, start: np.ndarray, step: int) -> np.ndarray:
    """For each interval the place in ``x`` of the shared end nearest to ``start`` on one side (``step`` 1: right, -1: left), or -1.

    x and y are sorted ends; the inner ends of an interval are x[lo:hi] and y[olo:ohi]. Each round bisects one list for the
    end where the other stands.
    """
    found = np.full(len(start), -1, dtype=np.int64)
    live, at = np.arange(len(start)), start.copy()
    while len(live):
        here = x[at]
        j = np.searchsorted(y, here, "left") if step > 0 else np.searchsorted(y, here, "right") - 1
        inside = (j < ohi[live]) & (j >= olo[live])
        live, here, j = live[inside], here[inside], j[inside]
        there = y[j]
        i = np.searchsorted(x, there, "left") if step > 0 else np.searchsorted(x, there, "right") - 1
        inside = (i < hi[live]) & (i >= lo[live])
        live, there, i = live[inside], there[inside], i[inside]
        met = x[i] == there
        found[live[met]] = i[met]
        live, at = live[~met], i[~met]
    return found


def shared_cuts(x: np.ndarray, y: np.ndarray, last_x: np.ndarray, last_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and in ``y`` of all ends that both hold, in order.

    x and y are increasing ends; last_x and last_y are the places of ends known to be shared, the last of the lists among them.
    """
    lo, olo = np.append(0, last_x[:-1] + 1), np.append(0, last_y[:-1] + 1)
    hi, ohi = last_x, last_y  # the inner ends of an interval stop before its shared one
    cuts_x, cuts_y = [last_x], [last_y]
    while len(lo):
        inner = (hi > lo) & (ohi > olo)
        lo, hi, olo, ohi = lo[inner], hi[inner], olo[inner], ohi[inner]
        middle = (lo + hi) // 2
        i = leapfrog(x, y, lo, hi, olo, ohi, middle, 1)
        left = np.flatnonzero(i < 0)
        i[left] = leapfrog(x, y, lo[left], hi[left], olo[left], ohi[left], middle[left], -1)
        cut = i >= 0  # others have no cut: leaves
        i, lo, hi, olo, ohi = i[cut], lo[cut], hi[cut], olo[cut], ohi[cut]
        j = np.searchsorted(y, x[i])
        cuts_x.append(i)
        cuts_y.append(j)
        lo, hi, olo, ohi = np.append(lo, i + 1), np.append(i, hi), np.append(olo, j + 1), np.append(j, ohi)
    return np.sort(np.concatenate(cuts_x)), np.sort(np.concatenate(cuts_y))


def _offsets(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def aligned(two: TwoTokenizers, tokens: list[Tokens]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Groups of each text as written (``a1,a2|b1;a3|b2,b3``), the ids (a, b) of the links of all texts, and the places where each text's links begin."""
    a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
    x, y = np.cumsum(two.size_a[a]), np.cumsum(two.size_b[b])
    # units end at shared ends
    cut_x, cut_y = shared_cuts(x, y, *(np.cumsum(np.concatenate([t[k] for t in tokens])) - 1 for k in (2, 3)))
    comma, bar, semicolon = two.written
    words = np.empty(len(a) + len(b), dtype=object)
    in_a, in_b = np.diff(cut_x, prepend=-1), np.diff(cut_y, prepend=-1)  # tokens of each group
    before_b, before_a = np.repeat(np.cumsum(in_b) - in_b, in_a), np.repeat(np.cumsum(in_a), in_b)  # those of the other side that stand before
    text_a, text_b = comma[a], comma[b]
    text_a[cut_x], text_b[cut_y] = bar[a[cut_x]], semicolon[b[cut_y]]
    words[np.arange(len(a)) + before_b], words[np.arange(len(b)) + before_a] = text_a, text_b
    edges = _offsets([len(t.a) + len(t.b) for t in tokens])
    groups = ["".join(words[p:q].tolist())[:-1] for p, q in zip(edges, edges[1:])]
    begins = np.searchsorted(cut_x, _offsets([len(t.a) for t in tokens]))
    return groups, a[cut_x], b[cut_y], begins


def _blocks(tokens: list[Tokens]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(tokens):
        if total and total + len(t.a) > ALIGNED:
            yield start, i
            start, total = i, 0
        total += len(t.a)
    yield start, len(tokens)


def align(docs: DataFrame, bpe_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, groups, links) of every row: token counts, the groups as text, and for each link a number a << 32 | b.

    A link is a pair of tokens, one of each tokenizer, whose byte ranges end together; as no token is empty, each shared
    end makes one. NULL and empty texts, and texts whose tokens stand for other bytes than a space and the text, have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = worker_value("two_tokenizers", (bpe_path, piece_path), lambda: TwoTokenizers(bpe_path, piece_path))
        for batch in slices(batches, 200):
            tokens = two.encode(texts_of(batch))
            for p, q in _blocks(tokens):
                part = tokens[p:q]
                groups, a, b, begins = aligned(two, part)
                links = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(a.astype(np.int64) << 32 | b))
                counts = [pa.array([len(t[k]) for t in part], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p, q - p), *counts, pa.array(groups, pa.string()), links], names=[key, "n_a", "n_b", "groups", "links"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{typed(docs, key)}, n_a long, n_b long, groups string, links array<long>")


def link_counts(aligned_docs: DataFrame) -> DataFrame:
    """(link, n) over all documents. Of two tokens that end together the shorter is a suffix of the longer, so there are fewer
    rows than the two vocabularies have bytes, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            got, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            both, at = np.unique(np.concatenate([seen, got]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, times]), minlength=len(both)).astype(np.int64)
            seen = both
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], names=["link", "n"])

    return aligned_docs.select("links").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def link_scores(aligned_docs: DataFrame) -> DataFrame:
    """``aligned_docs`` (which has ``links`` and is read twice) with n_best and count_sum (long) in the place of links.

    n_best counts the links whose corpus-wide count is the highest of all with their B id, ties included; count_sum adds the counts
    of all links. The counts, which the vocabularies bound, go to every task.
    """
    rows = link_counts(aligned_docs).toArrow()
    order = np.argsort(link := rows.column("link").to_numpy())
    counts = aligned_docs.sparkSession.sparkContext.broadcast((link[order], rows.column("n").to_numpy()[order]))
    names = [c for c in aligned_docs.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = counts.value
        piece = known & 0xFFFFFFFF
        top = np.zeros(int(piece.max(initial=-1)) + 1, dtype=np.int64)
        np.maximum.at(top, piece, n)
        best = n == top[piece]
        for batch in slices(batches, 2_000):
            lists = batch.column("links")
            at = np.searchsorted(known, lists.flatten().to_numpy())
            edges = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            sums = [np.append(0, np.cumsum(v[at], dtype=np.int64)) for v in (best, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(np.diff(s[edges])) for s in sums)], names=[*names, "n_best", "count_sum"])

    return aligned_docs.mapInArrow(run, f"{typed(aligned_docs, *names)}, n_best long, count_sum long")


def alignment_report(docs: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """One row per row of ``docs`` with the counts of its tokens, groups and links; zeros and '' where it has no tokens."""
    found = align(docs, bpe_path, piece_path)
    brief = found.select(
        "doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), F.size("links").cast("long").alias("n_links"),
        F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256"), "links",
    )
    scored = link_scores(store(brief, "aligned"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
