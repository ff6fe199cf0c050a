"""Byte-level BPE by corpus-level merge replay.

The distinct units of a corpus (what stands between single spaces) are counted once for all documents. The words of the
most frequent ones, a bounded number, are merged together in tasks that replay the merges: an inverted index from rank
to the positions whose token pair makes that rank is emptied in rank order, and each merge re-indexes only its two
neighbours. Short words hold their indices side by side, and one round empties the lowest place of each. The resulting
table of units and ids is small enough to go to every worker. Rare units are replayed in the same way by the task that
meets them, all of a batch together. Encoding is then a look-up per unit.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import binary_column, slices, store, texts_of, typed, worker_value

#: Units in the corpus table at most. Those beyond it are encoded where they occur.
TABLE_UNITS = 400_000
#: Further units whose ids a worker keeps.
KEPT_UNITS = 200_000
#: Units counted in a task before the counts are passed on.
COUNTED_UNITS = 200_000
SHIFT = 20  # bits of an id in the key of a pair
#: Words of up to so many bytes are replayed side by side, those of about the same size at a time, and so many words together.
SHORT, BESIDE = (10, 14, 20, 40), 8_192
PLACE = 6  # bits of a place in a short word
NEVER = np.iinfo(np.int64).max
TWO_SPACES = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A pattern under which a space and letters are one match, and the signs behind them another.
SPACED_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """The merges of a rank file: which two adjacent ids make which token, and the ids of single bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = (
            (left << SHIFT | right, rank)
            for token, rank in ranks.items() for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        )
        self.pairs: dict[int, int] = dict(found)
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.none = max(ranks.values(), default=0) + 1  # an id that no pair has
        self.bits = max(10, (4 * len(self.keys)).bit_length())
        self.slots, left = np.full((1 << self.bits) + 1, -1, dtype=np.int32), np.arange(len(self.keys), dtype=np.int32)
        self.probes, at = 0, self._slot(self.keys)
        while len(left):  # pairs whose slot is taken go to the next one
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            away = self.slots[at] != left
            left, at, self.probes = left[away], (at[away] + 1) & ((1 << self.bits) - 1), self.probes + 1
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.single < 0).any():
            raise ValueError("the rank file lacks single bytes")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place in one number, so that the least is the first to merge; NEVER where the pair makes no token."""
        out = np.full(len(left), NEVER, dtype=np.int64)
        if not len(self.keys):
            return out
        keys = left << SHIFT | right
        at, live = self._slot(keys), np.arange(len(left))
        for _ in range(self.probes):
            spot = self.slots[at]
            there = spot >= 0
            if not there.all():
                live, at, keys, spot = live[there], at[there], keys[there], spot[there]
            met = self.keys[spot] == keys
            found = live[met]
            out[found] = self.made[spot[met]] << PLACE | place[found]
            away = ~met
            live, at, keys = live[away], (at[away] + 1) & ((1 << self.bits) - 1), keys[away]
            if not len(live):
                break
        return out


def replay_short(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """As ``replay``, for words of one byte to SHORT[-1] bytes: a column for each word, and in it the rank and place of every pair.

    A round merges in each word the leftmost pair of lowest rank and re-indexes only its two neighbours. The first and
    the last row belong to no word.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    n, rows = len(words), int(sizes.max()) + 2
    flat = merges.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
    column = np.repeat(np.arange(n), sizes)
    row = np.arange(1, len(flat) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    token = np.full((rows, n), merges.none, dtype=np.int64)
    token[row, column] = flat
    index = np.full((rows, n), NEVER, dtype=np.int64)
    index[row, column] = merges.places(flat, token[row + 1, column], row)
    left, right = (np.repeat(np.arange(rows, dtype=np.int8)[:, None] + step, n, axis=1) for step in (-1, 1))
    done = token  # of all words; token, index, left and right hold those not yet merged
    which = np.arange(n)
    while True:
        least = index.min(axis=0)
        live = np.flatnonzero(least != NEVER)
        if not len(live):
            break
        if len(live) < 0.7 * len(least):
            if done is not token:
                done[:, which] = token
            which, least, token, index, left, right = which[live], least[live], token[:, live], index[:, live], left[:, live], right[:, live]
            live = np.arange(len(live))
        else:
            least = least[live]
        i, made = least & ((1 << PLACE) - 1), least >> PLACE
        j = right[i, live].astype(np.int64)
        after, before = right[j, live].astype(np.int64), left[i, live].astype(np.int64)
        token[i, live] = made
        token[j, live] = -1
        index[j, live] = NEVER
        right[i, live] = after
        left[after, live] = i
        index[np.append(before, i), np.append(live, live)] = merges.places(np.append(token[before, live], made), np.append(made, token[after, live]), np.append(before, i))
    if done is not token:
        done[:, which] = token
    by_word = done[1:-1].T
    kept = (by_word >= 0) & (by_word != merges.none)
    ids = by_word[kept].astype("<u4")
    ends = np.cumsum(kept.sum(axis=1))
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def replayed(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """Ids of each word after all merges: short words side by side, the long ones by ``replay``."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    group = np.searchsorted(SHORT, size)
    group[size == 0] = len(SHORT)
    out: list = [None] * len(words)
    for g in np.unique(group).tolist():
        members = np.flatnonzero(group == g).tolist()
        for at in range(0, len(members), BESIDE if g < len(SHORT) else len(members)):
            part = members[at : at + BESIDE] if g < len(SHORT) else members
            for k, ids in zip(part, (replay_short if g < len(SHORT) else replay)([words[k] for k in part], merges)):
                out[k] = ids
    return out


def replay(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """Ids of each word after all merges, applied in rank order to all words at once.

    Positions are bytes of the concatenated words, linked to their neighbours. ``index[r]`` lists the positions whose id and
    right neighbour's id make r. A position may be outdated; it counts only if its pair still makes r. A merge that
    opens a smaller rank sends the rest of its list back, so the order is exact.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(words) else 0
    ids = merges.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
    links = np.arange(n + 1)
    left, right = links[:n] - 1, links[:n] + 1
    full = sizes > 0
    left[(ends - sizes)[full]] = -1
    right[ends[full] - 1] = -1
    keys = np.where(right >= 0, ids << SHIFT | np.append(ids[1:], 0)[:n], -1)
    spot = np.minimum(np.searchsorted(merges.keys, keys), max(0, len(merges.keys) - 1))
    place = np.flatnonzero(merges.keys[spot] == keys) if n and len(merges.keys) else np.zeros(0, dtype=np.int64)
    made = merges.made[spot[place]] if len(place) else place
    order = np.argsort(made, kind="stable")
    place, made = place[order], made[order]
    cuts = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1]])) if len(made) else made
    index = {int(made[a]): place[a:b].tolist() for a, b in zip(cuts, [*cuts[1:], len(made)])}
    heap = sorted(index)
    token, left, right, rank_of = ids.tolist(), left.tolist(), right.tolist(), merges.pairs.get
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        places.sort()
        for k, i in enumerate(places):
            j = right[i]
            if j < 0 or token[i] < 0 or rank_of(token[i] << SHIFT | token[j]) != r:
                continue
            token[i], token[j] = r, -1
            right[i] = after = right[j]
            smaller = False
            if after >= 0:
                left[after] = i
                s = rank_of(r << SHIFT | token[after])
                if s is not None:
                    if s in index:
                        index[s].append(i)
                    else:
                        index[s] = [i]
                        heapq.heappush(heap, s)
                    smaller = s < r
            before = left[i]
            if before >= 0:
                s = rank_of(token[before] << SHIFT | r)
                if s is not None:
                    if s in index:
                        index[s].append(before)
                    else:
                        index[s] = [before]
                        heapq.heappush(heap, s)
                    smaller = smaller or s < r
            if smaller and k + 1 < len(places):
                index[r] = places[k + 1 :]
                heapq.heappush(heap, r)
                break
    done = np.array(token, dtype=np.int64)
    kept = np.concatenate([[0], np.cumsum(done >= 0)])
    flat, edges = done[done >= 0].astype("<u4"), kept[np.append(0, ends)]
    return [flat[a:b] for a, b in zip(edges, edges[1:])]


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of ``pattern``; white space is Unicode's, which excludes the control characters 1C to 1F."""
    import regex

    return regex.compile(pattern.replace(r"\S", r"[^\p{White_Space}]").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall


def units_of(text: str) -> list[str]:
    """Stretches of a text that no match of a pattern with optional leading space reaches beyond: cut before single spaces
    between characters that are not white space, so that each begins with the space before it. An empty text is one unit."""
    uneven = TWO_SPACES.search(text) or text[:1].isspace() or text[-1:].isspace()
    first, *rest = CUT.split(text) if uneven else text.split(" ")
    return [first, *[" " + u for u in rest]]


class Units(dict):
    """Ids of units that a worker keeps; others are looked up in ``learnt``, which holds for a batch."""

    learnt: dict[str, bytes]

    def __missing__(self, unit: str) -> bytes:
        return self.learnt[unit]


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, from the corpus table and what a worker has met so far."""

    def __init__(self, ranks_path: str, pattern: str, table: Iterable[tuple[str, bytes]]) -> None:
        ranks = read_ranks(ranks_path)
        self.merges, self.split, self.known = Merges(ranks), splitter(pattern), Units(table)
        self.room, self.plain = len(self.known) + KEPT_UNITS, LETTERS.fullmatch if pattern == SPACED_LETTERS else lambda u: None
        self.token = np.full(max(ranks.values()) + 1, b"", dtype=object)
        for token, rank in ranks.items():
            self.token[rank] = token

    def learn(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of ``units``; their distinct words are replayed together."""
        plain, split = self.plain, self.split
        cut = {u: (split(u) if m is None else m.groups() if m[2] else (u,)) for u in units for m in (plain(u),)}
        words = list(set(chain.from_iterable(cut.values())))
        ids = {w: i.tobytes() for w, i in zip(words, replayed([w.encode("utf-8", "surrogatepass") for w in words], self.merges))}
        return {u: ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for u, ws in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, known = [units_of(t) for t in texts], self.known
        learnt = known.learnt = self.learn(set(chain.from_iterable(cut)).difference(known))
        find = known.__getitem__
        out = [b"".join(map(find, us)) for us in cut]
        if len(known) < self.room:
            known.update(islice(((u, i) for u, i in learnt.items() if len(u) < 64), self.room - len(known)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.token[ids].tolist())


def frequent_units(docs: DataFrame, most: int = TABLE_UNITS, text: str = "text") -> DataFrame:
    """(unit) for the most frequent units of the whole corpus: all that occur at least c times, where c is the smallest
    count with no more than ``most`` such units. Units of 64 characters or more are left to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

        for batch in slices(batches):
            for t in texts_of(batch):
                seen.update(units_of(t))
            if len(seen) > COUNTED_UNITS:
                yield out()
                seen.clear()
        yield out()

    counts = store(docs.select(F.col(text).alias("text")).mapInArrow(run, "unit string, n long").where("length(unit) between 1 and 63").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1"), "units")
    # counts above 4096 share their power of two, so the histogram has a bounded number of rows
    level = F.when(F.col("n") <= 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.where(F.col("n") >= (least if least is not None else 1 << 62)).select("unit")


def unit_table(units: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(unit, ids): the merges replayed over all units of a partition together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern, ())
        for batch in slices(batches, 50_000):
            got = encoder.learn(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), binary_column(list(got.values()))], names=["unit", "ids"])

    return units.mapInArrow(run, "unit string, ids binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", table_units: int = TABLE_UNITS, decoded: str | None = None) -> DataFrame:
    """(key, ids) of every whole text, ids as an array; NULL text is empty and has no ids.

    The corpus table that goes to every worker has at most ``table_units`` rows of less than 64 characters each. With
    ``decoded``, a column of that name has the bytes that the ids stand for, made by the same worker.
    """
    spark = docs.sparkSession
    rows = unit_table(frequent_units(docs, table_units, text), ranks_path, pattern).toArrow()
    table = spark.sparkContext.broadcast((rows.column("unit").to_pylist(), rows.column("ids").to_pylist()))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_value("bpe", (name,), lambda: Encoder(ranks_path, pattern, zip(*table.value)))
        for batch in slices(batches):
            parts = encoder.encode(texts_of(batch))
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            flat = np.frombuffer(b"".join(parts), dtype="<i4")
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                columns.append(binary_column([encoder.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])]))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", decoded][: len(columns)])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{typed(docs, key)}, ids array<int>" + (f", `{decoded}` binary" if decoded else ""))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; NULL ids are empty. A column of that name is replaced."""
    encoded = encoded.drop(out)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> np.ndarray:
            ranks = read_ranks(ranks_path)
            table = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            return np.array(table, dtype=object)

        token = worker_value("bpe_tokens", (ranks_path,), make)
        for batch in slices(batches, 200):
            lists = batch.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = [b"".join(token[flat[a:b]].tolist()) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), binary_column(texts)], names=[*names, out])

    return encoded.mapInArrow(run, f"{typed(encoded, *names)}, `{out}` binary")


def bpe_report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    both = encode(docs, ranks_path, pattern, decoded="bytes")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
