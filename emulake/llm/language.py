"""Language of texts and of the spans in them.

Letters are looked up in a table of script ranges; a language is a candidate for a word only if the word's script is one
that the language was seen in. Words are scored per language by smoothed log-probabilities of hashed character
n-grams, counted over all training texts. Viterbi over the words of a text, with a penalty for each switch, labels
spans. A text's language is the one with most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import fold, scan_tasks, slices, summed, texts_of, typed, worker_value

BUCKETS = 1 << 15
GRAM = 3
SWITCH = 12.0  # log-probability that a change of language costs
SMOOTH = 0.5
SCRIPT_SHARE = 0.001  # of a language's letters that makes a script its own
WORDS_AT_ONCE = 400_000
#: First code points of script ranges and their scripts, in order; each range ends where the next one begins.
SCRIPTS = ["other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai", "georgian", "hangul", "kana", "han"]
RANGES = [
    (0x0000, "other"), (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x32000, "other"),
]


def _letters() -> np.ndarray:
    """Script number plus one of every letter, 0 for other code points."""
    table = np.zeros(0x110000, dtype=np.uint8)
    ends = [start for start, _ in RANGES[1:]] + [0x110000]
    for (start, script), end in zip(RANGES, ends):
        table[start:end] = SCRIPTS.index(script) + 1
    letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x32000)), dtype=bool, count=0x32000)
    table[:0x32000][~letter] = 0
    table[0x32000:] = 0
    return table


class Words:
    """The words (runs of letters) of several texts, and the n-grams of each, as flat arrays."""

    def __init__(self, texts: list[str]) -> None:
        script_of = worker_value("letters", (), _letters)
        lowered = [t.lower() for t in texts]
        c = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        script = script_of[c]
        on = script > 0
        edge = np.flatnonzero(on[1:] != on[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        bounds = np.cumsum([1, *(len(t) + 1 for t in lowered)])
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        self.n_docs, self.n = len(texts), len(self.start)
        self.length = self.end - self.start
        self.bounds, self.script = bounds, script[self.start] - 1 if self.n else np.zeros(0, dtype=np.int64)
        # an n-gram belongs to the word of its middle letter; what is around a word counts as one mark
        m = np.where(on, c, np.uint32(32))
        h = m[:-2] * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) + m[1:-1]
        h = h * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) + m[2:]
        h = h * np.uint32(0xC2B2AE35)
        inner = on[1:-1]
        self.grams = ((h ^ (h >> np.uint32(16))) & np.uint32(BUCKETS - 1))[inner].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1] if self.n else np.zeros(0, dtype=np.int64)
        self.letter_script = script[on].astype(np.int64) - 1
        self.letter_doc = np.repeat(self.doc, self.length)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about WORDS_AT_ONCE words at most, or one text."""
    for batch in slices(batches, 1000):
        sizes = np.cumsum([len(t) for t in texts_of(batch)]) // (6 * WORDS_AT_ONCE)
        for at in np.unique(sizes):
            own = np.flatnonzero(sizes == at)
            yield batch.slice(int(own[0]), len(own))


@dataclass
class LanguageModel:
    languages: list[str]
    score: np.ndarray  # languages x buckets
    scripts: np.ndarray  # languages x scripts, whether the language is a candidate

    def spans(self, texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words, the language number of each, and the margin of each over the next best candidate."""
        w = Words(texts)
        if not w.n:
            return w, np.zeros(0, dtype=np.int64), np.zeros(0)
        emit = np.stack([np.add.reduceat(s[w.grams], w.first) for s in self.score])
        allowed = self.scripts[:, w.script]
        allowed |= ~allowed.any(axis=0)  # a script that no language has leaves all
        emit = np.where(allowed, emit, emit - 50.0 * w.length)
        label = self._viterbi(emit, w)
        rest = emit.copy()
        rest[label, np.arange(w.n)] = -np.inf
        margin = emit[label, np.arange(w.n)] - rest.max(axis=0) if len(self.languages) > 1 else np.full(w.n, 1.0)
        return w, label, margin

    def _viterbi(self, emit: np.ndarray, w: Words) -> np.ndarray:
        """Best labels of the words of all texts, advanced one word at a time in all texts together."""
        count = np.bincount(w.doc, minlength=w.n_docs)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        order = np.argsort(-count, kind="stable")
        sizes, begin = count[order], begin[order]
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
        back = np.full(emit.shape, -1, dtype=np.int16)
        state = emit[:, begin[: live[0]]].copy()
        final = np.zeros(w.n_docs, dtype=np.int64)
        for t in range(1, int(sizes[0])):
            gone, k = live[t - 1], live[t]
            if k < gone:
                final[k:gone] = state[:, k:gone].argmax(axis=0)
                state = state[:, :k]
            at = begin[:k] + t
            top = state.argmax(axis=0)
            jump = state[top, np.arange(k)] - SWITCH
            switch = jump > state
            back[:, at] = np.where(switch, top, -1)
            state = np.maximum(state, jump) + emit[:, at]
        final[: state.shape[1]] = state.argmax(axis=0)
        label = np.empty(emit.shape[1], dtype=np.int64)
        now = final
        for t in range(int(sizes[0]) - 1, -1, -1):
            k = live[t]
            at = begin[:k] + t
            label[at] = now[:k]
            b = back[now[:k], at]
            now[:k] = np.where(b >= 0, b, now[:k])
        return label


def fit_language(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", modulus: int = 4, out: int = 2) -> LanguageModel | None:
    """Count n-grams and scripts per language over all rows with a language whose key's crc32 isn't ``out`` modulo ``modulus``.

    Counts are summed over the partitions; their size is the number of languages times a constant. None without such rows.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).where(fold(key, modulus) != out).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())  # languages are few
    if not languages:
        return None
    size = len(SCRIPTS) + BUCKETS

    def block(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in groups(batches):
            w = Words(texts_of(batch))
            own = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])[w.letter_doc]
            total = np.zeros((len(languages), size)) if total is None else total
            total[:, : len(SCRIPTS)] += np.bincount(own * len(SCRIPTS) + w.letter_script, minlength=len(languages) * len(SCRIPTS)).reshape(len(languages), -1)
            total[:, len(SCRIPTS) :] += np.bincount(own * BUCKETS + w.grams, minlength=len(languages) * BUCKETS).reshape(len(languages), -1)
        return total

    sums = summed(known, block, scan_tasks(known))
    sums = np.zeros(len(languages) * size) if sums is None else sums
    counts = sums.reshape(len(languages), size)
    scripts, grams = counts[:, : len(SCRIPTS)], counts[:, len(SCRIPTS) :]
    smooth = np.log(grams + SMOOTH) - np.log(grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return LanguageModel(languages, smooth, scripts > SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True))


def language_spans(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) with spans of (start, end, lang) in code points of the lower-cased text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in groups(batches):
            w, label, _ = model.spans(texts_of(batch))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if w.n:
                new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])]))
                last = np.append(new[1:], w.n) - 1
                for a, b in zip(new, last):
                    d = w.doc[a]
                    found[d].append({"start": int(w.start[a] - w.bounds[d]), "end": int(w.end[b] - w.bounds[d]), "lang": model.languages[label[a]]})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "spans"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{typed(docs, key)}, spans array<struct<start:int,end:int,lang:string>>")


def detect_language(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): the language with most letters, and its share of letters times how sure its words are.

    ``und`` with score 0 for NULL texts, texts without letters, and when there is no model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            n = batch.num_rows
            names, score = ["und"] * n, np.zeros(n)
            if model:
                w, label, margin = model.spans(texts_of(batch))
                k = len(model.languages)
                letters = np.bincount(w.doc * k + label, weights=w.length, minlength=n * k).reshape(n, k)
                sure = np.bincount(w.doc * k + label, weights=margin, minlength=n * k).reshape(n, k)
                best, total = letters.argmax(axis=1), letters.sum(axis=1)
                own = np.arange(n), best
                score = np.where(total > 0, letters[own] / np.maximum(total, 1) / (1 + np.exp(-np.clip(sure[own], -40, 40))), 0.0)
                names = [model.languages[b] if t > 0 else "und" for b, t in zip(best, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(score)], names=[key, "lang_pred", "score"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{typed(docs, key)}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    return detect_language(docs, fit_language(docs)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
