"""Licence scan: Aho-Corasick for notice phrases and identifier tags, a shunting-yard parser for tag expressions.

One automaton holds all phrases as sequences of words and is run over the words of a text, so a text is read once whatever
the number of phrases. Where it meets an identifier tag, the expression after the tag is parsed with the precedence with >
and > or and evaluated to its licences and to whether one choice of them is all permissive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import slices, texts_of, typed, worker_value

# Phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases as words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd",
    "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "boost software license": "bsl", "unlicense": "unlicense", "creative commons attribution": "cc-by",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "all rights reserved": "proprietary",
}
#: Identifier families (the start of an identifier in lower case) and their labels.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "mpl": "mpl", "epl": "epl",
    "bsl": "bsl", "unlicense": "unlicense", "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "zlib": "zlib",
}
PERMISSIVE = {"mit", "apache", "bsd", "isc", "bsl", "unlicense", "cc0", "cc-by", "zlib"}
TAG = "spdx license identifier"
TAG_AT = re.compile(r"spdx[^\w]?license[^\w]?identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.\-+:]*")
RANK = {"or": 1, "and": 2, "with": 3}
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and lower-case operators in postfix order. Raises ValueError if it is no expression.

    What follows a complete expression on the line (a comment's end, say) is ignored.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand comes next
    for m in TOKEN.finditer(expression):
        t = m[0]
        low = t.lower()
        if operand:
            if t == "(":
                stack.append(t)
            elif low in RANK or t == ")":
                raise ValueError(f"{t} where a licence belongs")
            else:
                out.append(t)
                operand = False
        elif low in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif t == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif "(" in stack:
            raise ValueError(f"{t} where an operator belongs")
        else:
            break
    if operand or "(" in stack:
        raise ValueError("incomplete expression")
    return out + stack[::-1]


def label_of(identifier: str) -> str:
    """The label of the longest family that begins the identifier; the identifier in lower case if there is none."""
    low = identifier.lower().rstrip("+")
    found = [f for f in FAMILIES if low == f or low.startswith(f + "-")]
    return FAMILIES[max(found, key=len)] if found else low.replace(",", " ")


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """Labels of an expression, and whether a choice at its ors leaves permissive licences only; None if it doesn't parse.
    An exception named after with changes neither."""
    stack: list[tuple[set[str], bool]] = []
    try:
        for t in to_postfix(expression):
            if t in RANK:
                right, left = stack.pop(), stack.pop()
                if t == "with":
                    stack.append(left)
                else:
                    stack.append((left[0] | right[0], left[1] or right[1] if t == "or" else left[1] and right[1]))
            else:
                stack.append(({label_of(t)}, label_of(t) in PERMISSIVE))
    except (ValueError, IndexError):
        return None
    return stack[0] if len(stack) == 1 else None


@dataclass
class Scan:
    words: int = 0
    base: int = 0
    first: int | None = None
    last: int | None = None
    base_labels: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    expressions: list[str] = field(default_factory=list)
    places: int = 0
    permissive: bool = True


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: None}.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def scan(text: str, search) -> Scan:
    """All phrases and tags of a whole text. Words are counted from 0; overlapping phrases all count."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    out, tagged, seen, at = Scan(words=len(words)), False, 0, 0
    longest: dict[int, str] = {}  # the longest notice at each place: "cc by" says nothing more where "cc by nc" stands
    for end, (phrase, label) in search.iter(joined):
        if label is None:
            tagged = True
            continue
        start = end - len(phrase) - 1
        if phrase not in BASE:
            longest[start] = phrase  # of those at one place the longest ends last
            continue
        at, seen = (start, seen + joined.count(" ", at, start)) if start >= at else (start, joined.count(" ", 0, start))
        out.base += 1
        out.base_labels.add(label)
        out.first = seen if out.first is None else min(out.first, seen)
        out.last = seen if out.last is None else max(out.last, seen)
    out.places = out.base + len(longest)
    out.labels |= out.base_labels | {NOTICES[p] for p in longest.values()}
    for m in TAG_AT.finditer(text) if tagged else ():
        value = evaluate(m[1])
        if value:
            out.expressions.append(m[1].strip())
            out.labels |= value[0]
            out.permissive &= value[1]
    out.permissive &= bool(out.labels) and (bool(out.expressions) or out.labels <= PERMISSIVE)
    return out


def score_of(s: Scan) -> float:
    """How sure it is that the text states a licence: a parsed tag leaves 1 in 20 of doubt, each phrase 1 in 2."""
    return 1.0 - 0.05 ** min(len(s.expressions), 8) * 0.5 ** min(s.places, 40)


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions,
    permissive. NULL text is empty: no words, no labels (empty strings), score 0, not permissive."""
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = worker_value("licence_automaton", (), automaton)
        for batch in slices(batches):
            rows = []
            for t in texts_of(batch):
                s = scan(t, search)
                rows.append((s.words, s.base, s.first, s.last, ",".join(sorted(s.base_labels)), ",".join(sorted(s.labels)), score_of(s), s.expressions, s.permissive))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return docs.select(key, F.col(text).alias("text")).mapInArrow(
        run, f"{typed(docs, key)}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean")
