"""Spelling variants, line dedup and tokenizer alignment against brute force, and on awkward input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from emulake.llm import alignment, lines, queries, spelling
from tests.llm.test_operators import AWKWARD, awkward, random_texts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NONE_LAST = lambda r: tuple((x is None, x) for x in r)


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def grouped(counts, ratio=5):
    rows = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(((-counts[x], x) for x in near), default=None)
        rows[w] = (best[1] if best and -best[0] >= ratio * n else None, n, len(near))
    out = set()
    for w, (form, n, near) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, near, counts[form] if form else None))
    return out


def test_spelling_groups_match_all_pairs(spark):
    rng = random.Random(3)
    counts = {}
    for _ in range(12):  # families of variants over few letters, with ties and long chains
        base = "".join(rng.choice("abÿ") for _ in range(rng.randint(7, 11)))
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é"])
            if len(w) >= 6:
                counts["".join(w)] = rng.choice([5, 5, 25, 26, 130, 700, 4000])
    counts |= {"x" * k: 5 * k for k in range(6, 12)} | {"abcdef": 10, "bcdefg": 60, "abcdefg": 300}
    got = spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == grouped(counts)


def test_long_words_meet_words_of_the_trie(spark):
    rng = random.Random(4)
    counts = {}
    for size in (5, 9, 10, 11, 12, 13, 14, 60):
        w = "".join(rng.choice("ab") for _ in range(size))
        counts |= {w: 100, w[:3] + w[4:]: 5, w[:-1]: 20, "c" + w: 7, w[:5] + "c" + w[6:]: 5}
    counts |= {"z" * k: 5 ** (k - 8) for k in range(9, 15)}
    got = spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"), trie_chars=10)
    assert {tuple(r) for r in got.collect()} == grouped(counts)
    long = spark.createDataFrame([("y" * 30_000, 5), ("y" * 29_999, 30)], "word string, n long")
    assert {(len(r.word), len(r.root)) for r in spelling.spelling_groups(long).collect()} == {(30_000, 29_999), (29_999, 29_999)}


def words_of(rows):
    counts = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            at = h % len(low)
            counts[low if h % 199 else low[:at] + low[at + 1 :]] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def test_spelling_query_matches_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {tuple(r) for r in queries.op11_spelling_variants(spark, sf).collect()}
    assert got == grouped(words_of(rows)) and any(r[1] for r in got)
    many = [*AWKWARD * 5, *((50 + i, "ÀBCDEFG àbcdefg Straße×strasse", "en", "s", 1) for i in range(400))]
    got = {tuple(r) for r in spelling.spelling_report(awkward(spark, many)).collect()}
    assert got == grouped(words_of(many))


def kept_lines(rows):
    strip = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for key, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(strip(line)) >= 10:
                holders[strip(line)].add((key is None, key))
    out = []
    for key, text, *_ in rows:
        own = (text or "").split("\n")
        left = [s for s in own if len(holders.get(strip(s), ())) < 2 or (key is None, key) == min(holders[strip(s)])]
        out.append((key, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


LINES = [
    (20, "A shared line\n\t a SHARED line \nown line of twenty\n", "en", "s", 1), (19, "short\na shared line", "en", "s", 1), (30, "a shared line", "en", "s", 1),
    (31, "short\nshort\n\n", "en", "s", 1), (32, "ÉTÉ ÉTÉ ÉTÉ\nété été été", "en", "s", 1), (33, "été été été\r\n\x0bÉTÉ ÉTÉ ÉTÉ", "en", "s", 1),
    (34, "\x85a shared line", "en", "s", 1), (None, "a shared line\nno key at all", "en", "s", 1), (21, "own line of twenty\n" * 3000 + "last", "en", "s", 1),
]


def test_line_report_matches_brute_force(spark):
    rows = [*AWKWARD, *LINES]
    got = [tuple(r) for r in lines.line_report(awkward(spark, rows)).collect()]
    assert sorted(got, key=NONE_LAST) == sorted(kept_lines(rows), key=NONE_LAST)


def test_line_dedup_keeps_columns_and_places(spark):
    docs = awkward(spark, LINES)
    got = lines.drop_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "dropped_lines"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[20].dropped_lines == [0, 1] and rows[20].text == "own line of twenty\n" and rows[20].removed == "r"
    assert rows[30].text == "" and rows[19].dropped_lines == []
    null = lines.drop_repeated_lines(awkward(spark)).where("doc_id = 2").first()
    assert null.text is None and (null.n_lines, null.n_dropped) == (1, 0)


def test_lines_of_three_documents(spark):
    docs = awkward(spark, LINES)
    rows = {r.doc_id: r.n_dropped for r in lines.drop_repeated_lines(docs, min_docs=3).collect()}
    assert rows[30] == 1 and rows[None] == 1 and rows[20] == 2 and rows[33] == 0 and rows[21] == 0


def by_hand(two, text):
    """Groups and links of a text by scanning both lists of ends."""
    if not text:
        return None
    a, b = two.a.encode(" " + text, add_special_tokens=False).ids, two.b.encode(text)
    want = (" " + text).encode()
    if b"".join(two.bytes_a[i] for i in a) != want or b"".join(two.bytes_b[i] for i in b) != want:
        return None
    ends = [np.cumsum([len(v[i]) for i in ids]).tolist() for v, ids in ((two.bytes_a, a), (two.bytes_b, b))]
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return len(a), len(b), ";".join(groups), links


ODD = [
    "two  spaces and\n\nblank lines \n x", " leading", "trailing ", "a ▁ piece space", "<s> </s> <unk> <|endoftext|> <0x41>", "日本語 と  中文。 a", "\x00\x01 \x1c x", "don't  I'LL ²", "é" * 300,
    "é é", "😀😀 👍🏽", "…… -- ——", "\t\tdef f(x):\n        return x", "a b 　 c", "x" * 5000 + " y",
]


def test_alignment_matches_a_scan(spark):
    two = alignment.TwoTokenizers(BPE, PIECES)
    rows = [*AWKWARD[:4], *AWKWARD[6:], *((100 + i, t, "en", "s", 1) for i, t in enumerate(ODD)), *((200 + i, *r[1:]) for i, r in enumerate(random_texts(80, 6)))]
    want = [by_hand(two, r[1]) for r in rows]
    count = Counter(link for w in want if w for link in w[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    expected = []
    for (key, *_), w in zip(rows, want):
        if w is None:
            expected.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            expected.append((key, w[0], w[1], len(w[3]), len(w[3]), sum(count[x] == best[x[1]] for x in w[3]), sum(count[x] for x in w[3]), hashlib.sha256(w[2].encode()).hexdigest()))
    assert sum(w is None for w in want) < len(want) / 3
    got = [tuple(r) for r in alignment.alignment_report(awkward(spark, rows), BPE, PIECES).collect()]
    assert sorted(got, key=NONE_LAST) == sorted(expected, key=NONE_LAST)


def test_token_bytes_are_those_of_the_libraries():
    two = alignment.TwoTokenizers(BPE, PIECES)
    for text in (t for t in ODD if "▁" not in t):
        ids = two.a.encode(" " + text, add_special_tokens=False).ids
        assert b"".join(two.bytes_a[i] for i in ids).decode() == " " + text
    assert len(two.bytes_a) == 50_257 and two.bytes_b[3 + 65] == b"A"


def test_shared_cuts_match_sets():
    rng = np.random.default_rng(2)
    for n in range(1, 120):
        x, y = (np.unique(np.append(rng.integers(1, 400, rng.integers(1, n + 1)), 400)) for _ in range(2))
        i, j = alignment.shared_cuts(x, y, np.array([len(x) - 1]), np.array([len(y) - 1]))
        assert x[i].tolist() == y[j].tolist() == np.intersect1d(x, y).tolist()
    i, _ = alignment.shared_cuts(np.arange(1, 100, 2), np.append(np.arange(2, 98, 2), 99), np.array([49]), np.array([48]))
    assert i.tolist() == [49]  # no cut but the end


@pytest.mark.parametrize("rows", [None, []], ids=["awkward", "empty"])
def test_reports_bear_awkward_rows(spark, rows):
    docs = awkward(spark, rows)
    n = docs.count()
    assert lines.line_report(docs).count() == n and alignment.alignment_report(docs, BPE, PIECES).count() == n
    got = spelling.spelling_report(docs).collect()
    assert (rows is None) == bool(got) or not got
