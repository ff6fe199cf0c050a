"""The training-text operators against brute force, exact round trips and held-out accuracy, and on awkward input."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emulake.llm import bpe, fingerprint, language, licences, packing, quality, queries, simhash, substring, topk, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
AWKWARD = [
    (1, "Plain words here.", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "Plain words here.", "en", "a", 5),
    (5, "x" * 30_000, "fr", "b", 1), (6, "one two " * 6_000, "de", "b", 1), (7, "  \n\t \x1c\x85 été ½²Ⅷ 's 'LL  <|endoftext|>  á 日本語 ǅ", None, "b", 1),
    (7, "a second row with the key seven", "en", "a", 2), (7, "a second row with the key seven", "en", "a", 2), (None, "no key at all", "en", None, 3), (8, "!!! ???", "es", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id int, removed string, score string, fp int, __units int"


def awkward(spark, rows=None):
    """Rows with NULLs, ties, repeats and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "r", "s", 2, 3) for r in (AWKWARD if rows is None else rows)], SCHEMA)


def labels(spark, rows=((1, 1, 0), (4, 0, 1), (5, None, None), (6, 1, 0), (6, 0, 1), (None, 1, 1), (8, 1, 0))):
    return spark.createDataFrame([*rows], "doc_id long, quality int, toxic int")


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pool = ["the", "Été", "naïve", "don't", "I'LL", "x²", "½", "12345", "日本", "a_b", "\n", "  ", "\t", "…", "end.", "‍", "ſ", "'s", "'ve", " ", "\x1d", "ok", "Ⅻ", "مرحبا", "é", "😀"]
    return [(i, "".join(rng.choice(pool) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(n)]


def test_packing_rows_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    rows = [*AWKWARD, *((i + 100, *r[1:]) for i, r in enumerate(random_texts(60)))]
    got = packing.pack_documents(awkward(spark, rows), WORDS, size=512).collect()
    want = []
    for key, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(key, p, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for p, at in enumerate(range(0, len(ids), 512))]
    none_last = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=none_last) == sorted(want, key=none_last)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= 1.1 * sum(r.length for r in got) / 512 + 1


def test_packing_query_matches_the_plain_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(100, "a <|endoftext|> b", "en", "s", 1), (101, "x<|endoftext|>y <|EndOfText|> \x1cz <|startoftext|>", "en", "s", 1), *((i + 200, *r[1:]) for i, r in enumerate(AWKWARD)), *((i + 300, *r[1:]) for i, r in enumerate(random_texts(60, 8)))]
    awkward(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in queries.op1_best_fit_packing(spark, str(tmp_path)).collect()}
    want = {}
    for key, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want |= {(key, p): (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for p, at in enumerate(range(0, len(ids), 4096))}
    assert got == want


def test_plan_covers_all_ranks_without_overlap():
    rng = random.Random(5)
    counts = {n: rng.choice([1, 2, 3, 50, 10**9]) for n in rng.sample(range(1, 101), 40)}
    ranges = packing.plan(counts, 100)
    for length, n in counts.items():
        at = 1
        for _, rank, k, *_ in sorted(r for r in ranges if r[0] == length):
            assert rank == at
            at += k
        assert at == n + 1
    assert len(ranges) < 5000  # whatever the counts


def test_packing_rejects_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 7)], "doc_id long, piece int, length long"), 4)


def test_licence_expressions():
    assert licences.to_postfix("A or B and C with D") == ["A", "B", "C", "D", "with", "and", "or"]
    assert licences.to_postfix("(A OR B) AND C */") == ["A", "B", "or", "C", "and"]
    assert licences.evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl"}, True)
    assert licences.evaluate("MIT AND GPL-2.0+ WITH Classpath-exception-2.0") == ({"mit", "gpl"}, False)
    for broken in ("", "AND MIT", "MIT OR", "(MIT", "()"):
        assert licences.evaluate(broken) is None


def test_licence_scan_matches_brute_force(spark):
    import re

    texts = ["MIT License and mit-license! Apache\nLicense", "x General Public License. GENERAL PUBLIC  license", "mit licenses", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "Licensed under CC BY-NC 4.0.", "émit license mit license"]
    docs = awkward(spark, [*AWKWARD, *((50 + i, t, "en", "s", 1) for i, t in enumerate(texts))])
    source = {r.doc_id: r.text for r in docs.where("doc_id >= 50").collect()}
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    for key, text in source.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[key]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[53].labels == "apache,bsd,mit" and got[53].permissive and got[54].labels == "cc-by-nc"
    assert (got[2].n_words, got[2].labels, got[2].score) == (0, "", 0.0)


def test_fingerprints_of_edited_and_next(spark):
    docs = awkward(spark)
    rows = sorted([(r.doc_id, r.text or "", r.h) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()], key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    want = []
    for (key, text, _), (_, nxt, _) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        sign = lambda t: fingerprint.signature(fingerprint.points_of(t))
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.hex_of(sign(text)), fingerprint.hex_of(sign(edited)), fingerprint.likeness(sign(text), sign(edited)), fingerprint.likeness(sign(text), sign(nxt))))
    got = [tuple(r) for r in fingerprint.edited_fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    alone = fingerprint.edited_fingerprints(awkward(spark, [(1, "abcdef", "en", "s", 1)])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


def test_fingerprint_follows_edit_distance():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400))
    sign = lambda t: fingerprint.signature(fingerprint.points_of(t))
    near = [fingerprint.likeness(sign(text), sign(text[: len(text) - k] + text[:k])) for k in (0, 40, 400, 1600)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True)
    half = len(text) // 2
    assert fingerprint.likeness(sign(text), sign(text[half:] + text[:half])) < 1.0  # moved blocks change the order


def test_long_texts_sign_alike_in_any_blocks(monkeypatch):
    points = np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint32)
    whole = fingerprint.signature(points)
    monkeypatch.setattr(fingerprint, "CHUNK", 700)
    assert (fingerprint.signature(points) == whole).all()


@pytest.mark.parametrize("table", [0, 5, 400_000])
def test_bpe_is_tiktoken_and_round_trips(spark, table):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = awkward(spark, [*((i, *r[1:]) for i, r in enumerate(AWKWARD)), *((i + 100, *r[1:]) for i, r in enumerate(random_texts(80, 7)))])
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, table_units=table), RANKS).collect()
    assert len(got) == len(source)
    for r in got:
        assert list(r.ids) == want.encode_ordinary(source[r.doc_id])
        assert bytes(r.bytes).decode() == source[r.doc_id]


def test_replay_restores_order_when_a_merge_opens_a_smaller_rank():
    ranks = {bytes([b]): 300 + b for b in range(256)} | {b"ab": 20, b"abc": 5, b"bc": 30, b"ca": 21, b"cab": 4, b"aa": 22}
    assert len(ranks) == 262
    rng = random.Random(3)

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while (best := min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)):
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    words = list({bytes(rng.choices(b"abc", k=rng.randint(1, 12))) for _ in range(400)})
    assert [x.tolist() for x in bpe.replay(words, bpe.Merges(ranks))] == [plain(w) for w in words]


def test_languages_held_out_and_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert own and sum(r.lang == r.lang_pred for r in own) >= 0.95 * len(own)
    model = language.fit_language(docs)
    parts = [r.text[:400].rsplit(" ", 1)[0] for r in docs.where("lang in ('en', 'de') and length(text) > 900").orderBy("lang", "doc_id").collect()]
    mixed = spark.createDataFrame([(1, parts[0] + " " + parts[-1]), (2, None), (3, "123")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in language.language_spans(mixed, model).collect()}
    assert {s.lang for s in spans[1]} == {"de", "en"} and spans[2] == [] and spans[3] == []


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(4)
    model = language.LanguageModel(["a", "b", "c"], np.zeros((3, language.BUCKETS)), np.ones((3, len(language.SCRIPTS)), dtype=bool))
    words = language.Words(["aa bb cc dd ee", "", "ff", "gg hh ii"])
    emit = rng.normal(0, 8, (3, words.n))
    label = model._viterbi(emit, words)
    for d in range(4):
        own = np.flatnonzero(words.doc == d)
        cost = lambda path: sum(emit[s, i] for s, i in zip(path, own)) - language.SWITCH * sum(x != y for x, y in zip(path, path[1:]))  # noqa: E731, B023
        if len(own):
            assert tuple(label[own]) == max(product(range(3), repeat=len(own)), key=cost)


def test_quality_and_toxicity_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, known = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    good = quality.quality_report(docs, known).join(known, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in good) >= 0.93 * len(good)
    bad = toxicity.toxicity_report(docs, known).join(known, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in bad) >= 0.93 * len(bad)
    assert sum(r.score for r in bad if r.toxic) / max(1, sum(r.toxic for r in bad)) > sum(r.score for r in bad if not r.toxic) / sum(not r.toxic for r in bad)


def test_isotonic_is_the_least_squares_fit():
    assert quality.isotonic(np.array([1.0, 0, 2, 3]), np.array([1.0, 1, 2, 3])).tolist() == [0.5, 0.5, 1, 1]
    assert quality.isotonic(np.array([3.0, 2, 1]), np.ones(3)).tolist() == [2, 2, 2]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 12)], 1) for i in range(300)]
    rows += [(i, [0.5] * 12, 1) for i in range(300, 420)]  # ties
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")], 1), (503, [float("inf")], 1), (None, [1.0], 1), (520, [], 1), (540, [2.0, -3.0], 1)]
    got = topk.top_k(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))).collect()
    v = {i: [int(np.floor(64 * x)) for x in e] for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:20]
        want |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("share", [-1.0, 1 / 32, 2.0])
@pytest.mark.parametrize("n", [3, 40, 300])
def test_strip_search_is_the_same_dense_or_by_pairs(monkeypatch, share, n):
    monkeypatch.setattr(topk, "DENSE", share)
    draw = np.random.default_rng(n)
    c, q = draw.integers(-9, 9, (n, 12)).astype(float), draw.integers(-9, 9, (7, 12)).astype(float)
    c[n // 2 :] = c[: n - n // 2]  # ties
    best = topk.Best(7, 5)
    for a in range(0, n, 50):
        topk.search_block(best, q, np.arange(7), c[a : a + 50], np.arange(a, min(n, a + 50)))
    for i in range(7):
        want = sorted((-int(q[i] @ c[j]), j) for j in range(n) if j != i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(best.score[i], best.id[i])][: len(want)] == want
        assert best.full[i] == len(want)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e3, 2.0]), (2, [-1e3, 2.0])]
    got = topk.top_k(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert [(r.vec_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def simhash_plain(text):
    import re

    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(9)
    base = " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=900))
    near = [(100 + i, base.replace("alpha", f"w{i}", 1) + f" tail{i}", "en", "s", 1) for i in range(90)]
    docs = awkward(spark, [*AWKWARD, *near, (300, "é  x\x1cy Z", "en", "s", 1), (301, " ", "en", "s", 1)])
    source = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [(key, simhash_plain(text)) for key, text in source]
    root = {f: f for _, f in prints}
    changed = True
    while changed:
        changed = False
        for a in root:
            low = min(root[b] for b in root if (a ^ b).bit_count() <= 2)
            changed |= low != root[a]
            root[a] = low
    smallest = {}
    for key, f in prints:
        if key is not None:
            smallest[root[f]] = min(key, smallest.get(root[f], key))
    want = sorted(((key, format(f, "016x"), smallest.get(root[f])) for key, f in prints), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicate_report(docs).collect()), key=str) == want
    kept = simhash.drop_near_duplicates(docs).collect()
    assert len(kept) == len(set(root.values())) and {r.doc_id for r in kept} >= {v for v in smallest.values()}


def test_crowded_blocks_link_as_pairs_do(spark, monkeypatch):
    rng = random.Random(4)
    values = {0, -1}
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(120):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            values.add(f - (1 << 64) if f >> 63 else f)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")

    def classes():
        from emulake.llm.components import component_roots

        return {(r.node, r.root) for r in component_roots(simhash.close_links(frame)).collect()}

    some = classes()
    monkeypatch.setattr(simhash, "CROWD", 0)
    assert classes() == some
    monkeypatch.setattr(simhash, "CROWD", 10**9)
    assert classes() == some


def test_the_pipeline_keeps_one_of_each_simhash_group(spark):
    import corpus_pipeline as p

    rng = random.Random(6)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    rows = []
    for g in range(30):
        base = words(rng.choice([40, 200, 900]))
        for c in range(70 if g == 0 else 3):
            own = base.copy()
            for at in rng.sample(range(len(own)), rng.randint(0, len(own) // 40)):
                own[at] = words(1)[0]
            rows.append((1000 * (g + 1) + c, " ".join(own), "en", "s", 1))
    docs = awkward(spark, [*AWKWARD, *rows])
    from xxhash import xxh64_intdigest

    prints = {}
    for key, text, *_ in rows:
        w = text.split()
        hashes = [xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
        prints[key] = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    root = {k: k for k in prints}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert any(prints[a] != prints[b] for a, b in pairs)
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    kept = p.one_of_near_copies(spark, docs, "").where("doc_id >= 1000").collect()
    assert {r.doc_id for r in kept} == {k for k in root if root[k] == k}


def test_repeated_passages_go_but_for_the_first(spark):
    passage = "A passage of many words is repeated here. It goes on, as passages do, for quite a while. Then it ends."
    rows = [(1, f"Start.\n{passage}\nEnd of one.", "en", "s", 1), (2, f"some other words {passage} and more words", "en", "s", 1), (3, f"Own line.\n{passage.upper()}", "en", "s", 1), (4, passage, "en", "s", 1), (5, "End of one.", "en", "s", 1)]
    docs = awkward(spark, [*rows, *((i + 10 if i is not None else None, *r) for i, *r in AWKWARD)])
    got = {r.doc_id: r for r in substring.drop_repeated(docs).where("doc_id < 10").collect()}
    assert got[1].text == rows[0][1] and got[1].removed == []
    assert got[2].text == "some other words and more words"
    assert [rows[1][1][s.start : s.end] for s in got[2].removed] == [passage + " "]
    assert got[4].text == "" and got[5].text == "End of one."


@pytest.mark.parametrize("kind", ["lower", "caps", "cjk"])
def test_passages_without_case_or_stops_go_from_the_middle_of_lines(spark, kind):
    rng = random.Random(kind)
    sep, window = ("", 100) if kind == "cjk" else (" ", 50)
    pool = [chr(c) for c in range(0x4E00, 0x5000)] if kind == "cjk" else ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(900)]
    if kind == "caps":
        pool = [w.upper() for w in pool]
    words = lambda n: [w + ("。" if kind == "cjk" and rng.random() < 0.05 else "") for w in rng.choices(pool, k=n)]
    passages = [words(3 * window // 2) for _ in range(20)]
    texts = [sep.join([*words(60), *p, *words(60)]) for p in passages for _ in range(2)]
    got = {r.doc_id: r.text for r in substring.drop_repeated(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert all(got[i] == texts[i] for i in range(0, 40, 2))
    left = [n for n, p in enumerate(passages) if any(sep.join(p[i : i + window]) in got[2 * n + 1] for i in range(len(p) - window + 1))]
    assert left == []


def test_short_units_go_only_where_they_stood_together(spark):
    texts = ["Of course. Seven trees grew.", "In the town. Nobody spoke there.", "The end came. Then it rained.", "Of course. In the town. The end came. Of course.", "Of course. In the town. The end came. Of course. More."]
    got = {r.doc_id: r for r in substring.drop_repeated(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i].text for i in range(4)] == texts[:4]  # each phrase is known, their sequence isn't
    assert got[4].text == "More."


def test_units_are_the_shortest_chains_of_cells():
    text = "One two. Three four five six seven eight nine ten. Eleven.\nTwelve thirteen fourteen fifteen sixteen seventeen. Eighteen nineteen."
    cells, want = substring.cells_of(text), set()
    for i in range(len(cells)):
        for j in range(i, len(cells)):
            n = [c[3] for c in cells[i : j + 1]]
            if sum(n) >= 16 and (sum(n[:-1]) < 16 or sum(n[1:]) < 16):
                want.add((i, j))
    fewest = {(i, j) for i, j in want if j == min(b for a, b in want if a == i) or i == max(a for a, b in want if b == j)}
    assert [(a, b) for a, b, _ in substring.units_of(text)] == [(cells[i][0], cells[j][1]) for i, j in sorted(fewest)]


def test_repeats_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        units, again = substring.units_of(r.text or ""), set()
        for i, u in enumerate(units):
            again |= {i} if u[2] in seen else set()
            seen.add(u[2])
        text = r.text
        for a, b in reversed(substring.removed_spans(units, again, substring.MIN_WORDS)):
            text = text[:a] + text[b:]
        want[r.doc_id] = text
    assert {r.doc_id: r.text for r in substring.drop_repeated(docs).collect()} == want


def test_pipeline_matches_its_operators_by_hand(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.quality_report(docs, known).where("predicted = 1").collect()}
    left = docs.where(F.col("doc_id").isin(good))
    clean = {r.doc_id for r in toxicity.toxicity_report(left, known).where("predicted = 0").collect()}
    left = left.where(F.col("doc_id").isin(clean))
    firsts = {r.component_id for r in simhash.near_duplicate_report(left).collect()}
    texts = {r.doc_id: r.text for r in substring.drop_repeated(left.where(F.col("doc_id").isin(firsts))).collect()}
    packed = p.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(texts)
    ids = packing.token_pieces(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), WORDS).select("doc_id", "piece", F.crc32("ids").alias("c")).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in packed} == {tuple(r) for r in ids}


@pytest.mark.parametrize("rows", [None, []], ids=["awkward", "empty"])
def test_stages_keep_columns_and_bear_awkward_rows(spark, tmp_path, rows):
    import corpus_pipeline as p

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = awkward(spark, rows)
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if stage is p.packed:
            assert {"sequence_id", "offset", "piece"} <= set(out.columns)
        else:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        n = out.count()
        assert n == 0 if rows == [] else n > 0


@pytest.mark.parametrize("rows", [None, []], ids=["awkward", "empty"])
def test_reports_bear_awkward_rows(spark, rows):
    docs, known = awkward(spark, rows), labels(spark)
    n = docs.count()
    for out in (quality.quality_report(docs, known), toxicity.toxicity_report(docs, known), quality.quality_report(docs, labels(spark, ())), toxicity.toxicity_report(docs, labels(spark, ()))):
        got = out.collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    got = language.language_report(docs).collect()
    assert len(got) == n and all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 8))
    assert language.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    assert licences.scan_licences(docs).count() == n and simhash.near_duplicate_report(docs).count() == n
    assert fingerprint.edited_fingerprints(docs).count() == n and substring.drop_repeated(docs).count() == n
    assert bpe.bpe_report(docs, RANKS, public_tokenizers.PATTERN).count() == n


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_plain_texts_fall_into_the_cells_of_a_search_word_by_word(monkeypatch):
    """op10: a text without dense characters has its words split a stretch at a time, with the cells of the slower way."""
    import random

    from emulake.llm import substring

    rng = random.Random(3)
    pieces = ["word ", "Word. ", " the quick", "\n", "\n  ", "\t", ".", "! ", "A", "ÀB", "ΑΣ. ", "İx ", "ж ", "\x1c", "x y z ", "0-"]
    texts = ["", "  ", "\n A", *("".join(rng.choices(pieces, k=rng.randrange(1, 150))) for _ in range(400))]
    searched = []
    real = substring.WORD
    monkeypatch.setattr(substring, "WORD", type("Searched", (), {"finditer": staticmethod(lambda t: searched.append(t) or real.finditer(t))}))
    fast = [substring.cells_of(t) for t in texts]
    assert not searched

    def searched_cells(text):
        at = [m.span() for m in real.finditer(text)]
        ends = {m.end() for m in substring.BREAK.finditer(text)}
        words = [text[a:b].lower() for a, b in at]
        rough = [0, *(i for i in range(1, len(at)) if at[i][0] in ends), len(at)]
        edges = [e for i, j in zip(rough, rough[1:]) for e in [i, *([i + k for k in substring._inner_cuts(words[i:j])] if j - i >= substring.LONG else [])]] + [len(at)]
        place = [0, *(at[i][0] for i in edges[1:-1]), len(text)]
        return [(place[n], place[n + 1], " ".join(words[i:j]), 2 * (j - i)) for n, (i, j) in enumerate(zip(edges, edges[1:]))] if at else []

    assert fast == [searched_cells(t) for t in texts]


def _largest_batch(df):
    """Rows of the largest Arrow batch in which ``df`` reaches Python."""
    import pyarrow as pa

    seen = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    return seen.agg(F.max("n")).first()[0]


def test_pipeline_stages_hand_texts_to_python_in_small_batches(spark, tmp_path):
    import corpus_pipeline as p
    from emulake.llm.common import BATCH_ROWS, BATCH_ROWS_CONF

    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(2500)], "doc_id long, text string").coalesce(1)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(BATCH_ROWS_CONF, None)
    try:
        spark.conf.unset(BATCH_ROWS_CONF)
        assert _largest_batch(docs) == 2500
        assert p.run(spark, str(tmp_path)).select("doc_id").distinct().count() >= 1
        assert spark.conf.get(BATCH_ROWS_CONF, None) is None  # run leaves the session as it was
        for _, stage in p.STAGES:
            spark.conf.unset(BATCH_ROWS_CONF)
            stage(spark, docs, str(tmp_path))
            assert _largest_batch(docs) == BATCH_ROWS
        spark.conf.set(BATCH_ROWS_CONF, "300")  # the session's own number stays
        p.not_toxic(spark, docs, str(tmp_path))
        assert _largest_batch(docs) == 300
    finally:
        spark.conf.unset(BATCH_ROWS_CONF) if before is None else spark.conf.set(BATCH_ROWS_CONF, before)


class _Scan:
    """Stands for a table; a scan in Python is run at once, on no rows."""

    def __init__(self, schema):
        self.schema, self.columns = schema, schema.names

    def select(self, *_):
        return self

    def mapInArrow(self, run, _schema):
        list(run(iter([])))


def test_workers_drop_what_another_operator_kept(spark):
    from emulake.llm import quality, simhash, substring, toxicity
    from emulake.llm.common import worker_value

    docs = _Scan(spark.createDataFrame([], "doc_id long, text string").schema)
    scans = [lambda: quality.keep_good(docs, None), lambda: quality.document_statistics(docs), lambda: toxicity.drop_toxic(docs, None),
             lambda: toxicity.toxicity_scores(docs, None), lambda: simhash.fingerprints(docs), lambda: substring.digests(docs)]
    for scan in scans:
        made = []
        for _ in range(2):
            worker_value("test", (), lambda: made.append(1))
        assert len(made) == 1
        scan()
        worker_value("test", (), lambda: made.append(1))
        assert len(made) == 2
        scan()  # drops the test's value


def test_word_ids_keep_a_piece_and_its_word_once():
    import public_tokenizers
    from emulake.llm.packing import WordIds

    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["plainword Plainword's plainword, café x=1; 中文", "", "plainword café's"]
    got = ids.encode(texts)
    assert got == [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert all(isinstance(v, bytes) for v in ids.pieces.values())
    assert ids.pieces["plainword"] is ids.known["plainword"] and ids.pieces["café"] is ids.known["café"]
