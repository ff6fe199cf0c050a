from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

from emulake.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_a_task_needs_one_python_worker_for_ids_and_bytes(spark):
    docs = spark.createDataFrame([(1, "one two\n\nthree"), (2, None)], "doc_id long, text string")
    plan = bpe.bpe_report(docs, RANKS, PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("gap", ["\n\n", "  ", "\t ", " \n"])
def test_words_of_uneven_texts_are_units_too(gap):
    words = [f"word{i}" for i in range(50)]
    units = bpe.units_of(" ".join(words[:20]) + gap + " ".join(words[20:]) + "\n")
    assert len(units) >= 48 and " word7" in units and " word30" in units


def test_words_side_by_side_get_the_ids_of_the_replay():
    ranks = {bytes([b]): 300 + b for b in range(256)} | {b"ab": 20, b"abc": 5, b"bc": 30, b"ca": 21, b"cab": 4, b"aa": 22, b"aaa": 3, b"bcab": 2}
    rng = random.Random(5)
    words = [b"", *{bytes(rng.choices(b"abc", k=rng.choice([1, 2, 3, 7, 12, 39, 40, 41, 90]))) for _ in range(600)}]
    for merges in (bpe.Merges(ranks), bpe.Merges({bytes([b]): b for b in range(256)})):
        assert [x.tolist() for x in bpe.replayed(words, merges)] == [x.tolist() for x in bpe.replay(words, merges)]


def test_units_get_tiktokens_ids_and_a_worker_keeps_no_more_than_its_room(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_UNITS", 40)
    ranks = bpe.read_ranks(RANKS)
    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    signs = "aeé ößñ .,;'’$*([-_`{~^1٣中\n\t \u0085\x1c×÷ǅ ​"
    texts = ["", " ", "it's we'll  \n x", *("".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(2_000))]
    encoder = bpe.Encoder(RANKS, PATTERN, ())
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        for text, ids in zip(part, encoder.encode(part)):
            found = bpe.np.frombuffer(ids, dtype="<i4")
            assert found.tolist() == want.encode_ordinary(text)
            assert encoder.decode(found).decode() == text
    assert len(encoder.known) == 40
