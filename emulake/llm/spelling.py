"""Spelling variants: words one edit apart, found by walking a trie as a relation, level by level.

The trie is an edge table (node, ch, child): a node is a prefix, a row knows the count of the word that ends at its child
and the characters that follow there. The frontier holds states (word, position, node, edits). Each level joins the states of
one depth with the edges that leave it; a state that has spent its edit needs the word's own next character, one that has not
branches off. Two words that differ by one edit do so at their first difference, so a state branches only into other
characters than its own, and each neighbour is met once.

A word starts not at the root but at its middle: an edit in the second half leaves the first half as it is, and an edit in the
first half is one in the second half of the reversed words, which have a trie of their own. So no join has the root or another
short prefix as a key, and few branches are open where a state begins. Words longer than ``TRIE_CHARS`` would need
as many levels; pairs with one of those meet over the hashes of the word with one code point deleted, and are then verified.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import slices, store, texts_of
from emulake.llm.simhash import LOWER
from emulake.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run of a document in so many loses a code point.
NOISE = 199
MIN_CHARS, MIN_COUNT = 6, 5
#: A form has so many times the count of its variants at least.
RATIO = 5
#: Code points of the longest words in the trie, hence its levels.
TRIE_CHARS = 32
#: Distinct words counted in a task before the counts are passed on.
COUNTED = 200_000
STATE = "word string, position int, node string, edits int, found long"


def runs_of(text: str) -> list[str]:
    """The maximal letter runs of a text, A-Z lower-cased."""
    return RUN.findall(text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))


def noisy(run: str, start: int, noise: int) -> str:
    """The run, without one code point if its checksum, which goes on from that of the document's prefix, is divisible by ``noise``."""
    h = zlib.crc32(run.encode("utf-8"), start)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n) of all words with ``min_chars`` code points; counted in the task first. NULL text has no words, a NULL key is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for doc, t in zip(batch.column(0).to_pylist(), texts_of(batch)):
                start = zlib.crc32(f"{doc}:".encode())
                for r, n in Counter(runs_of(t)).items():
                    if len(r) >= min_chars:  # a shorter run makes no word
                        w = noisy(r, start, noise)
                        if len(w) >= min_chars:
                            seen[w] += n
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    named = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.col(text).alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def both_sides(words: DataFrame) -> DataFrame:
    """(word, side, n): every word as it is ('>') and reversed ('<')."""
    sides = F.array(F.struct(F.lit(">").alias("side"), F.col("word").alias("word")), F.struct(F.lit("<").alias("side"), F.reverse("word").alias("word")))
    return words.select("n", F.explode(sides).alias("s")).select(F.concat("s.side", "s.word").alias("word"), "n")


def start_of(word: Column) -> Column:
    """Code points of a word with its side in front that no edit may touch: half of the word, with the middle one if reversed.

    A pair whose common prefix is shorter than half of the word has a common suffix of at least the other half.
    """
    n = F.length(word) - 1
    half = F.floor(n / 2).cast("int")
    return F.when(word.startswith(">"), half).otherwise(n - half) + 1


def trie_edges(words: DataFrame) -> DataFrame:
    """(node, ch, child, n, follow, depth): the edges below the middles of words (word with side, n).

    n is the count of the word that ends at the child, or NULL; follow has the characters that leave the child. Depth is
    the child's. One aggregate over the prefixes of the words makes them.
    """
    size = F.length("word")
    # prefixes that a walk may reach: a neighbour's walk starts at its own middle, at most one before this word's
    ends = F.explode(F.sequence(F.least(start_of(F.col("word")), size - 1), size))
    each = words.select("word", "n", ends.alias("depth"))
    cut = each.select(
        F.expr("left(word, depth)").alias("child"), "depth", F.expr("substring(word, depth + 1, 1)").alias("next"),
        F.when(F.col("depth") == size, F.col("n")).alias("n"),
    )
    nodes = cut.groupBy("child", "depth").agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_set("next")), "").alias("follow"))
    return nodes.select(F.expr("left(child, depth - 1)").alias("node"), F.expr("right(child, 1)").alias("ch"), "child", "n", "follow", "depth")


def advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one level: each is joined with the edges that leave its node.

    Only states that can go on are kept: those at the end of their word where another word ends (found is its count),
    and those whose next character follows the child.
    """
    word, at, ch = F.col("word"), F.col("position"), F.col("ch")
    own, after = F.expr("substring(word, position + 1, 1)"), F.expr("substring(word, position + 2, 1)")
    size = F.length(word)
    fresh_edit = F.array(
        F.when((ch != own) & (at < size), at + 1),  # another character in its place
        F.when(ch != own, at),  # one more character
        F.when((ch == after) & (after != own) & (at + 1 < size), at + 2),  # one character less
        F.when((ch == own) & (at == size - 2), size),  # without its last character
    )
    moves = F.when(F.col("edits") == 1, F.array(at + 1)).otherwise(F.array_compact(fresh_edit))
    met = states.join(edges, "node").where((F.col("edits") == 0) | (ch == own))
    went = met.select("word", "child", "n", "follow", size.alias("size"), F.explode(moves).alias("position"))
    done = (F.col("position") == F.col("size")) & F.col("n").isNotNull()
    goes_on = (F.col("position") < F.col("size")) & (F.instr("follow", F.expr("substring(word, position + 1, 1)")) > 0)
    return went.where(done | goes_on).select("word", "position", F.col("child").alias("node"), F.lit(1).alias("edits"), F.when(done, F.col("n")).alias("found"))


def trie_neighbours(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of ``words`` (word, n), of ``shortest`` to ``longest`` code points, that are one edit apart."""
    sided = store(both_sides(words), "sided")
    edges = materialize(trie_edges(sided), "edges", ["depth"])
    starts = sided.select("word", F.explode(F.sequence(start_of(F.col("word")), F.length("word"))).alias("position"))
    starts = starts.select("word", "position", F.expr("left(word, position)").alias("node"), F.lit(0).alias("edits"), F.lit(None).cast("long").alias("found"))
    ends = frontier = words.sparkSession.createDataFrame([], STATE)
    for depth in range(shortest // 2 + 1, longest + 2):  # with the side in front, a node of ``depth`` has one code point less
        begun = starts.where(F.col("position") == depth)
        states = frontier.where("found is null").union(begun)
        frontier = store(advanced(states, edges.where(F.col("depth") == depth + 1)), "frontier")
        ends = ends.union(frontier)
    ends = ends.where("found is not null")
    plain = lambda c: F.when(F.col(c).startswith(">"), F.expr(f"substring({c}, 2)")).otherwise(F.reverse(F.expr(f"substring({c}, 2)")))
    pairs = ends.select(plain("word").alias("word"), plain("node").alias("near"), F.col("found").alias("near_n"), F.col("word").startswith(">").alias("ahead"))
    # what the reversed trie finds too is left to the other one
    half = "floor(length(word) / 2)"
    return pairs.where(F.col("ahead") | F.expr(f"left(word, {half}) <> left(near, {half})")).select("word", "near", "near_n")


def long_neighbours(words: DataFrame, from_chars: int) -> DataFrame:
    """As trie_neighbours, for pairs of words (word, n) of ``from_chars`` or more code points of which one has more.

    Two such words are equal after at most one deletion in each, so they share the hash of a shortened word; the hashes of
    all deletions of a word come from running sums. Pairs of equal hashes are verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 0x9E3779B97F4A7C15 | 1
        inverse = np.uint64(pow(base, -1, 1 << 64))
        for batch in slices(batches, 1):
            word = batch.column(0)[0].as_py()
            code = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
            power = np.full(len(code), base, dtype=np.uint64)
            power[0] = 1
            sums = np.zeros(len(code) + 1, dtype=np.uint64)
            np.cumsum(code * np.cumprod(power, dtype=np.uint64), dtype=np.uint64, out=sums[1:])
            less = np.unique(sums[:-1] + (sums[-1] - sums[1:]) * inverse)  # what follows the gap moves up by one
            h = np.append(less, sums[-1]).view(np.int64)
            size = np.append(np.full(len(less), len(code) - 1), len(code))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column(1)[0].as_py(), dtype=np.int64)), pa.array(h), pa.array(size.astype(np.int32))], names=["id", "h", "size"])

    long = store(words.where(F.length("word") >= from_chars).withColumn("id", F.xxhash64("word")), "long-words")
    cuts = store(long.select("word", "id").mapInArrow(run, "id long, h long, size int"), "deletions")
    pairs = cuts.join(cuts.withColumnRenamed("id", "other"), ["h", "size"]).where("id <> other").select("id", "other").distinct()
    other = long.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.join(long.select("id", "word"), "id").join(other, "other")
    return both.where(F.greatest(F.length("word"), F.length("near")) > from_chars).where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def spelling_groups(words: DataFrame, ratio: int = RATIO, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words``: distinct words of three code points or more and their counts n.

    form is the word one edit away with the largest count (ties: the smallest in code-point order) if that is ``ratio``
    times the word's at least, else NULL; form_n is its count and n_near the number of words one edit away. root is the
    last word over forms; counts grow on the way, so there is one, and its length is bounded by the logarithm of the largest
    count. Words may be of any length and characters; an empty table gives none.
    """
    words = store(words, "words")
    shortest, longest, most = words.agg(F.min(F.length("word")), F.max(F.length("word")), F.max("n")).first()
    near = trie_neighbours(words.where(F.length("word") <= trie_chars), shortest or 0, min(longest or 0, trie_chars))
    if (longest or 0) > trie_chars:
        near = near.union(long_neighbours(words, trie_chars))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    big = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    found = store(joined.select(
        "word", F.when(big, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(big, -F.col("best.less")).alias("form_n"),
    ), "forms")
    root = found.select("word", F.coalesce("form", "word").alias("root"))
    steps = math.floor(math.log(most, ratio)) + 1 if most else 0  # forms on the longest way
    for _ in range(steps.bit_length()):  # each round doubles the way that a word has gone
        onward = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = store(root.join(onward, "root").select("word", F.col("further").alias("root")), "roots")
    return found.join(root, "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    """spelling_groups of the words that occur MIN_COUNT times in ``docs``; NULL and empty texts have no words."""
    return spelling_groups(count_words(docs).where(F.col("n") >= MIN_COUNT))
