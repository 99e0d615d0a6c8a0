"""Spelling variants of words: pairs one edit apart by pivotal grams, and the form each word is a variant of.

The words of all texts are counted. Bigrams are ordered by how many words hold them, rare ones first. The
prefix of a word is its three rarest bigrams, with all that tie with the third; its pivots are the two
disjoint ones of the prefix that are rarest together, found by dynamic programming over their positions. One
edit spoils at most one of two disjoint bigrams. So of two words one edit apart, the one whose prefix ends
at the rarer bigram has a pivot that is a bigram in the other's prefix, too: its first pivot with the edit
behind it, or its second one with the edit before it. On the side without the edit both words are equal,
which fixes the pivot's position in a word of given length; and of the side with the edit, one half is equal.
A pivot is indexed by all that must be equal, a prefix bigram likewise, and both meet in one equality join,
whose buckets stay small even for common bigrams. Each pair is verified by its edit distance. Bigrams are
counted exactly; there are at most (26 + 64)^2 of them, and only these counts reach the driver. No join broadcasts:
Spark sizes keys by the compressed words they are made of, see ``_unsent``.

Null texts have no words, and a null ``doc_id`` counts as an empty one in the hash that thins out letters.
Repeated rows count as often as they occur. Ties for a form go to the smallest word in code-point order. An
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.llm.packs import stored

LETTERS = "a-z\u00c0-\u00ff"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: one in so many (document, run) pairs loses a letter
DROP = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: bigrams of a prefix: two letters times one edit, plus one
PREFIX = 3
#: a form occurs at least so many times as often as its variant
RATIO = 2
#: words that a task counts before it hands them on
HELD = 200_000
COUNTS = "word string, n long"
INDEX = "key long, last int, word string"


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id", drop: int = DROP, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n``, a word in several rows: the runs of letters, A-Z in lower case, of ``min_length`` letters at least.

    Of each (document, run) whose hash ``drop`` divides, a letter is left out.
    """
    pattern = f"[{LETTERS}]{{{min_length},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(pattern).findall, Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for name, raw in zip(b.column("_id").to_pylist(), b.column("_text").cast(pa.binary()).to_pylist(), strict=True):
                runs = find(raw.translate(LOWER).decode())
                held.update(runs)
                start = zlib.crc32(f"{name}:".encode())
                for word in set(runs):
                    h = zlib.crc32(word.encode(), start)
                    if not h % drop:
                        at, n = h % len(word), runs.count(word)
                        held[word] -= n
                        if len(word) > min_length:
                            held[word[:at] + word[at + 1 :]] += n
                if len(held) >= HELD:
                    yield handed()
        if held:
            yield handed()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, COUNTS)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the distinct words that are frequent enough."""
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words, counted once for each occurrence, each bigram is."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def prefix_and_pivots(word: str, count: dict[str, int], rank: dict[str, int]) -> tuple[int, list[int], tuple[int, int]]:
    """The rank at which the prefix ends, the positions of its bigrams in order, and those of the two pivots."""
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    last = sorted(rank[g] for g in grams)[PREFIX - 1]
    prefix = [i for i, g in enumerate(grams) if rank[g] <= last]
    # least[j]: the cheapest bigram among the first j of the prefix; a pivot pairs with the cheapest that ends before it
    least, best, j = [], None, 0
    for i in prefix:
        while prefix[j] + 2 <= i:
            cost = (count[grams[prefix[j]]], prefix[j])
            least.append(min(least[-1], cost) if least else cost)
            j += 1
        if least:
            pair = (least[-1][0] + count[grams[i]], least[-1][1], i)
            best = pair if best is None else min(best, pair)
    return last, prefix, (best[1], best[2])


def _agreed(fixed: str, free: str, length: int, others: tuple[int, ...], behind: bool) -> Iterator[int]:
    """Hashes of what a word of ``length`` letters agrees in with one whose free part is longer by one of ``others``,
    if ``fixed`` is equal in both and the one edit lies in ``free``, which is ``behind`` it or before it.

    Cut into halves as long as the shorter free part, counted from both ends, one half is equal.
    """
    for more in others:
        far = (len(free) + min(more, 0)) // 2
        near = len(free) + min(more, 0) - far
        if near < 0:
            continue
        head, tail = (near, far) if behind else (far, near)
        last = free[len(free) - tail :]
        yield xxhash.xxh64_intdigest(f"{fixed} {free[:head]}", 4 * length + 2 * behind) - (1 << 63)
        yield xxhash.xxh64_intdigest(f"{fixed} {last}", 4 * length + 2 * behind + 1) - (1 << 63)


def pivot_keys(word: str, pivots: tuple[int, int]) -> set[int]:
    """What a word one edit away agrees in: with the edit behind the first pivot, or before the second."""
    (first, second), out = pivots, set()
    for more in (-1, 0, 1):
        out.update(_agreed(word[: first + 2], word[first + 2 :], len(word) + more, (more,), True))
        out.update(_agreed(word[second:], word[:second], len(word) + more, (more,), False))
    return out


def prefix_keys(word: str, prefix: list[int]) -> set[int]:
    """The same for the bigrams of a word's own prefix; the other word is shorter, or not."""
    out = set()
    for p in prefix:
        out.update(_agreed(word[: p + 2], word[p + 2 :], len(word), (-1, 0), True))
        out.update(_agreed(word[p:], word[:p], len(word), (-1, 0), False))
    return out


def _unsent(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that sorts both sides. Spark takes a table for as large as its compressed files, and what Python
    makes of a row for one row: a few MB of words would pass as small enough to send, and their keys be collected by the driver."""
    return rows.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: the pairs of ``words`` (column ``word``, distinct, of at least 5 letters) one edit apart, each once, in either order."""
    count = gram_counts(words)
    rank = {g: i for i, g in enumerate(sorted(count, key=lambda g: (count[g], g)))}

    def indexed(pivots: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, lasts, texts = [], [], []
                for word in b.column("word").to_pylist():
                    last, prefix, pair = prefix_and_pivots(word, count, rank)
                    found = pivot_keys(word, pair) if pivots else prefix_keys(word, prefix)
                    keys += found
                    lasts += [last] * len(found)
                    texts += [word] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lasts, pa.int32()), pa.array(texts, pa.string())], ["key", "last", "word"])

        return run

    narrow = words.select("word")
    asks = narrow.mapInArrow(indexed(True), INDEX).select("key", F.col("last").alias("_last"), F.col("word").alias("a"))
    holds = narrow.mapInArrow(indexed(False), INDEX).select("key", "last", F.col("word").alias("b"))
    # the side whose prefix ends earlier asks; both do if they end at the same bigram, and one is left out
    once = (F.col("_last") < F.col("last")) | ((F.col("_last") == F.col("last")) & (F.col("a") != F.col("b")))
    met = asks.join(_unsent(holds), "key").filter(once).filter(F.levenshtein("a", "b", 1) == 1)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame, label: str = "roots") -> DataFrame:
    """``word, root`` for ``forms`` (``word, form``): forms are followed to the last one by pointer doubling.

    Forms must not run in circles. A chain of k forms takes about log2(k) joins, each of which is stored.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), label)
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(now.join(_unsent(on), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), label)
        now = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", drop: int = DROP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word: its most frequent near word if that occurs ``RATIO`` times as
    often, the last word that forms lead to, and how many words are near. ``min_length`` is 5 at least, as
    shorter words may not have three bigrams that hold two disjoint ones."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"words of fewer than {MIN_LENGTH} letters have too few bigrams")
    words = stored(vocabulary(occurrences(docs, text, key, drop, min_length), min_count), "words")
    pairs = stored(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("_near")).union(pairs.select(F.col("b"), F.col("a")))
    counts = words.select(F.col("word").alias("_near"), F.col("n").alias("_n"))
    best = both.join(_unsent(counts), "_near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("_near").alias("near"))).alias("_best"))
    leads: Column = -F.col("_best.less") >= RATIO * F.col("n")
    found = stored(
        words.join(_unsent(best), "word", "left").select(
            "word",
            F.when(leads, F.col("_best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(leads, -F.col("_best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.filter("form is not null"))
    return found.join(_unsent(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
