"""Line-first cleaning: rules judge each line, failing lines go, a document that loses too much goes too.

Nulls and texts without a word: no words, ``base_failed``, not kept. Repeated rows are judged alike; ties
do not occur. Other columns of the input are passed through; the operator's own columns replace columns
of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.llm.words import WHITE, Words, chunks, covered, text_bytes

WINDOW = 8
#: bytes of text measured at once
PART = 512 << 10
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: a document goes if its failing lines hold a larger share of its word characters than this
MAX_LOST = 0.5
#: a line fails if a larger share of its words carries odd marks than this
MAX_ODD = 0.3
#: a line is navigation from this many separators on, if there are at most so many words for each
MIN_SEPARATORS, WORDS_PER_SEPARATOR = 3, 4
#: a line of more words for each boilerplate phrase in it is text that happens to hold one
WORDS_PER_PHRASE = 50

SPACE = "\t\n\x0b\x0c\r "
ODD = re.compile(r"(?:[#*$%&<>^~_=\\]{2,}|[!?]{2,})[.,]?(?=[\t\x0b\x0c\r ]|$)")
SEPARATOR = re.compile(r"(?:^|(?<=[\t\x0b\x0c\r ]))(?:\||»|›|>|::|•|·|/)(?=[\t\x0b\x0c\r ]|$)")
BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under|terms of (?:use|service)|privacy policy|cookie policy"
    r"|accept (?:all )?cookies|subscribe to (?:our|the)|sign up for|click here|read more|copyright (?:©|\(c\))",
    re.IGNORECASE,
)
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

OWN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("n_bad_lines", T.LongType()),
        T.StructField("lost_chars", T.LongType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def failed_rule(line: str) -> str | None:
    """The first rule a line with words breaks: ``navigation``, ``punctuation`` or ``boilerplate``."""
    words = line.count(" ") + 1
    if any(mark in line for mark in "|»›>:•·/"):
        separators = len(SEPARATOR.findall(line))
        if separators >= MIN_SEPARATORS and words <= (WORDS_PER_SEPARATOR + 1) * separators:
            return "navigation"
    if len(ODD.findall(line)) > MAX_ODD * words or not any(map(str.isalnum, line)):
        return "punctuation"
    phrases = len(BOILERPLATE.findall(line))
    if phrases and words <= WORDS_PER_PHRASE * phrases:
        return "boilerplate"
    return None


def _word_chars(line: str) -> int:
    return len(line) - sum(map(line.count, SPACE))


def _by_line(text: str) -> tuple[int, int, int, str]:
    """Repeated lines, failing lines, word characters in these, and the text without them."""
    seen: set[str] = set()
    repeated = bad = lost = 0
    kept: list[str] = []
    for line in text.split("\n"):
        if not line.strip(SPACE):
            kept.append(line)
            continue
        repeated += line in seen
        seen.add(line)
        if failed_rule(line):
            bad += 1
            lost += _word_chars(line)
        else:
            kept.append(line)
    return repeated, bad, lost, text if not bad else "\n".join(kept)


def _measure(batch: pa.RecordBatch, with_text: bool) -> list[pa.Array]:
    texts = text_bytes(batch.column("_text"))
    w = Words(texts)
    at = w.doc_start

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[w.doc_end] - total[at]

    chars = per_text(~WHITE[w.data] & ((w.data & 0xC0) != 0x80))
    symbols = per_text(SYMBOL[w.data])
    start, window = w.windows(w.hashes(), WINDOW)
    # windows of different texts never meet: the text's number is part of the key
    key = window ^ (w.doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    repeat = covered(start[times[inverse] > 1], WINDOW, len(w.doc))
    repeat_words = np.bincount(w.doc[repeat], minlength=len(texts))
    lines = [_by_line(t.decode("utf-8", "replace")) for t in texts]
    dup, bad, lost = (np.fromiter((x[i] for x in lines), dtype=np.int64, count=len(lines)) for i in range(3))
    failed = (w.count < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * w.count)
    kept = ~failed & (lost <= MAX_LOST * chars)
    clean = pa.array([x[3] for x in lines] if with_text else [None] * len(lines), pa.string())
    longs = [pa.array(x.astype(np.int64)) for x in (w.count, chars, symbols, dup, repeat_words)]
    return [*longs, pa.array(failed), pa.array(bad), pa.array(lost), pa.array(kept), clean]


def line_rules(docs: DataFrame, text: str = "text", clean: bool = True, keep_text: bool = True) -> DataFrame:
    """Each document with its measures, ``kept`` and, if ``clean``, its text without failing lines.

    ``keep_text`` says whether the original text is returned, too. Every line of every text is judged; no
    shuffle is needed.
    """
    own = {f.name for f in OWN}
    others = [c for c in docs.columns if c not in own and (keep_text or c != text)]
    source = docs.select(F.col(text).cast("string").alias("_text"), *[F.col(c).alias(f"in_{c}") for c in others])
    schema = T.StructType([f for f in source.schema if f.name != "_text"] + list(OWN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", PART):
            passed = [part.column(f"in_{c}") for c in others]
            names = [f"in_{c}" for c in others] + OWN.names
            yield pa.RecordBatch.from_arrays([*passed, *_measure(part, clean)], names)

    found = source.mapInArrow(run, schema)
    if not clean:
        found = found.drop("clean_text")
    return found.select(*[F.col(f"in_{c}").alias(c) for c in others], *[c for c in found.columns if not c.startswith("in_")])
