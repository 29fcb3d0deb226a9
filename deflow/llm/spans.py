"""Substring dedup over sliding spans of consecutive sentences.

From every sentence on, the shortest run of ``SPAN`` or more consecutive sentences with ``LEAST`` words is hashed,
so that a line that many documents share is no span and a passage of fifty words holds several. Spans that
occur more than once anywhere are found by counting (combined map-side, so a passage that everybody shares
costs one row per task), and joined back to their places; the first place, by document key and sentence
number, stays, and the sentences that any other place covers are removed.

A sentence ends at a line break or with a word that ends in ``.``, ``!``, ``?`` or ``|`` (or their wide forms);
longer ones are cut after ``PIECE`` words. Those cuts depend on where the host's sentence begins, so runs of
``RUN`` words that begin where the words say so are spans too: of each ``WINDOW`` runs that begin at consecutive
words, the one with the least hash. A passage of ``RUN + WINDOW - 1`` = 50 words holds one wherever it stands.
Of the pieces wholly inside a repeated run, those of sentences of more than ``LONG`` words go; where nothing of
a run goes by that or by sentence spans, all of them go, so a repeated passage of 50 words never stays whole. At
its ends, sentences of up to ``LONG`` words and pieces that reach out of it can stay. Sentences are compared as their lower-cased words; in scripts written without blanks, each
character counts as a word.

Defined results: null and empty texts have no sentence, and nothing is removed; texts of fewer than ``SPAN``
sentences have one span, the whole text, if it has at least ``LEAST`` words. A document is told by its key and a hash
of its text, so rows of one key, or without any, lose what their own text repeats; rows equal in both are one
document, and their equal places are one place. Null keys come first. Clashing column names get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deflow.llm import common
from deflow.llm.words import Words, portions, split

SPAN = 3
PIECE = 8       # words of a sentence before it is cut
LEAST = 20      # words of a span
RUN = 38        # words of a run that begins anywhere
LONG = SPAN * PIECE     # words of a sentence that is compared by its own pieces only
WINDOW = 13     # runs of which one is taken; two that follow each other overlap by more than a piece

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?|"]] = True
_WIDE_END = [int.from_bytes(c.encode(), "big") for c in "\u3002\uff01\uff1f\uff5c"]


@dataclass
class Sentences:
    """Sentences of a batch of texts: sentence i has words word[i] to word[i + 1] - 1; first[d] begins text d's."""

    words: Words
    word: np.ndarray
    first: np.ndarray
    long: np.ndarray        # is sentence i a piece of one of more than LONG words

    def places(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of a text's sentences, counted from the text's beginning."""
        a, b = self.first[text], self.first[text + 1]
        origin = self.words.texts[text]
        return self.words.starts[self.word[a:b]] - origin, self.words.ends[self.word[a + 1:b + 1] - 1] - origin


def sentences(texts: list[bytes | None], piece: int = PIECE) -> Sentences:
    w = split(texts, characters=True)
    n = len(w.starts)
    if not n:
        return Sentences(w, np.zeros(1, np.int64), np.zeros(len(w.first), np.int64), np.zeros(0, bool))
    line = np.cumsum(w.data == 10)[w.starts]
    fresh = np.ones(n, bool)
    last = w.ends[:-1] - 1
    wide = w.data[last].astype(np.int64) | w.data[last - 1].astype(np.int64) << 8 | w.data[last - 2].astype(np.int64) << 16
    fresh[1:] = _END[w.data[last]] | np.isin(wide, _WIDE_END) | (line[1:] != line[:-1])
    fresh[w.first[:-1][w.first[:-1] < n]] = True
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, n))
    within = np.arange(n) - np.repeat(begin, size)
    word = np.append(np.flatnonzero(within % piece == 0), n)
    return Sentences(w, word, np.searchsorted(word[:-1], w.first), np.repeat(size, size)[word[:-1]] > LONG)


def spans(s: Sentences, span: int = SPAN, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first sentence (counted in its text) and number of sentences of every span.

    From every sentence on, the shortest run of at least ``span`` sentences (all of a shorter text) and ``least`` words.
    """
    n = np.diff(s.first)
    text = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(text))
    last = s.first[text + 1]
    end = np.maximum(np.searchsorted(s.word, s.word[i] + least), i + np.minimum(span, n[text]))
    good = np.flatnonzero((end <= last) & (s.word[np.minimum(end, len(s.word) - 1)] - s.word[i] >= least))
    i, end, text = i[good], end[good], text[good]
    return s.words.runs(s.word[i], s.word[end]).view(np.int64), text, (i - s.first[text]).astype(np.int32), (end - i).astype(np.int32)


def anchored(s: Sentences, run: int = RUN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``spans``, for the runs of ``run`` words with the least hash of ``window`` that follow each other.

    The sentences are those wholly inside; last come bits that tell which of them are pieces of long ones.
    """
    n = np.diff(s.words.first)
    count = np.maximum(n - run + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    a = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + s.words.first[text]
    h = s.words.runs(a, a + run)
    full = np.flatnonzero(a + run + window - 1 <= s.words.first[text + 1])
    best = full.copy()
    for j in range(1, window):
        best = np.where(h[full + j] <= h[best], full + j, best)
    best = np.unique(best)
    h, text, a = h[best], text[best], a[best]
    at, end = np.searchsorted(s.word, a), np.searchsorted(s.word, a + run, side="right") - 1
    new = end > at
    new[1:] &= (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, text, at, end = h[new], text[new], at[new], end[new]
    long = np.zeros(len(at), np.int64)
    for j in range(run):
        i = np.minimum(at + j, len(s.long) - 1)
        long |= (s.long[i] & (at + j < end)).astype(np.int64) << j
    return h.view(np.int64), text, (at - s.first[text]).astype(np.int32), (end - at).astype(np.int32), long


def places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """span hash, key, mark of the text, first sentence, width, and for a run that begins anywhere the bits of its long sentences: one row per span."""
    source = docs.select(docs[key].cast("long").alias("k"), mark_of(docs[text]).alias("mark"), docs[text].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.utf8(b.column(2))
            for x, y in portions(texts):
                s = sentences(texts[x:y])
                *own, long = anchored(s)
                h, text, at, width = (np.concatenate(both) for both in zip(spans(s), own))
                long = pa.concat_arrays([pa.nulls(len(h) - len(long), pa.int64()), pa.array(long)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), *(b.column(i).slice(x, y - x).take(pa.array(text)) for i in (0, 1)), pa.array(at), pa.array(width), long],
                    names=["span", "k", "mark", "at", "width", "long"])

    return common.on_workers(source).mapInArrow(run, "span long, k long, mark int, at int, width int, long long")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every place but the first of every span that repeats: span, k, mark, at, width, long, first_k, first_mark, first_at."""
    all_ = places(docs, key, text)
    place = F.struct("k", "mark", "at")
    counts = all_.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    # As a table of its own, the join below has a shuffle on either side, which adaptive execution can split.
    twice = common.written(counts.select("span", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("k", "mark", "at")]), "repeated")
    return all_.join(twice, "span").where("NOT (k <=> first_k AND mark = first_mark AND at = first_at)")


def mark_of(text: Column) -> Column:
    """What tells texts of one key, or of none, apart."""
    return F.hash(text)


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that loses sentences: key, sentences (their numbers, ascending), firsts (keys of the places that stay)."""
    return _removals(docs, key, text).select(F.col("k").alias(key), "sentences", "firsts")


def _removals(docs: DataFrame, key: str, text: str) -> DataFrame:
    hit = repeated(docs, key, text).withColumn("all", F.sequence("at", F.col("at") + F.col("width") - 1))
    run = F.struct("all", F.expr("filter(all, i -> shiftright(long, i - at) & 1 = 1)").alias("some"), "first_k")
    found = hit.groupBy("k", "mark").agg(
        F.collect_set(F.when(F.col("long").isNull(), F.struct("all", "first_k"))).alias("spans"), F.collect_set(F.when(F.col("long").isNotNull(), run)).alias("runs"))
    found = found.withColumn("base", F.expr("array_distinct(flatten(concat(transform(spans, x -> x.all), transform(runs, x -> x.some))))"))
    found = found.withColumn("rest", F.expr("filter(runs, x -> NOT arrays_overlap(x.all, base))"))
    return found.select(
        "k", "mark", F.expr("array_sort(array_distinct(concat(base, flatten(transform(rest, x -> x.all)))))").alias("sentences"),
        F.expr("array_sort(array_distinct(concat(transform(spans, x -> x.first_k), transform(filter(runs, x -> size(x.some) > 0), x -> x.first_k), transform(rest, x -> x.first_k))))").alias("firsts"))


def strike(data: bytes, drop: set[int]) -> bytes:
    """``data`` without the sentences whose numbers are in ``drop``; what stands between kept ones stays."""
    out, at = [], 0
    for i, (a, b) in enumerate(zip(*(x.tolist() for x in sentences([data]).places(0)))):
        if i in drop:
            out.append(data[at:a])
            at = b
    return b"".join(out) + data[at:]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated sentences struck from ``text``; documents that lose all their words stay, without them."""
    name = common.fresh(docs.columns, "_drop")
    lost = _removals(docs, key, text).select(F.col("k").alias(f"{name}k"), F.col("mark").alias(f"{name}m"), F.col("sentences").alias(name))
    same = docs[key].cast("long").eqNullSafe(lost[f"{name}k"]) & (mark_of(docs[text]) == lost[f"{name}m"])
    joined = docs.join(lost, same, "left").drop(f"{name}k", f"{name}m")
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if t is None or not d else strike(t, set(d)) for t, d in zip(common.utf8(b.column(at)), b.column(b.num_columns - 1).to_pylist())]
            columns = [pa.array(new, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.on_workers(joined).mapInArrow(run, docs.schema)
