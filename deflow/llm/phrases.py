"""Phrase collocations by SON partitioning: local mining of shards, and exact counts of what any of them found.

Texts are cut into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and tabs; A-Z count as a-z.
A phrase is a run of words inside a piece; its frequency counts all its places, by language.

1. **Mining.** A shard is what a task reads until it has ``SHARD_WORDS`` words. It is mined completely, all phrases
   of one to ``most`` words, in arrays of 64-bit hashes. A phrase is offered when its local count reaches the
   support times the shard's share of all words: if every shard stayed below that, the sum would stay below
   the support. So each phrase with enough places is offered by one shard at least.
2. **Union and counts.** Hashes go to buckets with their local counts, packed and sorted, offered ones apart. A
   bucket unites the offers and adds up the counts of these candidates from all shards, offered there or not.
   With more shards than the support is large, every phrase reaches its share, and all are offered.
3. **Spelling.** Offers carry a 32-bit hash of a text that has the phrase. Texts that are asked for are read once
   more, and give the words of the candidates with enough places, far fewer rows than there are phrases.
4. **Scores** are joins and aggregates over these phrases, in decimal numbers, so products keep all digits.

Defined results: a null text has no words; a null language is ``und``. Ties go to the smallest cut, and in the
report to the more frequent, then to the phrase that comes first by bytes. An empty table has no phrase. Rows that
repeat count each. Phrases are told apart by 64-bit hashes. Other columns do not matter, as only text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deflow.llm import common
from deflow.llm.setjoin import bucket_of, cut_by, pack, unpack
from deflow.llm.words import Words, mix64, portions, split

SUPPORT = 10
LONGEST = 3                 # words of a phrase
INSIDE = 50                 # percent of a phrase's places inside a longer one that make it redundant
TOP = 2000
SCALE = 1_000_000
SHARD_WORDS = 500_000       # words a task mines at a time, three times as many phrases: about 120 MB while it sorts
BUCKET = 4_000_000          # phrases of a bucket, before shards combine equal ones
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
BREAKS = ".,;:!?\n\x0b\x0c\r"

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _lower(word: bytes) -> bytes:
    return word.lower()     # of bytes, A-Z alone


class Pieces:
    """The phrases of a batch of texts: place of the first word and width, by width."""

    def __init__(self, texts: list[bytes | None], langs: list[str], most: int = LONGEST):
        self.words: Words = split(texts, gaps=_GAP)
        w, n = self.words, len(self.words.starts)
        line = np.cumsum(_BREAK[w.data])[w.starts] if n else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(w.first))
        self.text, self.at, self.hashes = [], [], []
        code = {x: np.uint64(xxhash.xxh3_64_intdigest(x.encode())) for x in set(langs)}
        lang = np.array([code[x] for x in langs], np.uint64)
        for width in range(1, most + 1):
            a = np.arange(max(0, n - width + 1))
            b = a + width - 1
            a = a[(text[a] == text[b]) & (line[a] == line[b])]
            self.at.append(a), self.text.append(text[a])
            self.hashes.append(mix64(w.runs(a, a + width) ^ lang[text[a]]))

    def phrase(self, width: int, i: int) -> list[str]:
        w, a = self.words, int(self.at[width - 1][i])
        return [_lower(bytes(w.data[w.starts[j]:w.ends[j]])).decode("utf-8", "replace") for j in range(a, a + width)]


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


class Shard:
    """Phrases of the texts one task has read since the last flush."""

    def __init__(self, buckets: int, support: int, total: int):
        self.buckets, self.support, self.total = buckets, support, total
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.spot: list[np.ndarray] = []
        self.words = 0

    def add(self, pieces: Pieces, spots: np.ndarray) -> None:
        self.hashes += pieces.hashes
        self.spot += [spots[t] for t in pieces.text]
        self.words += len(pieces.words.starts)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed hashes, counts and texts of the offers, hashes and counts of the rest)."""
        if not self.words:
            return
        h, spot = np.concatenate(self.hashes), np.concatenate(self.spot)
        least = -(-self.support * self.words // self.total)      # rounded up: a count that reaches the share reaches this
        self.clear()
        order = np.argsort(h)
        h, spot = h[order], spot[order]
        del order
        first = _runs(h)
        count = np.diff(np.append(first, len(h)))
        spot = np.minimum.reduceat(spot, first)
        h = h[first]
        offered = count >= least
        for k, a, b in cut_by(bucket_of(h, self.buckets)):
            own = offered[a:b]
            yield k, pack(*_coded(h[a:b][own], count[a:b][own]), spot[a:b][own], *_coded(h[a:b][~own], count[a:b][~own]))


def _coded(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaps of sorted hashes, and counts in as few bytes as hold them."""
    return np.diff(h, prepend=np.uint64(0)), count.astype("<u1" if not len(count) or count.max() < 256 else "<u4" if count.max() < 1 << 32 else "<u8")


def totals(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, n: all words of each language."""
    words = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    return docs.groupBy(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang")).agg(F.sum(words).alias("n"))


def counted(rows: DataFrame, total: int, support: int, most: int) -> DataFrame:
    """h, f, spot of all phrases of ``rows`` (t, lang, spot) with ``support`` places: hash, places, and a text that has it."""
    buckets = max(16, -(-total * most // BUCKET))

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(buckets, support, total)
        for b in batches:
            texts, langs, spots = common.utf8(b.column(0)), b.column(1).to_pylist(), b.column(2).to_numpy().astype("<u4")
            for x, y in portions(texts):
                shard.add(Pieces(texts[x:y], langs[x:y], most), spots[x:y])
                if shard.words >= SHARD_WORDS:
                    for k, blob in shard.flush():
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])
        for k, blob in shard.flush():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

    def united(t: pa.Table) -> pa.Table:
        offers, rest = [], []
        for blob in t.column("blob"):
            gaps, count, spot, gaps_rest, count_rest = unpack(blob.as_py())
            offers.append((np.cumsum(gaps, dtype=np.uint64), count, spot))
            if len(gaps_rest):
                rest.append((np.cumsum(gaps_rest, dtype=np.uint64), count_rest))
        h = np.concatenate([o[0] for o in offers])
        order = np.argsort(h)
        h = h[order]
        first = _runs(h)
        h = h[first]
        f = np.zeros(0, np.int64)
        spot = np.zeros(0, "<u4")
        if len(h):
            f = np.add.reduceat(np.concatenate([o[1].astype(np.int64) for o in offers])[order], first)
            spot = np.minimum.reduceat(np.concatenate([o[2] for o in offers])[order], first)
        for other, count in rest:       # candidates count where they were not offered, too
            at = np.minimum(np.searchsorted(h, other), max(0, len(h) - 1))
            hit = h[at] == other if len(h) else np.zeros(len(other), bool)
            f[at[hit]] += count[hit].astype(np.int64)       # hashes of one shard are distinct
        keep = f >= support
        return pa.table({"h": pa.array(h[keep].view(np.int64)), "f": pa.array(f[keep]), "spot": pa.array(spot[keep].astype(np.int64))})

    posts = common.on_workers(rows).select("t", "lang", "spot").mapInArrow(mined, "bucket int, blob binary")
    return posts.groupBy("bucket").applyInArrow(united, "h long, f long, spot long")


def spelled(rows: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """lang, words (array), f of the ``frequent`` phrases, from the texts they name."""
    asked = frequent.groupBy("spot").agg(F.sort_array(F.collect_list(F.struct("h", "f"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(common.utf8(b.column(0))):
                lang = b.column(1)[i].as_py()
                asked = b.column(2)[i].values
                want, f = asked.field("h").to_numpy(), asked.field("f").to_numpy()
                p = Pieces([t], [lang], most)
                out = []
                for width in range(1, most + 1):
                    h, at = np.unique(p.hashes[width - 1].view(np.int64), return_index=True)
                    place = np.minimum(np.searchsorted(want, h), len(want) - 1)
                    hit = want[place] == h
                    out += [(lang, p.phrase(width, j), n, x) for j, n, x in zip(at[hit].tolist(), f[place[hit]].tolist(), h[hit].tolist())]
                for j in range(0, len(out), 4096):
                    lang_, words, n, h = zip(*out[j:j + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(lang_), pa.array(words, pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(h, pa.int64())], names=["lang", "words", "f", "h"])

    met = common.on_workers(rows).join(asked, "spot").select("t", "lang", "asked")
    # Copies of a text spell the same; a first value is combined map-side.
    found = met.mapInArrow(run, "lang string, words array<string>, f long, h long")
    return found.groupBy("h").agg(F.first(F.struct("lang", "words", "f")).alias("p")).select("p.*")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, most: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``most`` words with ``support`` places (lang, words, phrase, f), and the totals (lang, n)."""
    n = common.written(totals(docs, text, lang), "words")
    total = n.agg(F.sum("n")).first()[0] or 0
    rows = docs.select(docs[text].alias("t"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang")).where("t IS NOT NULL")
    rows = rows.withColumn("spot", F.xxhash64("t", "lang").bitwiseAND(F.lit(0xFFFFFFFF)))
    frequent = common.written(counted(rows, max(1, int(total)), support, most), "frequent")
    out = common.written(spelled(rows, frequent, most).withColumn("phrase", F.array_join("words", " ")), "phrases")
    return out, n


def scored(found: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of every phrase of two words or more, by its lowest-scoring cut."""
    f = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("places"))
    cuts = found.where(F.size("words") > 1).select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    for name, part in (("l", F.slice("words", 1, F.col("k"))), ("r", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))):
        cuts = cuts.withColumn("part", F.array_join(part, " ")).join(f, ["lang", "part"]).withColumnRenamed("places", name).drop("part")
    big = {c: f"cast({c} AS decimal(19,0))" for c in "alr"}
    # ``div`` of decimals cuts the exact quotient down.
    cuts = cuts.withColumn("score", F.expr(f"({big['a']} * {big['a']} * {SCALE}) div ({big['l']} * {big['r']})"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("c"))
    return best.select("lang", "c.words", "phrase", "c.a", "c.l", "c.r", "c.score")


def redundant(found: DataFrame, percent: int = INSIDE) -> DataFrame:
    """lang, phrase: those with ``percent`` of their places or more inside one longer phrase."""
    longer = found.where(F.size("words") > 2)
    spans = F.expr("flatten(transform(sequence(2, size(words) - 1), w -> transform(sequence(1, size(words) - w + 1), i -> array_join(slice(words, i, w), ' '))))")
    most = longer.select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return found.join(most, ["lang", "phrase"]).where(
        F.expr(f"cast(longer AS decimal(19,0)) * 100 >= cast(f AS decimal(19,0)) * {percent}")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, most: int = LONGEST,
                 top: int = TOP, percent: int = INSIDE) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, n = phrases(docs, text, lang, support, most)
    left = scored(found).drop("words").join(redundant(found, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark limits each task's share of a language to its first rows before they meet.
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
