"""Language identification by compression against one raw-content dictionary per language.

A language's dictionary is made of short stretches of its training texts. A text gets the language whose
dictionary compresses it to the fewest bytes; the margin to the next one is the confidence, and a narrow
margin means that the text is rejected. Languages are learned and scored in blocks of about ``BLOCK``: neither the driver
nor a task holds the dictionaries of more, and their number is not limited.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected. So is every
text when nothing could be learned. Equal sizes go to the language with more training rows, then by name.
Repeated rows are scored one by one; further columns are kept, and new names that clash get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deflow.llm import common
from deflow.llm.zdict import Sizer, dictionary

ROWS = 256          # training rows taken of each language: the documented bound of the sample
STRETCH = 512       # code points taken of each of them
LEVEL = 6
MARGIN = 0.002      # a text is accepted when the runner-up needs at least this share more bytes
BLOCK = 256         # languages whose dictionaries (64 to 130 KB each) are held at once
UNKNOWN = "und"
FOUND = "struct<pred:string,rows:long,size:long,next:long>"    # the best language, its training rows and bytes; bytes of the next
FOUND_ARROW = pa.struct([("pred", pa.string()), ("rows", pa.int64()), ("size", pa.int64()), ("next", pa.int64())])

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def normal(text: str) -> bytes:
    """Lower-cased letters with single blanks: digits, marks of junk and layout say nothing of a language."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class LanguageModel:
    """A block of languages, most frequent first."""

    languages: tuple[str, ...]
    counts: tuple[int, ...]             # training rows
    dictionaries: tuple[bytes, ...]


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None) -> Iterator[LanguageModel]:
    """Learn from the rows of ``train`` with text and language, block by block; at most ``ROWS`` of each language."""
    key = F.xxhash64(text) if key is None else key
    rows = train.select(common.window_of(F.col(text), key, STRETCH).alias("t"), F.col(lang).alias("l"), key.alias("k")).where("t IS NOT NULL AND l IS NOT NULL")
    blocks = -(-rows.agg(F.count_distinct("l")).first()[0] // BLOCK)
    for block in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("l"), F.lit(blocks)) == block)
        counts = {r["l"]: r["count"] for r in own.groupBy("l").count().collect()}
        parts: dict[str, list[bytes]] = {}
        for r in sorted(common.hash_sample(own, "l", F.col("k"), ROWS).select("l", "t").collect(), key=lambda r: (r["l"], r["t"])):
            parts.setdefault(r["l"], []).append(normal(r["t"]))
        names = sorted(parts, key=lambda x: (-counts[x], x))
        if names:   # a block is a range of hashes, and none may lie in it
            yield LanguageModel(tuple(names), tuple(counts[n] for n in names), tuple(dictionary(parts[n], 4 * ROWS * STRETCH) for n in names))


def judge(model: LanguageModel):
    """The two best languages of each text: of ``model``, and of what the blocks before it found."""
    @F.arrow_udf(FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sizer = Sizer(list(model.dictionaries), LEVEL)
        for texts, before in batches:
            out = []
            for t, known in zip(texts, before):     # one text at a time leaves the batch
                t, known = t.as_py(), known.as_py()
                if t is None or not _LETTER.search(t):
                    out.append(None)
                    continue
                sizes = sizer.sizes(normal(t))
                two = [(int(sizes[i]), -model.counts[i], model.languages[i]) for i in np.argsort(sizes, kind="stable")[:2]]
                if known is not None:
                    two += [(known["size"], -known["rows"], known["pred"])] + ([] if known["next"] is None else [(known["next"], 0, "")])
                    two.sort()
                out.append({"pred": two[0][2], "rows": -two[0][1], "size": two[0][0], "next": two[1][0] if len(two) > 1 else None})
            yield pa.array(out, FOUND_ARROW)
        common.release()

    return run.asNondeterministic()     # marked so that a filter is not evaluated anew


def predict(docs: DataFrame, models: Iterable[LanguageModel], text: str = "text", keep: list[str] | None = None,
            margin: float = MARGIN) -> DataFrame:
    """``keep`` columns (all by default) with lang_pred string, score double, lang_ok boolean (not rejected)."""
    keep = list(docs.columns) if keep is None else keep
    names = {n: common.fresh(keep, n) for n in ("lang_pred", "score", "lang_ok")}
    made = common.fresh(docs.columns, "_lang")
    # Only texts and what was found go to Python; what is kept stays in the JVM.
    found = common.on_workers(docs).withColumn(made, F.lit(None).cast(FOUND))
    for i, model in enumerate(models):
        # Between blocks the state is a table, so that no task meets the dictionaries of two.
        found = common.written(found, "languages") if i else found
        found = found.withColumn(made, judge(model)(F.col(text), F.col(made)))
    x = F.col(made)
    gap = F.when(x["next"].isNull(), F.lit(1.0)).otherwise((x["next"] - x["size"]) / x["next"])
    score = F.when(x.isNull(), F.lit(0.0)).otherwise(gap)
    return found.select(*keep, F.coalesce(x["pred"], F.lit(UNKNOWN)).alias(names["lang_pred"]), score.alias(names["score"]),
                        (x.isNotNull() & (score >= margin)).alias(names["lang_ok"]))


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` modulo ``folds`` (a null key counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents outside the held-out fifth and predict all of them."""
    return predict(docs, fit(docs.where(~held_out("doc_id", 5, 0)), key=F.col("doc_id")), keep=keep)


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is clear, with the columns they came with."""
    out = identify(docs)
    return out.where(F.col(out.columns[-1])).select(*docs.columns)
