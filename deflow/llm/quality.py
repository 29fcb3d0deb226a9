"""Quality score by compression: dictionaries of good and of bad labelled text, and a calibrated difference.

Both dictionaries compress a text in pieces; ``(bad - good) / (bad + good)`` of the sizes is mapped to a
probability by a logistic curve that is fitted on further labelled rows.

Defined results: a null or empty text has difference 0 and gets the curve's value there. Without rows of
both labels every score is 0.5. Labels other than 0 and 1, or null, teach nothing; a document labelled
both ways teaches both; of documents with one key, the least text teaches. Repeated rows are scored one by one; clashing column names get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deflow.llm import common
from deflow.llm.zdict import Sizer, dictionary

ROWS = 512          # labelled rows of each label for the dictionaries, and as many for the curve
STRETCH = 512       # code points of each dictionary row
CURVE_TEXT = 4096   # code points of each row the curve is fitted on
LEVEL = 6
PIECE = 256


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _difference(sizer: Sizer, data: bytes | None) -> float:
    bad, good = sizer.sizes(data or b"")
    return float((bad - good) / (bad + good)) if bad + good else 0.0


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method, both labels weighing the same in total."""
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones_like(x)])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> QualityModel | None:
    """Learn from the documents that ``labels`` (key and label) marks, about ``2 * ROWS`` of each label at most.

    The labels are sampled by a hash of the key before they meet the documents, so the side that is broadcast
    has a fixed size and only the sampled texts leave the scan.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    chosen = docs.sparkSession.createDataFrame(
        common.hash_sample(marked, "y", F.col("k"), 2 * ROWS).collect(), marked.schema)
    rows = docs.select(F.col(text).alias("t"), F.col(key).alias("k")).where("t IS NOT NULL").join(F.broadcast(chosen), "k")
    rows = rows.groupBy("y", "k").agg(F.min("t").alias("t"))     # of documents with one key, one text
    sample = rows.select(
        "y", common.window_of(F.col("t"), F.col("k"), CURVE_TEXT).alias("t"),
        common.window_of(F.col("t"), F.col("k"), STRETCH, 1).alias("s"),
        (F.pmod(F.xxhash64("k", F.lit(7)), F.lit(2)) == 0).alias("first")).collect()
    sample.sort(key=lambda r: (r["y"], r["t"], r["s"]))
    of = {(y, f): [r for r in sample if r["y"] == y and r["first"] == f] for y in (0, 1) for f in (True, False)}
    if not all(of[y, True] for y in (0, 1)):
        return None
    good, bad = (dictionary([r["s"].encode("utf-8", "surrogatepass") for r in of[y, True]], 4 * ROWS * STRETCH * 2) for y in (1, 0))
    sizer = Sizer([bad, good], LEVEL, PIECE)
    curve = [r for y in (0, 1) for r in (of[y, False] or of[y, True])]
    x = np.array([_difference(sizer, r["t"].encode("utf-8", "surrogatepass")) for r in curve])
    slope, offset = logistic_fit(x, np.array([r["y"] for r in curve], np.float64))
    return QualityModel(good, bad, slope, offset)


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with score double, from 0 to 1."""
    keep = list(docs.columns) if keep is None else keep
    name = common.fresh(keep, "score")
    if model is None:
        return docs.select(*[docs[c] for c in keep], F.lit(0.5).alias(name))
    source = docs.select(*[docs[c] for c in keep], docs[text].alias(common.fresh(keep, "_text")))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer([model.bad, model.good], LEVEL, PIECE)
        for b in common.batches_of(batches, 512):
            d = np.array([_difference(sizer, t) for t in common.utf8(b.column(len(keep)))], np.float64)
            p = 1 / (1 + np.exp(-np.clip(model.slope * d + model.offset, -40, 40)))
            yield common.carry(b, keep, **{name: pa.array(p, pa.float64())})

    return common.on_workers(source).mapInArrow(run, schema)
