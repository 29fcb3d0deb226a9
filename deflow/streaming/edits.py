"""Edits as a stream: per-file state drops stale and repeated texts, batches re-analyse what is left.

Defined results: an edit without text deletes its file, and one for a file that is not there changes nothing; an
edit without revision is older than any other; one without workspace or file name names no file and is passed
over. Of edits with one revision, the first that arrives counts. A deleted file may come again with a later revision.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deflow.operators.diff import diff
from deflow.operators.solver import KEY, Solved, alone, place, resume, solve
from deflow.session import cut
from deflow.sources.code import read_tapes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EDIT = "ws string, uri string, text string, rev long"
CHANGED = "ws string, uri string, text string, rev long, sha string"    # no text and no sha: the file is gone
OLDEST = -(1 << 63)
COMPACT_EVERY = 64      # batches of which the log is rewritten as one base


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the newest text of one file if it is newer than, and different from, the registered one."""
    rev, sha = state.get if state.exists else (None, "")
    best = None
    for f in frames:  # a file edited very often arrives in several frames; only one row is held
        top = f.loc[f["rev"].idxmax()]
        if best is None or top["rev"] > best["rev"]:
            best = top
    if best is None or (rev is not None and best["rev"] <= rev):
        return
    text = None if pd.isna(best["text"]) else best["text"]
    now = "" if text is None else hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
    state.update((int(best["rev"]), now))
    if now != sha:
        yield pd.DataFrame([(key[0], key[1], text, int(best["rev"]), now or None)], columns=["ws", "uri", "text", "rev", "sha"])


def read_edits(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Edits arriving as JSON lines files."""
    r = spark.readStream.schema(EDIT)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).json(folder)


def changed_texts(edits: DataFrame) -> DataFrame:
    """The stream of real changes. State per file is a revision and a hash, never text; a deleted file keeps its
    revision, so an older edit that arrives late does not bring it back."""
    named = edits.where("ws IS NOT NULL AND uri IS NOT NULL").withColumn("rev", F.coalesce("rev", F.lit(OLDEST)))
    return named.groupBy("ws", "uri").applyInPandasWithState(
        _latest, CHANGED, "rev long, sha string", "update", GroupStateTimeout.NoTimeout)


class LiveAnalysis:
    """Analysis state that follows a stream of changed texts.

    Tapes of every batch are appended under ``folder`` and the newest version of a file counts, so a
    restarted driver rebuilds from there. Each batch writes the regressions it made and fixed. Every
    ``compact_every`` batches, what still counts of the log is written as one base and the batches in it are
    removed, so a restart reads the living files and fewer than ``compact_every`` batches, however long the stream ran.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.folder, self.compact_every = spark, folder, compact_every
        self._functions: DataFrame | None = None
        self._solved: Solved | None = None

    def _path(self, name: str, batch: int | None = None) -> str:
        return f"{self.folder}/{name}" + ("" if batch is None else f"/batch={batch}")

    def _fs(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        system, p = self._fs(path)
        return system.exists(p)

    def _numbers(self, name: str) -> list[int]:
        """Batch numbers of the folders below ``name``."""
        system, p = self._fs(self._path(name))
        if not system.exists(p):
            return []
        named = [x.getPath().getName() for x in system.listStatus(p)]
        return sorted(int(n.removeprefix("batch=")) for n in named if n.startswith("batch="))

    def _base(self, before: int | None = None) -> int | None:
        """The newest complete base (below ``before``): the state after the batch of that number."""
        done = [b for b in self._numbers("base") if (before is None or b < before) and self._exists(self._path("base", b) + "/files/_SUCCESS")]
        return done[-1] if done else None

    def _batches(self, before: int | None = None) -> list[int]:
        """Batches behind the base that are complete, which the marker of their last write tells."""
        base = self._base(before)
        late = [b for b in self._numbers("findings") if (base is None or b > base) and (before is None or b < before)]
        return [b for b in late if self._exists(self._path("findings", b) + "/_SUCCESS")]

    def _log(self, name: str, base: int | None, batches: list[int]) -> DataFrame:
        """Rows of the base and the batches behind it with the batch they came with."""
        read = self.spark.read
        parts = [] if base is None else [read.parquet(f"{self._path('base', base)}/{name}").withColumn("batch", F.lit(base).cast("long"))]
        if batches:
            rows = self.spark.read.option("basePath", self._path(name)).parquet(*[self._path(name, b) for b in batches])
            parts.append(rows.withColumn("batch", F.col("batch").cast("long")))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _newest(self, base: int | None, batches: list[int]) -> DataFrame:
        """Living files with the batch that wrote them last."""
        last = self._log("files", base, batches).groupBy("ws", "uri").agg(F.max("rev").alias("rev"), F.max_by(F.struct("batch", "sha"), "rev").alias("at"))
        return last.where("at.sha IS NOT NULL").select("ws", "uri", "rev", F.col("at.batch").alias("batch"), F.col("at.sha").alias("sha"))

    def functions(self, batches: list[int], base: int | None = None) -> DataFrame:
        """Tapes as of these batches on top of the base: rows written by the newest of them that has the file."""
        tapes_ = self._log("functions", base, batches)
        return tapes_.join(self._newest(base, batches).select("ws", "uri", "batch"), ["ws", "uri", "batch"], "left_semi").drop("batch")

    def compact(self, batch: int) -> None:
        """Write the state after ``batch`` as a base, then remove what it replaces.

        The files are written last and their marker makes the base count; a stop before leaves the log as it
        was, one behind it leaves folders that the next call removes.
        """
        base, batches = self._base(batch), self._batches(batch + 1)
        if not batches:
            return
        target = self._path("base", batch)
        self.functions(batches, base).write.mode("overwrite").parquet(f"{target}/functions")
        self._newest(base, batches).drop("batch").write.mode("overwrite").parquet(f"{target}/files")
        for name, last in (("functions", batch), ("files", batch), ("base", batch - 1)):
            for old in [b for b in self._numbers(name) if b <= last]:
                system, p = self._fs(self._path(name, old))
                system.delete(p, True)

    def _load(self, before: int | None = None) -> None:
        """The state after all complete batches (below ``before``); what a stopped batch left behind is no part of it."""
        if self._solved is not None:
            return
        base, batches = self._base(before), self._batches(before)
        if base is not None or batches:
            self._functions = place(self.functions(batches, base))
            self._solved = solve(self._functions)

    def apply(self, changed: DataFrame, batch: int) -> None:
        """Commit all changed files, then analyse, then report against the state before.

        The batch counts from its last write on; until then a repetition starts from the batches before it,
        and the state in memory stays as it was.
        """
        if self._exists(self._path("findings", batch) + "/_SUCCESS"):
            return
        self._load(batch)
        changed = cut(changed.select("ws", "uri", "text", "rev", "sha"))
        fresh = cut(alone(read_tapes(changed.where("text IS NOT NULL"))))
        fresh.write.mode("overwrite").parquet(self._path("functions", batch))
        changed.drop("text").write.mode("overwrite").parquet(self._path("files", batch))
        before = self._solved
        if before is None:
            functions = place(fresh)
            solved = solve(functions)
            found = solved.regressions.select(F.lit("new").alias("change"), "ws", "uri", "func_name", "symbol", "kind", "start_byte", "end_byte")
        else:
            touched = changed.select("ws", "uri")
            kept = self._functions.join(touched, ["ws", "uri"], "left_anti")
            keys = self._functions.join(touched, ["ws", "uri"], "left_semi").select(*KEY).unionByName(fresh.select(*KEY)).distinct()
            functions = place(kept.unionByName(fresh))
            solved = resume(functions, before, keys)
            found = diff(before.regressions, solved.regressions).select(
                "change", "ws", "uri", "func_name", "symbol", "kind", "start_byte", "end_byte")
        found.write.mode("overwrite").parquet(self._path("findings", batch))
        self._functions, self._solved = functions, solved
        if len(self._batches(batch + 1)) >= self.compact_every:
            self.compact(batch)

    def start(self, edits: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Follow an edit stream; ``once`` processes what is there and stops."""
        w = changed_texts(edits).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
            lambda df, batch: None if df.isEmpty() else self.apply(df, batch))
        return (w.trigger(availableNow=True) if once else w).start()

    def regressions(self) -> DataFrame | None:
        """Regressions of the current state."""
        self._load()
        return None if self._solved is None else self._solved.regressions

    def history(self) -> DataFrame:
        """What each batch made and fixed."""
        return self.spark.read.parquet(self._path("findings"))
