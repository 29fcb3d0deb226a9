"""A keyed table of records with versions, kept in one folder.

``data/<snapshot>/<part>=<n>/`` holds rows as Parquet, ``versions/<number>.json`` is a manifest: for every hash
part of the keys, the snapshot that holds its rows. A write puts its rows into a new snapshot first and its
manifest last, by a rename that fails where that version exists. So a write that is stopped leaves no trace
for readers, a reader keeps what its version names, what is read can be written back to the same folder, and
of two writers that start from one version the later one gets ``Conflict``. A merge reads and rewrites only
the parts that its keys fall into; a manifest grows with the number of parts, not with the rows.

The rename must be atomic and refuse an existing name, as on HDFS and local disks. Null is a key like any
other. Each key has one row: of several rows written together the one with the highest ``order`` stays, ties
and writes without an order by the rows' JSON text. Columns that a merge lacks are null.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deflow.session import cut

PARTS = 64


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: dict[str, str]   # number of a part -> snapshot
    count: int              # parts that keys are hashed into, fixed by the first version
    column: str             # name of the part in the folders
    schema: StructType


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "instance_id", parts: int = PARTS):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # -- folders -----------------------------------------------------------------------------------

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The given version, else the newest; None where nothing has been written."""
        known = self.versions()
        if number is None and not known:
            return None
        path, fs = self._at(f"versions/{number if number is not None else known[-1]:012d}.json")
        stream = fs.open(path)
        try:
            m = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(m["number"], m["parts"], m["count"], m["column"], StructType.fromJson(m["schema"]))

    def _commit(self, v: Version) -> Version:
        text = json.dumps({"number": v.number, "parts": v.parts, "count": v.count, "column": v.column, "schema": v.schema.jsonValue()})
        draft, fs = self._at(f"versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(text.encode())
        out.close()
        final, _ = self._at(f"versions/{v.number:012d}.json")
        context = self._hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Py4JJavaError as exc:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(exc.java_exception):
                raise Conflict(f"version {v.number} of {self.path} exists already") from exc
            raise
        return v

    # -- rows --------------------------------------------------------------------------------------

    def _rows(self, v: Version, only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{s}/{v.column}={p}" for p, s in sorted(v.parts.items()) if only is None or p in only]
        return self.spark.read.schema(v.schema).parquet(*paths) if paths else self.spark.createDataFrame([], v.schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version, else of the newest; None where nothing has been written."""
        v = self.version(version)
        return None if v is None else self._rows(v)

    def _single(self, df: DataFrame, order: Column | None) -> DataFrame:
        """One row per key."""
        row = F.struct(*[df[c] for c in df.columns])
        rank = F.struct(F.lit(0) if order is None else order, F.to_json(row))
        return df.groupBy(df[self.key].alias("k")).agg(F.max_by(row, rank).alias("row")).select("row.*")

    def _part(self, count: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(count)).cast("int")

    def _write(self, df: DataFrame, count: int, column: str) -> dict[str, str]:
        """Rows as a new snapshot; parts without rows are not in the answer."""
        snapshot = uuid.uuid4().hex
        # Adaptive execution splits large parts and puts small ones together.
        df.withColumn(column, self._part(count)).hint("rebalance", column).write.partitionBy(column).parquet(f"{self.path}/data/{snapshot}")
        return {n.split("=", 1)[1]: snapshot for n in self._names(f"data/{snapshot}") if n.startswith(f"{column}=")}

    def replace(self, df: DataFrame, order: Column | None = None) -> Version:
        """A version that holds ``df`` alone, with its columns."""
        old = self.version()
        column = "part"
        while column in {c.lower() for c in df.columns}:
            column += "_"
        parts = self._write(self._single(df, order), self.parts, column)
        return self._commit(Version(old.number + 1 if old else 1, parts, self.parts, column, df.schema))

    def _change(self, old: Version, keys: DataFrame, rows: DataFrame | None) -> Version:
        touched = {str(r[0]) for r in keys.select(self._part(old.count)).distinct().collect()}  # at most one a part
        left = self._rows(old, touched)
        gone = keys.select(F.col(self.key).alias("k_gone"))
        left = left.join(gone, left[self.key].eqNullSafe(gone["k_gone"]), "left_anti")
        made = self._write(left if rows is None else left.unionByName(rows), old.count, old.column)
        kept = {p: s for p, s in old.parts.items() if p not in touched}
        return self._commit(Version(old.number + 1, kept | made, old.count, old.column, old.schema))

    def merge(self, new: DataFrame, order: Column | None = None, base: Version | None = None) -> Version:
        """A version in which rows of ``new`` replace those with their keys.

        ``base`` is the version that ``new`` was made from; if it is no longer the newest one, the merge is a ``Conflict``.
        """
        old = base or self.version()
        if old is None:
            return self.replace(new, order)
        if more := set(new.columns) - set(old.schema.names):
            raise ValueError(f"columns that the store does not have: {sorted(more)}")
        single = self._single(new, order)
        have = set(new.columns)
        rows = cut(single.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema]))
        return self._change(old, rows, rows)

    def remove(self, keys: DataFrame) -> Version | None:
        """A version without the rows of ``keys``."""
        old = self.version()
        return None if old is None else self._change(old, cut(keys.select(self.key).distinct()), None)

    def forget(self, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` versions and what only they hold; the number of snapshots deleted.

        Not to be called while others write: rows whose manifest is still to come belong to no version.
        """
        known = self.versions()
        live = {s for n in known[-keep:] for s in self.version(n).parts.values()}
        for n in known[:-keep]:
            path, fs = self._at(f"versions/{n:012d}.json")
            fs.delete(path, False)
        dead = [s for s in self._names("data") if s not in live]
        for s in dead:
            path, fs = self._at(f"data/{s}")
            fs.delete(path, True)
        return len(dead)
