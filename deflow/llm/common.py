"""Helpers shared by the operators: tables, shared folders, bounded samples and Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import deflow
from deflow.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


# What Spark sends to Python at once: its defaults, and what a session that still has them gets.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"),
         "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}
ROW_GROUP = 32 << 20    # bytes of a row group of an intermediate table
_SHIPPED: set[str] = set()


def on_workers(df: DataFrame) -> DataFrame:
    """``df``, after Spark has been given this package for its Python workers, once for each application.

    The driver serves the archive, so executors need neither an installed copy nor a folder in common. Rows hold
    whole texts or packed arrays here, so a session that still has Spark's default sizes of a batch gets those of
    ``BATCH``: either side of the pipe holds a batch and the one being built.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    for name, (default, small) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, small)
    if sc.applicationId not in _SHIPPED:
        root = Path(deflow.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="deflow-")) / "deflow.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    # Small row groups: a writer holds one in memory, and such a table is read as a whole anyway.
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no given column has it (case-insensitively, as Spark resolves names)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, by: str, key: Column, rows: int, salt: int = 0) -> DataFrame:
    """At most ``rows`` rows of each value of ``by``, with different hashes of ``key``: those with the least.

    A filter on the hash leaves a few times ``rows`` of a value, by its count; of these, equal hashes become one
    row map-side, so a key that repeats very often is one, and tasks keep their least ``rows`` before they meet.
    No value is gathered or sorted as a whole. Where keys repeat, fewer rows can result. ``by`` has few values.
    """
    own = df.where(F.col(by).isNotNull())
    counts = own.groupBy(by).count().collect()
    if not counts:
        return df.limit(0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r[by]), F.lit(int(min(1.0, 4 * rows / r["count"]) * (1 << 40))))])
    own = own.withColumn("_spot", F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40)))
    few = own.where(F.col("_spot") < share[F.col(by)]).groupBy(by, "_spot").agg(F.min(F.struct(*df.columns)).alias("_row"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_spot"))
    return few.withColumn("_place", place).where(F.col("_place") <= rows).select("_row.*")


def window_of(text: Column, key: Column, size: int, salt: int = 0) -> Column:
    """One stretch of ``size`` code points at a hashed place, so long texts give no more than short ones."""
    spare = F.greatest(F.length(text) - F.lit(size), F.lit(0)) + F.lit(1)
    return F.substr(text, (F.pmod(F.xxhash64(key, F.lit(salt), F.lit("at")), spare) + 1).cast("int"), F.lit(size))


def release() -> None:
    """Give memory of this process that is not in use back to the system, so that a worker's next task starts small."""
    from deflow.llm import words

    words.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library than glibc
        pass


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def arrow_schema(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def carry(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """``keep`` columns of ``batch`` with new ones behind them."""
    names = [*keep, *more]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), *more.values()], names=names)


def batches_of(table_: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``rows``, so per-batch work stays small."""
    for b in table_:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
