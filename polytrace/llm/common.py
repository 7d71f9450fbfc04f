"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes ``[\x20\x09-\x0D]``; ``bytes.split()`` cuts at exactly these.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Where none is set (tests, a laptop) a temporary one is made, but only for a
    local master: another machine could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark, "_polytrace_scratch", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        own = spark._polytrace_scratch = "file://" + tempfile.mkdtemp(prefix="polytrace-")
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut,
    and a lost executor costs its own tasks alone."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/polytrace-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> list[str]:
    """The tables that ``stored`` has written in this session and that are still there, in order."""
    if not hasattr(spark, "_polytrace_tables"):
        spark._polytrace_tables = []
    return spark._polytrace_tables


def discard(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Remove this session's stored tables but for ``keep``, once nothing is read from them any more: after a result is written. Returns how many went."""
    gone = [t for t in tables(spark) if t not in keep]
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for t in gone:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t).getParent()
        folder.getFileSystem(configuration).delete(folder, True)
        tables(spark).remove(t)
    return len(gone)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as strings; null becomes empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def table(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    """A batch of ``schema`` from Python lists or arrays."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a step holds at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def hash_sample(df: DataFrame, h: Column, n: int, total: int) -> DataFrame:
    """The ``n`` rows of about ``total`` whose hashes ``h`` (64 bits, signed) are smallest.

    Rows beyond twice the expected hash are put aside first, so that no task hands over more than its share.
    """
    share = min(1.0, (2 * n + 100) / max(1, total))
    out = df.withColumn("_hash", h)
    if share < 1:
        out = out.where(F.col("_hash") <= int(share * 2**64) - 2**63)
    return out.orderBy("_hash", *[c for c in df.columns]).limit(n).drop("_hash")
