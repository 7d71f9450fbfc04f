"""Running a stream to its present end and looking at the result as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints and results go: the folder the cluster names; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    own = getattr(spark, "_polytrace_streams", None)
    if own is None:
        own = spark._polytrace_streams = "file://" + tempfile.mkdtemp(prefix="polytrace-streams-")
    return own


def finished(stream: DataFrame) -> DataFrame:
    """The rows an append-mode stream writes when all that is there now has been read."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def completed(stream: DataFrame) -> DataFrame:
    """The whole state of an aggregating stream at the present end. The result is rewritten each time, so it must be as small as a report."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def put(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/rows")

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream, with the schema it has now."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
