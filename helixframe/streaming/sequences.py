"""Sequence columns in streaming queries: the functions hold no state, so the same projection runs in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode4, reverse_complement


def encoded(stream: DataFrame, seq: str = "seq") -> DataFrame:
    """The stream with packed, n_bases and revcomp."""
    return stream.withColumns({"packed": encode4(seq), "n_bases": F.octet_length(F.col(seq).cast("binary")), "revcomp": reverse_complement(seq)})


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Writes what the stream has now to Parquet and returns it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def parquet_stream(spark: SparkSession, like: str, pattern: str) -> DataFrame:
    """A stream of the Parquet files of a glob pattern, with the schema of the table ``like``."""
    return spark.readStream.schema(spark.read.parquet(like).schema).parquet(pattern)
