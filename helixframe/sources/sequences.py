"""FASTA and FASTQ readers, and packed sequences in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode4, encode4


def parse_fasta(records: DataFrame, column: str = "value") -> DataFrame:
    """id, description, seq of texts that begin with a header line (with or without its ``>``). Values without a header are left out."""
    text = F.regexp_replace(F.ltrim(F.col(column)), r"\A>", "")
    header = F.regexp_extract(text, r"\A([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(text, r"\A[^\r\n]*", ""), r"\s", "")
    rows = records.select(header.alias("h"), seq.alias("seq")).where(F.length("h") > 0)
    return rows.select(F.regexp_extract("h", r"\A(\S*)", 1).alias("id"), F.trim(F.regexp_replace("h", r"\A\S*", "")).alias("description"), "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq. Files are split at ``>`` that begins a line, and so read in parallel."""
    first = spark.read.option("lineSep", "\n>").text(path)
    return parse_fasta(first.where(F.length(F.trim("value")) > 0))


def parse_fastq(lines: DataFrame, column: str = "value") -> DataFrame:
    """id, description, seq, quality of texts that hold one four-line record each."""
    part = F.split(F.regexp_replace(F.regexp_replace(F.col(column), r"\A@", ""), "\r", ""), "\n")
    header = F.element_at(part, 1)
    rows = lines.where(F.size(part) >= 4)
    return rows.select(F.regexp_extract(header, r"\A(\S*)", 1).alias("id"), F.trim(F.regexp_replace(header, r"\A\S*", "")).alias("description"), F.element_at(part, 2).alias("seq"), F.element_at(part, 4).alias("quality"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq, quality of four-line records. Files are split at ``@`` that begins a line, and so read in parallel.

    Such an ``@`` begins a record, or a quality line, whose record is then in two pieces: three lines, and a line without its ``@``. These
    are joined by their places: in one split they are neighbours, and the first piece of a split goes with the last one of the split before it in the file.
    """
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", "\n@").text(path).select(
        F.rtrim("value").alias("value"), F.monotonically_increasing_id().alias("at"), meta["file_path"].alias("file"), meta["file_block_start"].alias("start"),
        (meta["file_block_start"] + meta["file_block_length"]).alias("end"),
    ).withColumn("lines", F.size(F.split(F.regexp_replace("value", r"[\r\n]+\z", ""), "\n")))
    whole = pieces.where("lines >= 4").select("value")
    heads, tails = (pieces.where(f"lines {x}") for x in ("= 3", "= 1"))
    # A head's tail is the next piece; of a split's last head it may be the first piece of the next split, whatever task has read that.
    last = pieces.groupBy("file", "start").agg(F.max("at").alias("at")).withColumn("last", F.lit(True))
    first = pieces.groupBy("file", "start").agg(F.min("at").alias("at")).withColumn("first", F.lit(True))
    heads = heads.join(last, ["file", "start", "at"], "left").select(F.col("value").alias("head"), "file", F.when(F.col("last"), F.col("end")).alias("place"), F.when(F.col("last").isNull(), F.col("at") + 1).alias("next"))
    tails = tails.join(first, ["file", "start", "at"], "left").select(F.col("value").alias("tail"), "file", "at", F.when(F.col("first"), F.col("start")).alias("start"))
    value = F.concat("head", F.lit("\n@"), "tail").alias("value")
    inner = heads.where("next is not null").select("head", F.col("next").alias("at")).join(tails.select("tail", "at"), "at").select(value)
    across = heads.where("place is not null").select("head", "file", F.col("place").alias("start")).join(tails.where("start is not null").select("tail", "file", "start"), ["file", "start"]).select(value)
    return parse_fastq(whole.union(inner).union(across))


def pack(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``seq`` as packed and n_bases."""
    return df.withColumn("packed", encode4(seq)).withColumn("n_bases", F.octet_length(F.col(seq).cast("binary"))).drop(seq)


def unpack(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn(seq, decode4("packed", "n_bases")).drop("packed", "n_bases")


def write_packed(df: DataFrame, path: str, seq: str = "seq") -> None:
    """Packed Parquet; filters on n_bases reach the scan."""
    pack(df, seq).write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str, *, decode: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return unpack(df) if decode else df
