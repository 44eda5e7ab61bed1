"""Benchmark logs: lines like ``encode/simd_4bit/15  time:   [101.13 ns 101.53 ns 102.21 ns]`` as a table, and its reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "operation string, method string, seq_length int, time_low_ns double, time_median_ns double, time_high_ns double"
#: A result's pattern, the order of operations in the summary, a line of the summary, the message of an unknown unit, the steps of shown rates.
PATTERN = r"(?m)^(\w+)/(\w+)/(\d+)\s+time:\s+\[([0-9.]+)\s+(ns|µs|ms|us)\s+([0-9.]+)\s+(ns|µs|ms|us)\s+([0-9.]+)\s+(ns|µs|ms|us)\]"
OPERATIONS = ("encode", "decode", "roundtrip", "reverse_complement")
LINE, UNKNOWN = "    %-15s: %10s ns [%10s - %10s]", "Unknown time unit: "
STEPS = ((1e9, 1, " G"), (1e6, 0, " M"), (1e3, 0, " K"))

_ORDER = ("operation", "method", "seq_length", "time_low_ns", "time_median_ns", "time_high_ns")
#: A sorted range of the CSV file: its size by the plan's estimate (of lineitem's results about 460,000 rows), and how many there may be.
RANGE_BYTES, MOST_RANGES = 4 << 20, 10_000


def to_ns(value: Column, unit: Column) -> Column:
    """Nanoseconds; raises for an unknown unit."""
    u = F.lower(unit)
    factor = F.when(u == "ns", 1.0).when(u.isin("µs", "us"), 1e3).when(u == "ms", 1e6).when(u == "s", 1e9)
    return value * F.when(u.isNotNull() & factor.isNull(), F.raise_error(F.concat(F.lit(UNKNOWN), unit)).cast("double")).otherwise(factor)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per result. A value may hold one line or a whole log; a result may run over a line's end."""
    return split(lines.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(PATTERN), F.lit(0))).alias("m")), "m")


def split(matches: DataFrame, column: str, *others: str) -> DataFrame:
    """The fields of texts that match PATTERN, and the ``others`` columns: the parts between slashes, blanks and brackets (the fourth is ``time:``)."""
    parts = matches.select(*others, F.split(F.col(column), r"[/\s\[\]]+").alias("_parts"))
    part = lambda i: F.get("_parts", F.lit(i))
    times = {name: to_ns(part(i).cast("double"), part(i + 1)) for name, i in (("time_low_ns", 4), ("time_median_ns", 6), ("time_high_ns", 8))}
    return parts.select(*others, part(0).alias("operation"), part(1).alias("method"), part(2).cast("int").alias("seq_length"), *(c.alias(n) for n, c in times.items()))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Results of log files, each read whole."""
    return parse(spark.read.text(path, wholetext=True))


def ordered(results: DataFrame) -> DataFrame:
    """By operation, method and length; what these leave open goes by the times."""
    return results.orderBy(*_ORDER)


def write_csv(results: DataFrame, path: str) -> None:
    """One CSV file with a header, sorted. Ranges of rows are sorted and written side by side, their files then strung together as bytes."""
    spark, parts = results.sparkSession, f"{path.rstrip('/')}-parts-{uuid.uuid4().hex}"
    size = int(results._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # an estimate; tables of unknown size count as 2^63
    ranges = (max(1, min(MOST_RANGES, -(-size // RANGE_BYTES))),) if size < 1 << 50 else ()
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    try:
        results.repartitionByRange(*ranges, *map(F.col, _ORDER)).sortWithinPartitions(*_ORDER).write.csv(parts)
        _string_together(hadoop, conf, parts, path, ",".join(results.columns) + "\n")
    finally:
        hadoop.fs.Path(parts).getFileSystem(conf).delete(hadoop.fs.Path(parts), True)


def _string_together(hadoop, conf, parts: str, path: str, header: str) -> None:
    """Makes of a folder's part files, in the order of their names, the one file of the folder ``path``, which is replaced; a buffer at a time, whatever their size."""
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs, to = source.getFileSystem(conf), target.getFileSystem(conf)
    name = f"part-00000-{uuid.uuid4()}.csv"
    unfinished = hadoop.fs.Path(target, f"_{name}")  # readers skip it
    to.delete(target, True)
    out = to.create(unfinished)
    try:
        out.write(bytearray(header.encode()))
        for part in sorted(x for x in (f.getPath().getName() for f in fs.listStatus(source)) if x.startswith("part-")):
            data = fs.open(hadoop.fs.Path(source, part))
            try:
                hadoop.io.IOUtils.copyBytes(data, out, 1 << 20, False)
            finally:
                data.close()
    finally:
        out.close()
    if not to.rename(unfinished, hadoop.fs.Path(target, name)):
        raise OSError(f"{unfinished} can't be renamed")
    to.create(hadoop.fs.Path(target, "_SUCCESS")).close()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("header", True).csv(path)


def latest(results: DataFrame, order: str) -> DataFrame:
    """Of results with the same operation, method and length the one that comes last by ``order``."""
    columns = [c for c in results.columns if c not in ("operation", "method", "seq_length", order)]
    best = results.groupBy("operation", "method", "seq_length").agg(F.max_by(F.struct(*columns), order).alias("r"))
    return best.select("operation", "method", "seq_length", "r.*")


def overview(results: DataFrame) -> DataFrame:
    """One row: operations and methods (comma-joined), least, greatest and number of lengths, rows."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return results.agg(
        joined("operation").alias("operations"), joined("method").alias("methods"), F.min("seq_length").alias("min_length"), F.max("seq_length").alias("max_length"),
        F.countDistinct("seq_length").alias("n_lengths"), F.count("*").alias("n_rows"),
    )


def throughput(results: DataFrame) -> DataFrame:
    """Bases per second; the low bound comes from the high time and the other way round."""
    per = lambda c: F.col("seq_length") / F.col(c) * 1e9
    return results.withColumns({"throughput": per("time_median_ns"), "throughput_low": per("time_high_ns"), "throughput_high": per("time_low_ns")})


def error_bars(results: DataFrame) -> DataFrame:
    return results.withColumns({"error_low": F.col("time_median_ns") - F.col("time_low_ns"), "error_high": F.col("time_high_ns") - F.col("time_median_ns")})


def fixed(value: Column | str, digits: int) -> Column:
    """Text with so many decimals of the exact value, a tie to the even digit, as C and Python print; ``format_string`` rounds the shortest decimal form, ties up."""
    v = F.col(value) if isinstance(value, str) else value
    return F.call_function("format_number", v, F.lit(f"0.{'0' * digits}" if digits else "0"))


def format_throughput(value: Column | str) -> Column:
    """With an SI prefix."""
    v = F.col(value) if isinstance(value, str) else value
    out = fixed(v, 0)
    for by, digits, prefix in reversed(STEPS):
        out = F.when(v >= by, F.concat(fixed(v / by, digits), F.lit(prefix))).otherwise(out)
    return out


def summary(results: DataFrame) -> DataFrame:
    """Results of the known operations in their fixed order, then by length and method, with a line of text each."""
    place = F.array_position(F.array(*map(F.lit, OPERATIONS)), F.col("operation"))
    line = F.format_string(LINE, "method", *(fixed(c, 2) for c in ("time_median_ns", "time_low_ns", "time_high_ns")))
    return results.withColumn("place", place).where("place > 0").withColumn("line", line).orderBy("place", "seq_length", "method")
