import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import benchmark_log as log
from helixframe.sources import sequences as io
from helixframe.streaming import sequences as streaming


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACGT\nAC-N\n>s2\n>s3 a>b\r\nGGG\r\n")
    got = [tuple(r) for r in io.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("id").collect()]
    assert got == [("s1", "first one", "ACGTAC-N"), ("s2", "", ""), ("s3", "a>b", "GGG")]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x y\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n")
    assert [tuple(r) for r in io.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("id").collect()] == [("r1", "x y", "ACGT", "@III"), ("r2", "", "GG", "II")]


def test_fastq_in_splits(spark, tmp_path):
    """Files cut into many splits, qualities that begin like headers."""
    want = []
    for f in range(3):
        records = [(f"r{f}.{i}", "x", "ACGTN"[: i % 6], ("@" if i % 2 else "+") + "I" * (i % 7)) for i in range(400)]
        (tmp_path / f"{f}.fq").write_text("".join(f"@{i} {d}\n{s}\n+\n{q}\n" for i, d, s, q in records))
        want += records
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (200, 777, 5000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(tuple(r) for r in io.read_fastq(spark, str(tmp_path)).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_packed_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACGTN"), (2, ""), (3, None), (4, "ac")], "id int, seq string")
    io.write_packed(df, str(tmp_path / "p"))
    assert [tuple(r) for r in io.read_packed(spark, str(tmp_path / "p")).orderBy("id").collect()] == [(1, "ACGTN"), (2, ""), (3, None), (4, "AC")]
    plan = io.read_packed(spark, str(tmp_path / "p"), decode=False).where("n_bases > 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_bases,3)" in plan and "packed" not in plan.split("ReadSchema")[1]


def test_log(spark, tmp_path):
    (tmp_path / "log").write_text("noise\nencode/simd_4bit/15     time:   [101.13 ns 101.53 ns 102.21 ns]\ndecode/m/8 time:\n  [1.5 µs 2 us 3 ms]\nx/y/z time: [1 s 2 s 3 s]\n")
    r = log.read_log(spark, str(tmp_path / "log"))
    assert [tuple(x) for x in log.ordered(r).collect()] == [("decode", "m", 8, 1500.0, 2000.0, 3e6), ("encode", "simd_4bit", 15, 101.13, 101.53, 102.21)]
    log.write_csv(r, str(tmp_path / "csv"))
    assert log.read_csv(spark, str(tmp_path / "csv")).count() == 2
    assert [x.operation for x in log.summary(r).collect()] == ["encode", "decode"]
    o = log.overview(r).first()
    assert (o.operations, o.min_length, o.max_length, o.n_rows) == ("decode,encode", 8, 15, 2)
    shown = spark.createDataFrame([(2.5e9,), (3e6,), (4e3,), (5.0,)], "v double").select(log.format_throughput("v").alias("s")).collect()
    assert [x.s for x in shown] == ["2.5 G", "3 M", "4 K", "5"]
    with pytest.raises(Exception, match="Unknown time unit"):
        spark.range(1).select(log.to_ns(F.lit(1.0), F.lit("h"))).collect()


@pytest.mark.parametrize("n", [0, 5000])
def test_log_csv_is_one_sorted_file_of_many_ranges(spark, tmp_path, monkeypatch, n):
    """One file, rows in order, header once, and no task that sorts more than a range."""
    monkeypatch.setattr(log, "RANGE_BYTES", 4096)
    made = spark.range(n).selectExpr(
        "element_at(array('encode', 'decode', 'x'), cast(id % 3 + 1 as int)) AS operation", "concat('m', id % 7) AS method", "cast(id % 11 as int) AS seq_length", "id / 8 AS time_low_ns", "id + 0.5D AS time_median_ns", "id * 3D AS time_high_ns"
    )
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "old.csv").write_text("old")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"csv{n}", "")
    log.write_csv(made, str(tmp_path / "csv"))
    spark.sparkContext.setJobGroup("none", "")
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(f"csv{n}") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    files = [p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv"]
    assert len(files) == 1 and not list(tmp_path.glob("csv-parts*")) and (not n or max(tasks) > 20)
    lines = files[0].read_text().splitlines()
    rows = [(o, m, int(s), *map(float, t)) for o, m, s, *t in (x.split(",") for x in lines[1:])]
    assert lines[0] == "operation,method,seq_length,time_low_ns,time_median_ns,time_high_ns"
    assert rows == sorted(tuple(r) for r in made.collect()) and log.read_csv(spark, str(tmp_path / "csv")).count() == n


def test_log_numbers_are_rounded_as_in_sql(spark):
    """Ties go to the even digit and decimals that only look like ties to the side on which the number lies, as Python and the SQL's printf have it."""
    def shown(v):
        by, digits, prefix = next(s for s in ((1e9, 1, " G"), (1e6, 0, " M"), (1e3, 0, " K"), (0, 0, "")) if v >= s[0])
        return f"{v / (by or 1):.{digits}f}{prefix}"

    random = np.random.default_rng(0)
    values = [0.5, 1.5, 2.5, 999.5, 2500.0, 3500.0, 2.5e6, 1.15e9, 1.25e9, 2.35e9, 0.0, 1e9, 999_999_999.9, *random.integers(0, 400, 300) * 0.5, *random.integers(0, 1 << 40, 300) / 64.0]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", log.format_throughput("v").alias("s")).collect()
    assert [(r.v, r.s) for r in rows] == [(v, shown(v)) for v in values]
    times = [(1.125, 1.005, 123456789012.375), (0.0, 2.675, 8.345)]
    results = spark.createDataFrame([("encode", "m", 8, *t) for t in times], log.SCHEMA)
    assert sorted(r.line for r in log.summary(results).collect()) == sorted(f"    {'m':<15}: {m:10.2f} ns [{a:10.2f} - {b:10.2f}]" for a, m, b in times)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(500).select("id", F.expr("translate(md5(cast(id as string)), '0123456789abcdef', '-ACMTWYHGRSVKDBN')").alias("seq"))
    df.write.parquet(str(tmp_path / "in"))
    out = streaming.run_once(streaming.encoded(streaming.parquet_stream(spark, str(tmp_path / "in"), str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.exceptAll(streaming.encoded(df)).count() == 0 and out.count() == 500
