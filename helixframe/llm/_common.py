"""Shared pieces: the work folder, Arrow batches of bounded size, and byte-level word scanning in NumPy."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker; a longer single text is handled alone.
CHUNK_BYTES = 2_000_000


# ---------------------------------------------------------------- folders

_OWN: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one in local mode; elsewhere executors share none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="helixframe-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = f"file://{_OWN[0]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # without a scheme it is one of the cluster's default file system
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark then removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, spark: SparkSession, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing.

    The write's shuffle files go when it ends, since nothing reads them again.
    """
    path, before = work_dir(spark, name), spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Removes what ``stored`` wrote."""
    path = getattr(df, "stored_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str):
    """(file system, path) of a URI of the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:].replace("//", "", 1) if uri.startswith("file://") else uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_file(folder: str, stem: str, suffix: str, data) -> str:
    """Writes a whole file under a name no other attempt uses; returns its URI. Only names that reach a manifest are ever read."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        for piece in data if isinstance(data, list) else [data]:
            out.write(piece)
    return uri


#: Tasks among which ``salted`` splits a key.
SALTS = 16


def salted(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join on ``keys``, which are unique in ``right``; keys with many rows in ``left`` are split among SALTS tasks by the hash of ``by``.

    Spark sizes ``right`` without its SALTS copies and may send them all through the driver; the hint "merge" rules that out.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(0)), F.lit(SALTS)))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    if hint:
        right = right.hint(hint)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def smallest(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``columns`` (which tell rows apart), the columns themselves breaking ties.

    Rows are counted first (distinct keys, about), so that only a few more than ``most`` are sent on to be ordered, however many there are.
    """
    h = F.xxhash64(*columns)
    n = rows.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    share = (1.25 * most + 100) / max(1, n)
    if share < 1:
        rows = rows.where(h <= int(share * 2**64) - 2**63)
    return rows.orderBy(h, *columns).limit(most)


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of the id written as text, modulo 5 (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


# ---------------------------------------------------------------- Arrow


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of the record batches with at most ``most`` bytes in ``column`` each, one row at least."""
    for batch in batches:
        offsets = texts(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def reachable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started; clusters get it with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}{os.pathsep}{known}" if known else root


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of up to 1000 rows (Spark keeps them to 64 MB too), so that long texts can't fill a worker. Plans read the limit when
    they run, so it stays set in the session."""
    spark = df.sparkSession
    reachable(spark)
    if not 0 < int(spark.conf.get(_ROWS)) <= 1000:
        spark.conf.set(_ROWS, "1000")
    return df.mapInArrow(function, schema)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


# ---------------------------------------------------------------- words

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_R = np.uint64(0x9E3779B97F4A7C55)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, _R_INVERSE)):
                p = np.full(max(n, CHUNK_BYTES + CHUNK_BYTES // 2), r, np.uint64)
                p[0] = 1
                _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of units[start:end] by one running sum."""
    with np.errstate(over="ignore"):
        p, q = _powers(len(units) + 1)
        total = np.zeros(len(units) + 1, np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * p[: len(units)], out=total[1:])
        return mix((total[ends] - total[starts]) * q[starts])


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, cut at row offsets."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


class Words:
    """Words of a chunk: A-Z lower-cased, maximal runs of digits, a-z and all that is not ASCII.

    starts, ends: byte places in ``data``; hashes: 64 bits each; first: n+1 offsets of the rows in the words.
    """

    def __init__(self, column: pa.Array):
        raw, self.offsets = texts(column)
        self.data = _LOWER[raw]
        self.starts, self.ends = runs(_WORD[self.data], self.offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values; first: n+1 offsets."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then the same for the next."""
    counts = np.asarray(counts, np.int64)
    out = np.ones(int(counts.sum()), np.int64)
    keep = counts > 0
    starts, counts = np.asarray(starts, np.int64)[keep], counts[keep]
    if not len(starts):
        return out
    out[0] = starts[0]
    out[np.cumsum(counts)[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)
