"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < G share one weight vector; P(grade > k) = sigmoid(w.x - threshold_k) with rising thresholds (McCullagh 1980), which gives the
expected grade and the tail probabilities. x is a text's hashed tokens, DIMENSIONS of them: words, the first three bytes of words, runs of other
characters than words and white space, and word shapes (length and capitals), as relative frequencies, and cells for its number of words, its share of such
runs, and its share of words that repeat the one before.

The model is fitted on up to SAMPLE rated documents, those with the smallest id hashes, fewer if their texts have more than MOST_CELLS different cells
together (which bounds the driver's memory), and never on held-out ones (crc32 of the id as text
divisible by 5): a bounded sample is the documented parameter. For the registered query the grade is 0 for quality 0, 1 for quality 1 that is
also labelled toxic, 2 for quality 1 that isn't; ``select`` keeps documents whose probability of a grade over 0 is at least 0.5.

Defined results: a null text counts as empty and an empty one has its length cell only. Null ids and null ratings are no training rows; an id with
several ratings counts with its lowest. Without ratings, weights and thresholds are 0. Rows are scored one by one; extra columns are ignored, or kept by ``select``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _WORD, Words, chunks, crc_mod5, discard, emit, map_arrow, reachable, runs, smallest, span_hashes, stored, table, texts

DIMENSIONS, SAMPLE, MOST_CELLS, GRADES, STEPS = 1 << 16, 20_000, 8_000_000, 2, 300
#: Bytes of text at once: each word makes three tokens, with their cells and weights.
CHUNK = 500_000
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Share of a text's weight that each kind of token has.
KINDS = {"word": 2.0, "prefix": 2.0, "mark": 2.0, "shape": 1.0}


def tokens(column: pa.Array):
    """(cells, weights, first, n): hashed tokens of all rows with their weights, row after row, n+1 offsets; number of words."""
    w = Words(column)
    raw, offsets = texts(column)
    n = len(offsets) - 1
    mark_starts, mark_ends = runs(~(_WORD[w.data] | _SPACE[w.data]), offsets)
    upper = lambda at: (raw[at] >= 65) & (raw[at] <= 90)
    last = np.maximum(w.starts, w.ends - 1)
    shape = upper(w.starts).astype(np.uint64) * np.uint64(2) + upper(last) + np.uint64(4) * np.minimum(w.ends - w.starts, 12).astype(np.uint64)
    salt = lambda h, k: ((h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(DIMENSIONS)).astype(np.int64)
    kinds = (
        ("word", w.first, salt(w.hashes, 1)),
        ("prefix", w.first, salt(span_hashes(w.data, w.starts, np.minimum(w.ends, w.starts + 3)), 2)),
        ("mark", np.searchsorted(mark_starts, offsets), salt(span_hashes(w.data, mark_starts, mark_ends), 3)),
        ("shape", w.first, salt(shape * np.uint64(0xFF51AFD7ED558CCD), 4)),
    )
    rows, cells, weights = [], [], []
    for kind, first, cell in kinds:
        many = np.diff(first)
        rows.append(np.repeat(np.arange(n), many))
        cells.append(cell)
        weights.append(np.repeat(KINDS[kind] / np.maximum(1, many), many))
    count = w.counts()
    length = np.minimum(15, np.log2(count + 1).astype(np.int64))
    marks = np.minimum(15, (np.diff(kinds[2][1]) * 8 // np.maximum(1, count)))
    again = np.append(False, w.hashes[1:] == w.hashes[:-1]).astype(np.int64)[: len(w.hashes)]
    total = np.concatenate(([0], np.cumsum(again)))
    repeats = np.minimum(15, (total[w.first[1:]] - total[w.first[:-1]]) * 16 // np.maximum(1, count))
    for k, cell in ((5, length), (6, marks), (7, repeats)):
        rows.append(np.arange(n))
        cells.append(salt(cell.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53), k))
        weights.append(np.full(n, 1.0))
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    first = np.searchsorted(rows[order], np.arange(n + 1))
    return np.concatenate(cells)[order], np.concatenate(weights)[order].astype(np.float32), first, count


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds[None, :], -40, 40)))


def _thresholds(p: np.ndarray, d: int) -> np.ndarray:
    """From parameters: d weights, the first threshold, the logarithms of the gaps between thresholds."""
    return p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))


def loss(p: np.ndarray, d: int, cells: np.ndarray, values: np.ndarray, rows: np.ndarray, grades: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades with a ridge on the weights, and its gradient."""
    n, theta = len(grades), _thresholds(p, d)
    margin = np.bincount(rows, values * p[cells], n)
    tails = 1 / (1 + np.exp(-np.clip(margin[:, None] - theta, -40, 40)))
    upper = np.concatenate((np.ones((n, 1)), tails), 1)  # P(grade >= k)
    lower = np.concatenate((tails, np.zeros((n, 1))), 1)
    at = np.arange(n)
    a, b = upper[at, grades], lower[at, grades]
    own = np.maximum(a - b, 1e-9)
    slope_a, slope_b = a * (1 - a) / own, b * (1 - b) / own  # d log p / d(margin - theta) at either end
    g_margin = -(slope_a - slope_b) / n
    g_theta = np.array([(slope_a[grades == k + 1].sum() - slope_b[grades == k].sum()) / n for k in range(len(theta))])
    g = np.concatenate((np.bincount(cells, values * g_margin[rows], d) + ridge * p[:d], [g_theta.sum()], np.exp(p[d + 1 :]) * np.cumsum(g_theta[::-1])[::-1][1:]))
    return float(-np.log(own).mean() + ridge / 2 * (p[:d] ** 2).sum()), g


def fit(cells: np.ndarray, values: np.ndarray, rows: np.ndarray, grades: np.ndarray, top: int = GRADES, steps: int = STEPS, ridge: float = 1e-5) -> Model:
    """Adam on the loss, over all rows in each step."""
    used, cells = np.unique(cells, return_inverse=True)
    d = len(used)
    share = [np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(top)]
    theta = np.array([-np.log(s / (1 - s)) for s in share])
    p = np.concatenate((np.zeros(d), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        g = loss(p, d, cells, values, rows, grades, ridge)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = p[:d]
    return Model(weights, _thresholds(p, d))


def _features(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("cells", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))])
    for part in chunks(batches, most=CHUNK):
        cells, weights, first, _ = tokens(part.column("text"))
        rows = np.repeat(np.arange(part.num_rows), np.diff(first))
        key, inverse = np.unique(rows * DIMENSIONS + cells, return_inverse=True)  # at most DIMENSIONS cells a text, however long
        values = np.bincount(inverse, weights, len(key)).astype(np.float32)
        at = np.searchsorted(key // DIMENSIONS, np.arange(part.num_rows + 1)).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x))
        yield emit(schema, doc_id=part.column("doc_id"), grade=part.column("grade"), cells=lists((key % DIMENSIONS).astype(np.int32)), weights=lists(values))


def train(docs: DataFrame, ratings: DataFrame, top: int = GRADES, sample: int = SAMPLE, most_cells: int = MOST_CELLS) -> Model:
    """The model, from rows (doc_id, grade) of documents that aren't held out."""
    rows = ratings.where("doc_id is not null and grade is not null").where(crc_mod5() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("grade").cast("int")).alias("grade"))
    chosen = smallest(rows, sample, "doc_id")  # at most ``sample`` rows of 12 bytes, so the broadcast is bounded
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(crc_mod5() != 0).join(F.broadcast(chosen), "doc_id")
    seen = map_arrow(own.select("doc_id", "grade", "text"), _features, "doc_id long, grade int, cells array<int>, weights array<float>")
    held = stored(seen, docs.sparkSession, "features")
    sizes = held.select(F.xxhash64("doc_id").alias("h"), F.size("cells").alias("n")).toPandas().sort_values(["h", "n"])  # ``sample`` small rows, and one more for each repeated id
    sizes = sizes[sizes["n"].cumsum() <= most_cells]
    last = int(sizes["h"].iloc[-1]) if len(sizes) else -(2**63)
    seen = held.where(F.xxhash64("doc_id") <= last).toArrow().combine_chunks()  # about ``most_cells`` cells
    discard(held)
    if not seen.num_rows:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(top))
    flat = lambda name: seen.column(name).combine_chunks().flatten().to_numpy()
    many = np.diff(np.concatenate(([0], np.cumsum(seen.column("cells").combine_chunks().value_lengths().to_numpy()))))
    return fit(flat("cells"), flat("weights").astype(float), np.repeat(np.arange(seen.num_rows), many), seen.column("grade").to_numpy().astype(int), top)


def _tails(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    cells, weights, first, count = tokens(column)
    total = np.concatenate(([0.0], np.cumsum(weights.astype(float) * model.weights[cells])))
    return model.tails(total[first[1:]] - total[first[:-1]]), count


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, expected_grade, tails array<double> (P(grade > k) for each k) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights

    def run(batches):
        for part in chunks(batches, most=CHUNK):
            tails, count = _tails(part.column("text"), shared.value)
            yield emit(schema, doc_id=part.column("doc_id"), n_words=count, expected_grade=tails.sum(1), tails=list(tails))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, "doc_id long, n_words long, expected_grade double, tails array<double>")


def select(docs: DataFrame, model: Model, least: float = 0.5, over: int = 0) -> DataFrame:
    """The documents whose probability of a grade above ``over`` is at least ``least``, all columns with them; no shuffle."""
    reachable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(column: pa.Array) -> pa.Array:
        parts = [_tails(part.column(0), shared.value)[0][:, over] >= least for part in chunks([pa.RecordBatch.from_arrays([column], ["text"])], most=CHUNK)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool), pa.bool_())

    return docs.where(good(F.col("text").cast("string")))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for quality 0, 1 for quality 1 with toxic 1, 2 for other quality 1, null for a null quality."""
    return labels.select("doc_id", F.when(F.col("quality").isNull(), F.lit(None)).when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).cast("int").alias("grade"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, grades(table(spark, sf_dir, "labels"))))
    tail = lambda k: F.element_at("tails", k)
    return out.select("doc_id", F.coalesce(crc_mod5() == 0, F.lit(False)).alias("held_out"), "n_words", "expected_grade", tail(1).alias("p_over_0"), tail(2).alias("p_over_1"), (tail(1) >= 0.5).alias("keep"))
