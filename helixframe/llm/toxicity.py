"""Toxic passages by maximum-scoring segments.

Each word scores its log-odds of standing in a toxic document, less DRIFT, so that ordinary text scores below zero. Dirichlet priors of PRIOR
pseudo-occurrences smooth them in levels: the classes' sizes are the prior of a word's first four bytes, these of its first six bytes, and these
of the whole word, so that a rare word scores like the words that begin like it. One linear scan (Ruzzo and Tompa 1999) finds every maximal-scoring segment of a
text. A segment's score S in n words has the E-value K n exp(-lambda S) (Karlin and Altschul 1990): lambda solves sum p exp(lambda s) = 1 over
the clean words, and K is the maximum-likelihood value for the best segments of the clean training texts. Segments with an E-value of at most
SIGNIFICANT are toxic passages. A document's evidence, (lambda S - ln K n) of its best segment and the sum over all segments where it is positive, becomes a
probability by logistic regression on the training texts.

Words are hashed to CELLS cells, so that the model's size is fixed. It is fitted on up to SAMPLE labelled documents, those with the smallest id
hashes, and never on held-out ones (crc32 of the id as text divisible by 5); a bounded sample is the documented parameter. Only the text is an input.

Defined results: a null text counts as empty; an empty text has no passages and the score of no evidence. Null ids are never training rows
and not held out. An id with several labels counts as toxic if one of them is 1. With no labels, or none of one class, every score is the share
of toxic rows (0 without rows). Rows are scored one by one: repeated rows get equal scores; extra columns are ignored, or kept by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, chunks, crc_mod5, discard, emit, map_arrow, reachable, smallest, span_hashes, stored, table

#: Bytes of text at once: each word has a cell for each level.
CHUNK = 500_000
CELLS, SAMPLE, PRIOR, DRIFT, SIGNIFICANT, LEVELS = 1 << 18, 50_000, 10.0, 0.7, 0.05, (4, 6, 0)


def segments(low: list[float], high: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments, as (first, last) of the runs of positive scores with running sums ``low`` before and ``high`` after.

    Each candidate links to the last one before it that starts lower, so that the search for such a one takes constant time on average.
    """
    first: list[int] = []
    last: list[int] = []
    lows: list[float] = []
    highs: list[float] = []
    link: list[int] = []
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        start, top = k, len(first) - 1
        while True:
            j = top
            while j >= 0 and lows[j] >= a:
                j = link[j]
            if j < 0 or highs[j] >= b:
                break
            start, a, top = first[j], lows[j], j - 1
            for x in (first, last, lows, highs, link):
                del x[j:]
        first.append(start), last.append(k), lows.append(a), highs.append(b), link.append(j)
    return list(zip(first, last, strict=True))


def cells(w: Words) -> np.ndarray:
    """Of each word and level the cell: of its first bytes, at last of all."""
    out = np.empty((len(LEVELS), len(w.hashes)), np.int64)
    for k, most in enumerate(LEVELS):
        h = span_hashes(w.data, w.starts, np.minimum(w.ends, w.starts + most)) if most else w.hashes
        out[k] = (h & np.uint64(CELLS - 1)).astype(np.int64)
    return out


@dataclass
class Model:
    toxic: np.ndarray  # occurrences of each level's cells in toxic texts
    both: np.ndarray  # and in all
    share: float = 0.5  # of toxic texts' words
    rate: float = 1.0  # lambda
    k: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)  # 1, evidence of the best segment, of all passages
    fitted: bool = False

    def scores(self, at: np.ndarray, toxic: np.ndarray | int = 0, both: np.ndarray | int = 0) -> np.ndarray:
        """Log-odds less DRIFT of words in the cells ``at``; toxic, both: occurrences to leave out at each level."""
        if not self.fitted:
            return np.full(at.shape[1], -DRIFT)
        q = self.share
        for k in range(len(LEVELS)):
            t, n = self.toxic[k][at[k]], self.both[k][at[k]]
            if not np.isscalar(both):
                t, n = t - toxic[k], n - both[k]
            q = (t + PRIOR * q) / (n + PRIOR)
        return np.log(q / (1 - q)) - np.log(self.share / (1 - self.share)) - DRIFT

    def evidence(self, score: np.ndarray, words: np.ndarray) -> np.ndarray:
        """-ln of the E-value."""
        return self.rate * score - np.log(self.k * np.maximum(words, 1))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -40, 40)))


def scan(w: Words, s: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """Of each row the maximal-scoring segments (first word, word after the last, score) under the words' scores ``s``."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(w.offsets) - 1)]
    up = np.flatnonzero(s > 0)
    for i in np.unique(np.searchsorted(w.first, up, "right") - 1):
        own = s[w.first[i] : w.first[i + 1]]
        total = np.concatenate(([0.0], np.cumsum(own, dtype=np.float64)))
        edge = np.diff(np.concatenate(([0], own > 0, [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out[i] = [(int(a[x]), int(b[y]), float(total[b[y]] - total[a[x]])) for x, y in segments(total[a].tolist(), total[b].tolist())]
    return out


def evidence(found: list, n_words: np.ndarray, model: Model) -> tuple[np.ndarray, list]:
    """Inputs of the logistic regression, and of each row the significant passages (first, end, score, E-value)."""
    x, passages = np.zeros((len(found), 3)), []
    x[:, 0] = 1
    for i, rows in enumerate(found):
        e = [float(model.evidence(s, n_words[i])) for _, _, s in rows]
        passages.append([(a, b, s, float(np.exp(-v))) for (a, b, s), v in zip(rows, e, strict=True) if v >= -np.log(SIGNIFICANT)])
        x[i, 1] = np.clip(max(e, default=-10.0), -10, 30)
        x[i, 2] = np.log1p(sum(max(0.0, v) for v in e))
    return x, passages


# ---------------------------------------------------------------- training


def _counts(batches):
    n = np.zeros((2, len(LEVELS), CELLS), np.int64)
    for part in chunks(batches, most=CHUNK):
        w = Words(part.column("text"))
        toxic, at = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False), w.counts()), cells(w)
        for c in (0, 1):
            for k in range(len(LEVELS)):
                n[c, k] += np.bincount(at[k, toxic == c], minlength=CELLS)
    n = n.reshape(2, -1)
    at = np.flatnonzero(n.any(0))
    schema = pa.schema([("cell", pa.int64()), ("clean", pa.int64()), ("toxic", pa.int64())])
    for i in range(0, len(at), 20_000):
        yield emit(schema, cell=at[i : i + 20_000], clean=n[0, at[i : i + 20_000]], toxic=n[1, at[i : i + 20_000]])


def own_occurrences(w: Words, at: np.ndarray) -> np.ndarray:
    """Of each word and level how often its cell stands in its own text."""
    rows, out = w.rows(), np.empty_like(at)
    for k in range(len(at)):
        _, inverse, n = np.unique(rows * CELLS + at[k], return_inverse=True, return_counts=True)
        out[k] = n[inverse]
    return out


def solve_rate(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root lambda of sum p exp(lambda s) = 1, for scores with a negative mean and some positive."""
    low, high = 1e-4, 1e-3
    value = lambda x: float((p * np.exp(np.minimum(x * s, 600))).sum())
    while value(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model, from the text of labelled documents that aren't held out."""
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic is not null").where(crc_mod5() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = smallest(rows, sample, "doc_id")  # at most ``sample`` rows of 12 bytes, so the broadcast is bounded
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(crc_mod5() != 0).join(F.broadcast(chosen), "doc_id")
    counted = map_arrow(own.select("text", "toxic"), _counts, "cell long, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = {k: x.to_numpy() for k, x in zip(counted.columns, counted.toArrow(), strict=True)}  # at most CELLS rows for each level
    n = np.zeros((2, len(LEVELS) * CELLS))
    n[0, got["cell"]], n[1, got["cell"]] = got["clean"], got["toxic"]
    n = n.reshape(2, len(LEVELS), CELLS)
    total = n[:, -1].sum(1)
    model = Model(n[1].astype(np.float32), n.sum(0).astype(np.float32))
    if not total.all():
        share = chosen.agg(F.avg("toxic")).first()[0] or 0.0
        model.weights = (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0, 0.0)
        return model
    model.share, model.fitted = float(total[1] / total.sum()), True
    shared = spark.sparkContext.broadcast(model)

    def best(batches):
        for part in chunks(batches, most=CHUNK):
            w = Words(part.column("text"))
            at = cells(w)
            own = own_occurrences(w, at)  # a text's own words don't count for it
            s = shared.value.scores(at, own * np.repeat(part.column("toxic").to_numpy(zero_copy_only=False), w.counts()), own)
            found = [[x for _, _, x in row] for row in scan(w, s)]
            clean = [np.bincount(np.clip(np.rint(s[a:b] * 10).astype(int) + 200, 0, 400), minlength=401) * (not t) for a, b, t in zip(w.first, w.first[1:], part.column("toxic").to_pylist(), strict=False)]
            yield emit(schema, toxic=part.column("toxic"), n_words=w.counts(), doc=part.column("doc_id"), found=found, spread=[x.tolist() for x in clean])

    schema = pa.schema([("toxic", pa.int32()), ("n_words", pa.int64()), ("doc", pa.int64()), ("found", pa.list_(pa.float64())), ("spread", pa.list_(pa.int64()))])
    seen = map_arrow(own.select("doc_id", "text", "toxic"), best, "toxic int, n_words long, doc long, found array<double>, spread array<long>")
    seen = seen.groupBy("doc").agg(F.max(F.struct("toxic", "n_words", "found", "spread")).alias("r")).select("r.*")
    seen = held = stored(seen, spark, "evidence")
    spread = seen.select(F.posexplode("spread").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 401 rows
    p = np.zeros(401)
    p[spread["at"].to_numpy()] = spread["n"].to_numpy()
    model.rate = solve_rate(p / max(1, p.sum()), (np.arange(401) - 200) / 10)
    clean = seen.where("toxic = 0 and n_words > 0").select("n_words", F.coalesce(F.array_max("found"), F.lit(0.0)).alias("top")).toArrow()  # at most ``sample`` rows
    model.k = float(1 / max(1e-12, (clean["n_words"].to_numpy() * np.exp(-model.rate * clean["top"].to_numpy())).mean())) if len(clean) else 1.0
    calibrated = Model(np.zeros(0), np.zeros(0), rate=model.rate, k=model.k)

    def inputs(batches):
        for batch in batches:
            x, _ = evidence([[(0, 0, s) for s in row] for row in batch.column("found").to_pylist()], batch.column("n_words").to_numpy(), calibrated)
            yield emit(input_schema, toxic=batch.column("toxic"), best=x[:, 1], all=x[:, 2])

    input_schema = pa.schema([("toxic", pa.int32()), ("best", pa.float64()), ("all", pa.float64())])
    rows = map_arrow(seen.select("toxic", "n_words", "found"), inputs, "toxic int, best double, all double").toArrow()  # at most ``sample`` rows
    model.weights = tuple(logistic(np.column_stack((np.ones(len(rows)), rows["best"], rows["all"])), rows["toxic"].to_numpy().astype(float)))
    discard(held)
    return model


# ---------------------------------------------------------------- scoring


def _score(column: pa.Array, model: Model):
    w = Words(column)
    x, passages = evidence(scan(w, model.scores(cells(w))), w.counts(), model)
    return w, model.probability(x), passages


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, passages array<struct<first_word, end_word, start_byte, end_byte, score, e_value>> of each row."""
    item = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.list_(item))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS scores

    def run(batches):
        for part in chunks(batches, most=CHUNK):
            w, p, passages = _score(part.column("text"), shared.value)
            spans = [
                [{"first_word": a, "end_word": b, "start_byte": int(w.starts[w.first[i] + a] - w.offsets[i]), "end_byte": int(w.ends[w.first[i] + b - 1] - w.offsets[i]), "score": s, "e_value": e} for a, b, s, e in row]
                for i, row in enumerate(passages)
            ]
            yield emit(schema, doc_id=part.column("doc_id"), score=p, predicted=(p >= 0.5).astype(np.int32), passages=spans)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, "doc_id long, score double, predicted int, passages array<struct<first_word:long,end_word:long,start_byte:long,end_byte:long,score:double,e_value:double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score under 0.5, all columns with them; no shuffle."""
    reachable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [_score(part.column(0), shared.value)[1] < 0.5 for part in chunks([batch], most=CHUNK)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool), pa.bool_())

    return docs.where(clean(F.col("text").cast("string")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    best = F.array_min(F.transform("passages", lambda x: x["e_value"]))
    return out.select("doc_id", F.coalesce(crc_mod5() == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"), best.alias("least_e_value"))
