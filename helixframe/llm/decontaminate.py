"""Benchmark decontamination with one FM-index per training shard.

Words are maximal runs of digits, a-z and non-ASCII after lower-casing A-Z. A phrase to look for is a window of WINDOW consecutive words of a benchmark
item, or the whole of a shorter item. Documents go, some at a time, into shards of up to SHARD_BYTES of text. A shard's text is its documents'
words as symbols of the phrases' vocabulary; words outside it, and ends of documents, are separators (neighbouring ones are one), which no
phrase contains. From the shard's suffix array come its Burrows-Wheeler transform in a wavelet matrix and the positions of some suffixes (SAMPLE_RATE).
All phrases are searched backwards at once, occurrences are located by walking to the next sampled suffix, and their spans are merged.

Words are compared by 64-bit hashes: two different words that count as one would need a collision among those of the vocabulary.

Phrases are compiled on the driver and sent to all workers. That is bounded: items are taken in rounds of up to ROUND_WORDS words. With more
than one round the documents are written after each with the spans found so far, so that only one round's phrases are held at a time. Nothing is shuffled.

``find`` reports, ``keep_clean`` drops every document with an occurrence, ``remove`` cuts the merged spans out of the texts and keeps all documents.

Defined results: null texts have no words; documents or items without words match nothing; equal phrases of several items count for each of
them; a repeated item id counts once in n_items. Rows are handled one by one, so repeated rows, equal ids and null ids give rows of their
own. Extra columns are ignored by ``find`` and kept by ``keep_clean`` and ``remove``, whatever their names. ``remove`` puts one space where it cuts, and leaves
a null text null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, chunks, discard, ragged, reachable, runs, stored, table

WINDOW, SHARD_BYTES, SAMPLE_RATE, ROUND_WORDS = 13, 2_000_000, 16, 1_000_000


@dataclass
class Phrases:
    words: np.ndarray  # sorted hashes of the vocabulary; symbols are places in it, from 1
    phrases: list[np.ndarray]  # one table of symbols for each length
    items: list[list[list]]  # and the items of each phrase


def compile_phrases(items: list[tuple], window: int = WINDOW) -> Phrases:
    """From (item id, text) pairs. Equal phrases are found by sorting all windows of one length together."""
    w = Words(pa.array([t for _, t in items], pa.string()))
    words = np.unique(w.hashes)
    symbols = (np.searchsorted(words, w.hashes) + 1).astype(np.int32)
    names = [str(i) for i, _ in items]
    length = np.minimum(w.counts(), window)
    phrases, owners = [], []
    for n in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == n)
        many = w.counts()[own] - n + 1
        at = ragged(w.first[own], many)
        found, which = np.unique(np.lib.stride_tricks.sliding_window_view(symbols, n)[at], axis=0, return_inverse=True)
        pairs = np.unique(np.stack((which.ravel(), np.repeat(own, many))), axis=1)
        bounds = np.searchsorted(pairs[0], np.arange(len(found) + 1))
        phrases.append(found)
        owners.append([sorted({names[i] for i in pairs[1, a:b].tolist()}) for a, b in zip(bounds, bounds[1:], strict=False)])
    return Phrases(words, phrases, owners)


# ---------------------------------------------------------------- FM-index


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text in order. Symbols are above 0; each 0 is a separator of its own, smaller than all symbols, in order of place; the last symbol is one.

    Prefix doubling that sorts only what isn't settled (Larsson and Sadakane 2007); a run between separators settles after log2 of its length rounds.
    """
    n = len(text)
    separator = text == 0
    first = np.where(separator, np.cumsum(separator) - 1, text.astype(np.int64) + int(separator.sum()))
    order = np.argsort(first, kind="stable")
    key = first[order]
    new = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    last = np.append(new[1:], True)
    open_ = np.flatnonzero(~(new & last))
    h = 1
    while len(open_):
        own = order[open_]
        key = rank[own] << 32 | rank[own + h]
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[open_] = own
        new = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new, open_, 0))
        rank[own] = start
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class Bits:
    """A bit vector with ranks, 64 bits a block."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before ``at``."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class Wavelet:
    """A wavelet matrix: ranks of any symbol in as many steps as symbols have bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for k in range(bits - 1, -1, -1):
            bit = (symbols >> k & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before its ``at``."""
        low = np.zeros_like(at)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - k) & 1).astype(bool)
            a, b = level.rank(low), level.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at ``at``, how often it stands before)."""
        symbol, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = (level.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = level.rank(low), level.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
            symbol = symbol << 1 | one
        return symbol, at - low


class Index:
    """An FM-index of a text of symbols 1..top with separators 0."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_array(text)
        self.wavelet = Wavelet(text[order - 1], max(1, int(top).bit_length()))
        self.low = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))  # where the suffixes of each symbol begin
        # Sampled: every SAMPLE_RATE-th place, and each that follows a separator, so that walks never cross one.
        sampled = (order % SAMPLE_RATE == 0) | (text[order - 1] == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (a row of symbols), by backward search of all at once."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        alive = np.arange(len(phrases))
        a, b = self.low[phrases[:, -1]], self.low[phrases[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -2, -1):
            some = a < b
            alive, a, b = alive[some], a[some], b[some]
            if k < 0 or not len(alive):
                break
            c = phrases[alive, k].astype(np.int64)
            a, b = self.low[c] + self.wavelet.rank(c, a), self.low[c] + self.wavelet.rank(c, b)
        low[alive], high[alive] = a, b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the suffixes in these rows."""
        out, steps, which = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(rows):
            rank = self.sampled.rank(rows)
            here = self.sampled.rank(rows + 1) > rank
            out[which[here]] = self.places[rank[here]] + steps
            rows, which = rows[~here], which[~here]
            symbol, before = self.wavelet.read(rows)
            rows, steps = self.low[symbol] + before, steps + 1
        return out


# ---------------------------------------------------------------- search


def shard_text(w: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word): a shard's words as symbols, with separators, and the number of the word at each place (-1 at separators)."""
    at = np.searchsorted(phrases.words, w.hashes)
    at = np.minimum(at, len(phrases.words) - 1)
    known = phrases.words[at] == w.hashes
    starts, ends = runs(known, w.first)
    # Each run of known words is followed by one separator.
    word = np.full(int(known.sum()) + len(starts) + 1, -1, np.int64)
    place = np.cumsum(known) - 1
    shift = np.searchsorted(starts, np.flatnonzero(known), "right")  # separators before, the text's first one included
    word[place[known] + shift] = np.flatnonzero(known)
    text = np.where(word >= 0, at[word] + 1 if len(at) else 0, 0).astype(np.int32)
    return text, word


def search(w: Words, phrases: Phrases) -> tuple[np.ndarray, list[set]]:
    """(hit, items): whether each word of a shard stands in an occurrence of a phrase; the items of each row's occurrences."""
    hit, items = np.zeros(len(w.hashes) + 1, np.int64), [set() for _ in range(len(w.offsets) - 1)]
    if not len(w.hashes) or not len(phrases.words):
        return hit[:-1] > 0, items
    text, word = shard_text(w, phrases)
    index = Index(text, len(phrases.words))
    for table_, names in zip(phrases.phrases, phrases.items, strict=True):
        low, high = index.count(table_)
        which = np.flatnonzero(low < high)
        if not len(which):
            continue
        n = high[which] - low[which]
        phrase = np.repeat(which, n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[which], n)
        first = word[index.locate(rows)]
        np.add.at(hit, first, 1)
        np.add.at(hit, first + table_.shape[1], -1)
        row = np.searchsorted(w.first, first, "right") - 1
        pairs = np.unique(np.stack((row, phrase)), axis=1)
        for r, p in pairs.T.tolist():
            items[r].update(names[p])
    return np.cumsum(hit[:-1]) > 0, items


def rounds(items: DataFrame, most: int = ROUND_WORDS, window: int = WINDOW):
    """The compiled phrases of the items, up to ``most`` words at a time."""
    words = F.coalesce(F.length("text"), F.lit(0))  # as many words as characters at most
    held, size = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text"), words.alias("n")).where("n > 0").toLocalIterator(True):
        if held and size + row.n // 2 > most:
            yield compile_phrases(held, window)
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += row.n // 2 + 1
    yield compile_phrases(held, window)


_FOUND = "struct<n_words:long,spans:array<struct<first:long,end:long,start_byte:long,end_byte:long>>,items:array<string>>"


def finder(spark, phrases: Phrases, shard_bytes: int):
    """(function of a text column that gives _FOUND, the broadcast it needs)."""
    shared = spark.sparkContext.broadcast(phrases)
    reachable(spark)
    span = pa.struct([(x, pa.int64()) for x in ("first", "end", "start_byte", "end_byte")])

    @F.arrow_udf(_FOUND)
    def found(column: pa.Array) -> pa.Array:
        parts = []
        for part in chunks([pa.RecordBatch.from_arrays([column], ["text"])], "text", shard_bytes):
            w = Words(part.column(0))
            hit, items = search(w, shared.value)
            starts, ends = runs(hit, w.first)
            at = np.searchsorted(starts, w.first).astype(np.int32)
            row = np.repeat(np.arange(part.num_rows), np.diff(at))
            cut = (starts - w.first[row], ends - w.first[row], w.starts[starts] - w.offsets[row], w.ends[ends - 1] - w.offsets[row])
            spans = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in cut], fields=list(span)))
            parts.append(pa.StructArray.from_arrays([pa.array(w.counts(), pa.int64()), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["n_words", "spans", "items"]))
        return pa.chunked_array(parts).combine_chunks() if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]))

    return found, shared


def annotated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, round_words: int = ROUND_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, found): each row as a struct, and the spans and items found in its text. Spans of several rounds are merged, items joined."""
    spark = docs.sparkSession
    text = F.col("doc.text").cast("string")
    rows, last = docs.select(F.struct("*").alias("doc")), None
    for phrases in rounds(items, round_words, window):
        if last:  # there is another round: write what the last one found
            before, rows = rows, stored(rows, spark, "round")
            discard(before)
            last.unpersist()
        found, last = finder(spark, phrases, shard_bytes)
        if "found" not in rows.columns:
            rows = rows.select("doc", found(text).alias("found"))
        else:
            rows = _remember(rows.select("doc", "found", found(text).alias("new")).select("doc", _joined().alias("found")), rows)
    return rows


def _remember(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` with the folder that it is read from, so that it can be removed later."""
    df.stored_path = source.stored_path
    return df


def _joined():
    """Of the structs found and new one."""
    kind = "array<struct<first:long,end:long,start_byte:long,end_byte:long>>"

    def extend(spans, x):
        last = F.get(spans, F.size(spans) - 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"), last["start_byte"].alias("start_byte"), F.greatest(last["end_byte"], x["end_byte"]).alias("end_byte"))
        merged = F.concat(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), F.array(longer).cast(kind))
        return F.when((F.size(spans) > 0) & (x["first"] <= last["end"]), merged).otherwise(F.concat(spans, F.array(x).cast(kind)))

    spans = F.aggregate(F.array_sort(F.concat("found.spans", "new.spans")), F.array().cast(kind), extend)
    return F.struct(F.col("found.n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_union("found.items", "new.items")).alias("items"))


def find(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, spans array<struct<first, end, start_byte, end_byte>> (words and bytes, merged), items array<string> (sorted) of each row."""
    return annotated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, **parameters).select("doc.doc_id", "found.*")


def contaminated(n_hit, n_words):
    """At least a twentieth of the words stand in occurrences."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])


def keep_clean(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The documents in which no phrase occurs, all columns with them; no shuffle."""
    return annotated(docs, items, **parameters).where(F.size("found.spans") == 0).select("doc.*")


def remove(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """All documents, all columns with them, the merged spans cut out of the texts."""
    reachable(docs.sparkSession)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, spans, strict=True):
            own = own.as_py()
            if own:
                data, at, kept = text.as_py().encode(), 0, []
                for x in own:
                    kept.append(data[at : x["start_byte"]])
                    at = x["end_byte"]
                out.append(b" ".join([*kept, data[at:]]).decode())
            else:
                out.append(text.as_py())
        return pa.array(out, pa.string())

    rows = annotated(docs, items, **parameters)
    text = F.when(F.size("found.spans") == 0, F.col("doc.text").cast("string")).otherwise(cut(F.col("doc.text").cast("string"), F.col("found.spans")))
    columns = [text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return rows.select(*columns)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit())
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
