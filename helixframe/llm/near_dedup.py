"""Near-duplicate documents by Order MinHash.

A text is its sequence of words (runs of digits, a-z and non-ASCII after lower-casing A-Z). Texts with the same
sequence form one copy class; only its smallest doc_id goes on. Two classes are linked if the edit distance of their words, by banded
alignment of the whole texts, is at most (1 - similarity) times the longer one's length. Groups are the connected components of the links.

Candidates come from SKETCHES sketches of each class: under one hash function each, the ``PICKS`` smallest occurrence-labelled shingles of ``SHINGLE`` words (the
k-th occurrence of a shingle is an element of its own), kept in the order in which they stand in the text. Two texts with the share J of
common labelled shingles agree in a sketch with a probability of about J**PICKS. One word in five replaced at random leaves J = 0.2, at which 80 sketches of two
picks meet in 96 % of cases in long texts and in 90 % in texts of 60 words; each smaller difference is met more surely (tests measure it by edit distance). In
texts of up to SHORT words few edits can touch every shingle, so these are searched exactly, as follows.

Exact search: texts similar enough have ceil(similarity * n) words in common, repeats counted, so that they share one of the rarest words of each that make up
n - ceil(similarity * n) + 1 of its words (prefix filtering; Chaudhuri et al. 2006). Rarity is a count of texts in hashed cells, and any order gives the same links. Texts that share such a
word are candidates; a word of more than COLD texts has them compared in blocks, of which only pairs within the bounds come out. Words are counted one by one only
if the texts of their cell are more than COLD.

No group is paired out. (1) All members of a bucket are aligned with its smallest one, and those that match hang together, so that n near copies
take about n alignments. (2) In buckets that are still in several components, up to COLD members are paired across components. Documents of larger ones go
through the exact search, together with the short texts, again across components only: a passage that many unlike documents share makes a large
bucket, but their rarest words tell them apart. So no pair that shares a sketch is lost, whatever the bucket's size. Before texts are fetched, pairs must pass
two exact bounds: lengths, and bitmaps of words (``marked``): each bit that only one of two texts has set stands for a word that costs an edit.

Joins by bucket, copy key, word or hub are salted, so that a hot one is split among tasks; leaders with many members and words with many texts are split likewise.

Defined results: a null text counts as empty. Texts without words are copies of one another only if they are equal and
not empty; empty ones stay alone. A text of fewer than five words is one shingle. Rows with a null id are left out of
``groups`` and kept by ``deduplicate``. An id with several rows is one document, with the text that has the smallest hash among them; ``deduplicate`` keeps one of its
rows with that text at most. Extra columns are ignored by ``groups`` and carried by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, chunks, discard, emit, map_arrow, mix, salted, stored, table

SHINGLE, PICKS, SKETCHES, SIMILARITY, SHORT = 5, 2, 80, 0.8, 60
#: Members of a bucket that are paired directly, pairs of one leader aligned in one go, texts of one word in a block.
COLD, LED, SPLIT = 64, 256, 512
#: Bits of a text's bitmaps: for the first MARKED occurrences of each word, and for the others. Cells of the words' counts.
MARKS, MORE_MARKS, MARKED, FOLD, CELLS = 4096, 2048, 8, 16, 1 << 19


# ---------------------------------------------------------------- sketches


def multipliers(n: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def occurrences(key: np.ndarray) -> np.ndarray:
    """How often each item's value stands before it."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.uint64)
    out[order] = (np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))).astype(np.uint64)
    return out


def labelled_shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all occurrence-labelled shingles, row after row, and their n+1 offsets. A short row is one shingle."""
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(n)), many)
    place = np.arange(offsets[-1]) - offsets[:-1][row] + first[:-1][row]
    last = first[1:][row]
    h = np.zeros(len(place), np.uint64)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(place + j < last, padded[place + j], np.uint64(j + 1))
        h = mix(h)
        label = occurrences(mix(h + row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        h = np.where(label > 0, mix(h + label * np.uint64(0x8EBC6AF09C88C6E3)), h)
    return h, offsets


def labelled_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, label) of each word with its label: how often it stands before in its row."""
    with np.errstate(over="ignore"):
        label = occurrences(mix(w.hashes + w.rows().astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        return mix(w.hashes + label * np.uint64(0x8EBC6AF09C88C6E3)), label


def order_minhash(h: np.ndarray, a: np.ndarray, picks: int) -> np.ndarray:
    """One sketch per multiplier for one text's labelled shingles: a hash of its smallest ones in text order."""
    n = len(h)
    out = np.zeros(len(a), np.uint64)
    step = max(1, 100_000 // n)
    with np.errstate(over="ignore"):
        for i in range(0, len(a), step):
            v = h * a[i : i + step, None]
            rows = np.arange(len(v))
            at = np.empty((min(picks, n), len(v)), np.int64)
            for j in range(len(at)):
                at[j] = v.argmin(1)
                v[rows, at[j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            at.sort(0)
            t = np.zeros(len(v), np.uint64)
            for own in at:
                t = t * np.uint64(0xD6E8FEB86659FD93) + h[own]
            out[i : i + step] = mix(t ^ a[i : i + step])
    return out


def drawn(batches, shingle: int, picks: int, n: int):
    """Per row: the id, a 128-bit key of its words (of its bytes if it has none; of its id if it is empty), its number of words, its sketches."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy_key", pa.binary()), ("n_words", pa.int64()), ("sketches", pa.list_(pa.int64()))])
    a = multipliers(n)
    for part in chunks(batches):
        w = Words(part.column("text"))
        h, at = labelled_shingles(w.hashes, w.first, shingle)
        keys, got = [], []
        for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
            own = w.hashes[w.first[i] : w.first[i + 1]].tobytes()
            raw = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
            keys.append(hashlib.blake2b(own, digest_size=16).digest() if own else hashlib.blake2b(raw, digest_size=16, key=b"raw").digest() if raw else str(doc_id).encode())
            got.append((order_minhash(h[at[i] : at[i + 1]], a, picks) if own else np.zeros(0, np.uint64)).view(np.int64))
        yield emit(schema, doc_id=part.column("doc_id"), copy_key=keys, n_words=w.counts(), sketches=got)


# ---------------------------------------------------------------- bounds and rare words


def marked(w: Words) -> np.ndarray:
    """Bitmaps of each row's labelled words, as 64-bit integers. Each occurrence of a word sets a bit, by hash: the first MARKED in one bitmap, the others in a second.

    A bit that x has set and y hasn't stands for an occurrence at least that x has more than y, so the edit distance is no less than the number of such bits.
    """
    h, label = labelled_words(w)
    cell = np.where(label < MARKED, h & np.uint64(MARKS - 1), np.uint64(MARKS) + (h & np.uint64(MORE_MARKS - 1)))
    bits = np.zeros((len(w.offsets) - 1, (MARKS + MORE_MARKS) // 64), np.uint64)
    np.bitwise_or.at(bits, (w.rows(), (cell >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (cell & np.uint64(63)))
    return bits.view(np.int64)


def different_words(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, occurrences) of each different word of each row, row after row."""
    order = np.lexsort((w.hashes, w.rows()))
    h, row = w.hashes[order], w.rows()[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)])
    return row[new], h[new], np.diff(np.append(new, len(h)))


def _word_counts(batches):
    total = np.zeros(CELLS, np.int64)
    for part in chunks(batches):
        total += np.bincount((different_words(Words(part.column("text")))[1] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(total)
    yield emit(pa.schema([("cell", pa.int64()), ("n", pa.int64())]), cell=at, n=total[at])


def prefixes(w: Words, counts: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Of each row the rarest different words that any similar row shares one of: with their repeats they are just too many to be all missing."""
    row, h, many = different_words(w)
    order = np.lexsort((h, counts[(h & np.uint64(CELLS - 1)).astype(np.int64)], row))
    h, total = h[order], np.concatenate(([0], np.cumsum(many[order])))
    first = np.searchsorted(row, np.arange(len(w.first)))
    needed = ((1 - similarity) * w.counts() + 1e-9).astype(np.int64) + 1
    last = np.minimum(np.searchsorted(total, total[first[:-1]] + needed), first[1:])
    return [h[a:b].view(np.int64) for a, b in zip(first[:-1], last, strict=True)]


def described(batches, counts: np.ndarray, similarity: float):
    """Per row: the id, n, r, its bitmaps, its first bitmap folded to FOLD integers (the same bound, less sharp), and its rarest words (null where ``wide`` is false),
    without those whose cell no other text has, with the most texts that can hold each: those of its cell."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("r", pa.int64()), ("marks", pa.list_(pa.int64())), ("fold", pa.list_(pa.int64())), ("rare", pa.list_(pa.int64())), ("most", pa.list_(pa.int64()))])
    for part in chunks(batches):
        w = Words(part.column("text"))
        marks = marked(w)
        fold = np.bitwise_or.reduce(marks[:, : MARKS // 64].reshape(part.num_rows, -1, FOLD), axis=1)
        rare, most = [], []
        for x, wide in zip(prefixes(w, counts, similarity), part.column("wide").to_pylist(), strict=True):
            many = counts[x & (CELLS - 1)]
            rare.append(x[many > 1] if wide else None)
            most.append(many[many > 1] if wide else None)
        yield emit(schema, id=part.column("id"), n=part.column("n"), r=part.column("r"), marks=list(marks), fold=list(fold), rare=rare, most=most)


def _bounded(batches, similarity: float):
    """From rows (word, i, j, block, id, n, r, marks), sorted by (word, i, j): pairs (a, b, na, nb) of blocks i and j of a word that aren't connected and are within both bounds."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])
    held: list[pa.RecordBatch] = []

    def compared():
        rows = pa.Table.from_batches(held).combine_chunks()
        n, ids, root, block = (rows.column(c).to_numpy() for c in ("n", "id", "r", "block"))
        marks = rows.column("marks").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
        crossed = rows.column("i")[0] != rows.column("j")[0]
        order = np.argsort(n, kind="stable")
        n, ids, root, block, marks = n[order], ids[order], root[order], block[order], marks[order]
        found = []
        for k in range(len(n)):
            other = np.arange(k + 1, np.searchsorted(n, n[k] / similarity + 1e-9, "right"))
            other = other[(root[other] != root[k]) & ((block[other] != block[k]) | (not crossed))]
            most = (1 - similarity) * n[other] + 1e-9
            more = np.bitwise_count(marks[k] & ~marks[other]).sum(1, dtype=np.int64), np.bitwise_count(marks[other] & ~marks[k]).sum(1, dtype=np.int64)
            other = other[np.maximum(*more) <= most]
            found.append(np.stack((np.full(len(other), k), other)))
        x, y = np.concatenate(found, 1)
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return emit(schema, a=ids[x], b=ids[y], na=n[x], nb=n[y])

    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("word", "i", "j")), strict=True))
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if keys[at] != now and held:
                yield compared()
                held.clear()
            now = keys[at]
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield compared()


# ---------------------------------------------------------------- alignment


def banded_cost(x: list, y: list, band: int) -> int:
    """Least cost of an alignment of two sequences that stays within ``band`` diagonals of the main one (which their lengths must allow).

    It is the edit distance if it is at most ``band``, and never less. Only the band is computed, a whole column of it at a time: the vertical differences
    of neighbouring cells are two bit masks in Python integers, which move down one cell with each item of ``y``
    (after Hyyrö's bit-parallel form of the recurrence).
    """
    if len(x) > len(y):
        x, y = y, x
    m, n = len(x), len(y)
    if not m:
        return n
    band = min(band, n)
    width = 2 * band + 1
    full = (1 << width) - 1
    places: dict = {}
    for i, v in enumerate(x):
        places[v] = places.get(v, 0) | 1 << (i + band)
    # Bit b of column j is the cell of row j - band + b; the cells of the rows up to 0, above the table, don't differ.
    plus, minus = full ^ ((1 << band) - 1), 0
    cost = band  # of the band's lowest cell, in row j + band
    for j, v in enumerate(y):
        match = places.get(v, 0) >> j & full
        zero = (((match & plus) + plus) ^ plus) | match | minus
        right_up = minus | (full & ~(zero | plus))
        right_down = zero & plus
        if not zero >> (width - 1) & 1:
            cost += 1
        down = zero >> 1
        plus, minus = (right_down | (full & ~(down | right_up))), down & right_up
    # The masks have moved on by one row. From the lowest cell, in row n + band, up to row m:
    between = (full >> 1) >> (m - n + band) << (m - n + band)
    return cost - (plus & between).bit_count() + (minus & between).bit_count()


def near(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the edit distance of two word sequences is at most (1 - similarity) * the longer one's length."""
    most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    n = min(len(x), len(y))
    head = int(np.argmin(np.append(x[:n] == y[:n], False)))
    x, y, n = x[head:], y[head:], n - head
    tail = int(np.argmin(np.append((x[::-1][:n] == y[::-1][:n]), False)))
    x, y = x[: len(x) - tail].view(np.int64).tolist(), y[: len(y) - tail].view(np.int64).tolist()
    band = min(most, 8 + 2 * abs(len(x) - len(y)))
    if banded_cost(x, y, band) <= most:  # any alignment within the budget will do
        return True
    if max(len(x), len(y)) - sum((Counter(x) & Counter(y)).values()) > most:  # each of the longer one's other words costs an edit
        return False
    while band < most:
        band = min(most, band * 4)
        if banded_cost(x, y, band) <= most:
            return True
    return False


def aligned(batches, similarity: float):
    """From rows (u, salt, v, text), sorted so that each leader u (with v null) comes before its members v: (u, v, near)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("near", pa.bool_())])
    leader = None
    for part in chunks(batches):
        w = Words(part.column("text"))
        us, vs, got = [], [], []
        for i, (u, v) in enumerate(zip(part.column("u").to_pylist(), part.column("v").to_pylist(), strict=True)):
            own = w.hashes[w.first[i] : w.first[i + 1]]
            if v is None:
                leader = own
            else:
                us.append(u), vs.append(v), got.append(near(leader, own, similarity))
        if us:
            yield emit(schema, u=us, v=vs, near=got)


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(u, v, near) of pairs (u, v); held: (id, text). Up to about LED members of a leader u are aligned in one place, with one copy of its text."""
    salts = pairs.groupBy("u").agg(F.ceil(F.count("*") / LED).alias("salts"))
    members = salted(pairs, salts, ["u"], "v", hint="merge")
    members = members.join(held.withColumnRenamed("id", "v"), "v").select("u", F.pmod(F.xxhash64("v", F.lit(1)), "salts").alias("salt"), "v", "text")
    leaders = salts.join(held.withColumnRenamed("id", "u"), "u").select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), "text")
    dealt = leaders.union(members).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return map_arrow(dealt, lambda b: aligned(b, similarity), "u long, v long, near boolean")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for all nodes of the edges (u, v).

    Alternates the two star contractions of Kiveris et al. (2014) until nothing changes; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    ordered = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now, before = stored(ordered(edges), spark, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ordered(salted(both, low, ["u"], "v", hint="merge").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = ordered(salted(large, low, ["u"], "v", hint="merge").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))))
        old, now = now, stored(small, spark, "edges")
        discard(old)
    out = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out.stored_path = now.stored_path
    return out


# ---------------------------------------------------------------- the operator


def _once_per_id(docs: DataFrame) -> DataFrame | None:
    """(doc_id, text_hash) of the ids with several rows: the smallest hash of their texts. None if there are none."""
    repeated = stored(docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), docs.sparkSession, "repeated")
    if repeated.isEmpty():
        discard(repeated)
        return None
    hashed = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(text_hash()).alias("text_hash"))
    out = stored(hashed, docs.sparkSession, "chosen")
    discard(repeated)
    return out


def text_hash():
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def _chosen(docs: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """The rows of ``docs`` (all columns), of ids in ``chosen`` only one with the text that is chosen."""
    if chosen is None:
        return docs
    single = docs.join(chosen, "doc_id", "left_anti")
    wanted = chosen.withColumnRenamed("text_hash", "_text_hash")
    several = docs.select(F.struct("*").alias("_doc"), "doc_id", text_hash().alias("_own")).join(wanted, "doc_id").where("_own = _text_hash")
    return single.union(several.groupBy("doc_id").agg(F.first("_doc").alias("_doc")).select("_doc.*"))


def groups(docs: DataFrame, *, shingle: int = SHINGLE, picks: int = PICKS, n: int = SKETCHES, similarity: float = SIMILARITY, short: int = SHORT, cold: int = COLD) -> DataFrame:
    """doc_id, copy_id (smallest id with the same words), group_id (smallest id of the near-duplicate group), n_words, n_links
    (aligned links of the copy class), kept (whether doc_id = group_id)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    chosen = _once_per_id(docs)
    docs = _chosen(docs, chosen)
    fits = lambda a, b: F.abs(F.col(a) - F.col(b)) <= (1 - similarity) * F.greatest(a, b) + 1e-9

    # Copy classes.
    keys = stored(map_arrow(docs, lambda b: drawn(b, shingle, picks, n), "doc_id long, copy_key binary, n_words long, sketches array<long>"), spark, "copies")
    several = keys.groupBy("copy_key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = stored(salted(keys.select("doc_id", "copy_key"), several, ["copy_key"], "doc_id", hint="merge").where("doc_id != copy_id").select("doc_id", "copy_id"), spark, "members")
    classes = keys.join(copies, "doc_id", "left_anti").where("n_words > 0").select(F.col("doc_id").alias("id"), F.col("n_words").alias("n"), "sketches")

    # Buckets and their leaders.
    buckets = classes.select("id", "n", F.explode("sketches").alias("bucket"))
    low = buckets.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("low"), F.count("*").alias("members")).where("members > 1").select("bucket", F.col("low.id").alias("lead"), F.col("low.n").alias("n_lead"), "members")
    within = stored(salted(buckets, low, ["bucket"], "id", hint="merge"), spark, "buckets")
    brief = classes.where(F.col("n") <= short / similarity).select("id", "n")  # all partners of texts of up to ``short`` words
    wanted = within.select("id").union(brief.select("id")).distinct()
    held = stored(docs.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi"), spark, "texts")
    stars = within.where("id != lead").where(fits("n", "n_lead")).select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct()
    checked = stored(verified(stars, held, similarity), spark, "stars")
    links = checked.where("near").select("u", "v")
    found = components(links)
    root = stored(found, spark, "roots")
    discard(found)

    # What is left: documents of one bucket, or short ones, in different components.
    with_root = lambda d: d.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("r", F.coalesce("root", "id")).drop("root")
    rest = stored(with_root(within.select("bucket", "id", "n", "members")), spark, "rest")
    open_ = rest.groupBy("bucket").agg(F.min("r").alias("low"), F.max("r").alias("high")).where("low != high").select("bucket")
    open_ = stored(salted(rest, open_, ["bucket"], "id", hint="merge"), spark, "open")
    wide = stored(with_root(open_.where(F.col("members") > cold).select("id", "n").union(brief).distinct()), spark, "wide")
    some = open_.where(F.col("members") <= cold).select("id", "n", "r")
    wide_texts = held.join(wide.select("id"), "id", "left_semi")
    counted = map_arrow(wide_texts.select("text"), _word_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int32)
    counts[counted["cell"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**31 - 1)
    shared = spark.sparkContext.broadcast(counts)  # CELLS numbers
    flagged = some.withColumn("wide", F.lit(False)).union(wide.select("id", "n", "r", F.lit(True))).groupBy("id", "n", "r").agg(F.max("wide").alias("wide"))
    told = stored(map_arrow(held.join(flagged, "id"), lambda b: described(b, shared.value, similarity), "id long, n long, r long, marks array<long>, fold array<long>, rare array<long>, most array<long>"), spark, "marks")
    bits = lambda x, y: sum(F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(FOLD))
    folded = F.greatest(bits("folda", "foldb"), bits("foldb", "folda")) <= (1 - similarity) * F.greatest("na", "nb") + 1e-9
    members = open_.where(F.col("members") <= cold).select("bucket", "id", "n", "r")
    pairs = _paired(members, members, ["bucket"], fits)
    words = told.where("rare is not null").select("id", "n", "r", "fold", F.inline(F.arrays_zip(F.col("rare").alias("word"), "most")))
    busy = words.where(F.col("most") > cold)  # only these are counted one by one; the others have at most ``cold`` texts each
    common = busy.groupBy("word").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("users")).where("low != high").select("word", "users")
    busy = stored(salted(busy, common, ["word"], "id", hint="merge"), spark, "words")
    own = ("word", "id", "n", "r", "fold")
    seldom, often = words.where(F.col("most") <= cold).select(*own).union(busy.where(F.col("users") <= cold).select(*own)), busy.where(F.col("users") > cold)
    blocks = F.ceil(F.col("users") / SPLIT)
    often = often.groupBy("id").agg(F.collect_list(F.struct("word", "users")).alias("common")).join(told.select("id", "n", "r", "marks"), "id").select("id", "n", "r", "marks", F.inline("common"))
    often = often.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), blocks)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    often = often.select("word", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "id", "n", "r", "marks").repartition("word", "i", "j").sortWithinPartitions("word", "i", "j")
    within_bounds = map_arrow(often, lambda b: _bounded(b, similarity), "a long, b long, na long, nb long")
    pairs = pairs.union(_paired(seldom, seldom, ["word"], fits, folded)).union(within_bounds).distinct()
    pairs = pairs.join(checked.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), ["a", "b"], "left_anti")
    side = lambda x: told.select(F.col("id").alias(x), F.col("marks").alias(f"marks{x}"))
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, v: t + v)
    worded = lambda x, y: only(x, y) <= (1 - similarity) * F.greatest("na", "nb") + 1e-9
    more = pairs.join(side("a"), "a").join(side("b"), "b").where(worded("marksa", "marksb")).where(worded("marksb", "marksa"))
    more = stored(more.select(F.col("a").alias("u"), F.col("b").alias("v")), spark, "pairs")  # the bitmaps' shuffle files go before texts are shuffled
    for d in (within, root, rest, open_, wide, told, busy):
        discard(d)
    rest_checked = stored(verified(more, held, similarity), spark, "rest")
    for d in (held, more):
        discard(d)
    links = links.union(rest_checked.where("near").select("u", "v"))
    root = components(links)
    degree = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = root.join(degree, "node", "left").select(F.col("node").alias("copy_id"), "root", "n_links")
    out = keys.select("doc_id", "n_words").join(copies, "doc_id", "left").select("doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), "n_words")
    out = salted(out, linked, ["copy_id"], "doc_id", "left", hint="merge").withColumn("group_id", F.coalesce("root", "copy_id"))
    out = out.select("doc_id", "copy_id", "group_id", "n_words", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("doc_id") == F.col("group_id")).alias("kept"))
    out = stored(out, spark, "groups")
    for d in (keys, copies, checked, rest_checked, root, chosen):
        discard(d)
    return out


def _paired(left: DataFrame, right: DataFrame, keys: list[str], fits, bound=None) -> DataFrame:
    """(a, b, na, nb): pairs a < b of rows that agree in ``keys``, aren't connected yet, fit in length, and are within the ``bound`` on their columns folda and foldb."""
    names = {"id": "", "n": "n", "r": "r"} | ({"fold": "fold"} if bound is not None else {})
    side = lambda d, x: d.select(*keys, *(F.col(c).alias(short + x) for c, short in names.items()))
    condition = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits("na", "nb")
    both = side(left, "a").join(side(right, "b"), keys)
    return both.where(condition if bound is None else condition & bound).select("a", "b", "na", "nb")


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without those that ``groups`` doesn't keep; one document of each group stays, all columns with it."""
    spark = docs.sparkSession
    found = groups(docs.select("doc_id", "text"), **parameters)
    gone = stored(found.where("not kept").select("doc_id"), spark, "gone")  # ids alone: often small enough to spare the texts a shuffle
    discard(found)
    kept = docs.join(gone, "doc_id", "left_anti")
    chosen = _once_per_id(kept.where("doc_id is not null").select("doc_id", "text"))
    if chosen is not None:
        kept = kept.where("doc_id is null").union(_chosen(kept.where("doc_id is not null"), chosen))
    return kept


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
