"""Token-id files: canonical length-limited Huffman coding, decoded by table in independent blocks.

Ids are counted over all documents; package-merge (Larmore and Hirschberg 1990) gives the optimal code lengths of at most LIMIT bits, and
the lengths alone give the canonical code. Each document begins at a byte. Each BLOCK of its ids has a checkpoint, the bit offset at which it begins, so that blocks
are decoded independently: all of a file's blocks advance together, one table look-up of LIMIT bits for each id.

A file (``.hid``), integers little-endian:

    bytes 0-7   b"HXTOK1\\0\\0"
    8-15        length of the header that follows, JSON: limit, block, documents, tokens, symbols, sections {name: [offset, length]}, offsets from the file's start
    sections    lengths: zlib of one code-length byte for each id up to the largest; doc_ids: int64; nulls: one byte for each document without an id;
                counts: uint32 ids of each document; starts: uint64 byte offset in ``codes`` of each document; checkpoints: uint64 bit offset in ``codes`` of each block; codes

Documents are in ascending doc_id order (null ids first, equal ids by their ids' bytes), within a file and from file to file.

Defined results: a null text is empty and gets the end id only; repeated rows are kept as rows; extra columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bits import pack, windows
from ._common import chunks, discard, emit, map_arrow, mix, open_fs, put_file, ragged, span_hashes, stored, table, texts, work_dir

#: Letters that follow the apostrophe of a contraction, alone or before an e (and ll).
CONTRACTED_ONE, CONTRACTED_TWO = [ord(x) for x in "stmd"], [ord(x) for x in "rv"]
LIMIT, BLOCK, END, MAGIC = 18, 1024, 2, b"HXTOK1\0\0"
#: Ids per file, about 40 MB; a longer document still goes into one file.
FILE_TOKENS = 30_000_000
#: Ids per writing task, as long as these are fewer than MOST_PARTS; then tasks grow. That bounds the sketch of the ranges' bounds and their broadcast.
PART_TOKENS, MOST_PARTS = 8_000_000, 20_000
#: Words kept by a tokenizing worker before it starts afresh; bytes of text tokenized at once.
KEPT_WORDS, CHUNK = 2_000_000, 500_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- tokenizing


class Encoder:
    """A byte-level BPE of the tokenizers library, which encodes each distinct piece of text once.

    The model's own splitting rule cuts a text into pieces that are encoded independently of each other: `` ?letters``, `` ?digits``, `` ?others``, white space
    (its last character goes with what follows, or stands alone if it isn't a blank), and the English contractions. Here the cuts are found for a
    whole chunk at once by character classes; texts with an added token's content go to the library whole.
    """

    _classes: np.ndarray | None = None

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known = HashTable()
        self.place, self.many, self.flat = Growing(np.int64), Growing(np.int32), Growing(np.int32)

    @classmethod
    def classes(cls) -> np.ndarray:
        """0 white space, 1 letter, 2 number, 3 other, by code point."""
        if cls._classes is None:
            import regex

            out = np.full(0x110000, 3, np.uint8)
            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            at = np.array([*range(0xD800), *range(0xE000, 0x110000)])
            for k, rule in ((1, r"\p{L}"), (2, r"\p{N}"), (0, r"\s")):
                found = np.zeros(len(every), bool)
                for m in regex.finditer(f"(?:{rule})+", every):
                    found[m.start() : m.end()] = True
                out[at[found]] = k
            out[0x1C:0x20] = 3  # separators that the library doesn't count as white space
            cls._classes = out
        return cls._classes

    def whole(self, texts_: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]

    def pieces(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces of all rows end to end, which cover all characters."""
        kind = self.classes()[points]
        n = len(kind)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # A run of white space that something follows is cut before its last character; a blank there goes with what follows.
        last = np.zeros(n, bool)
        last[:-1] = (kind[:-1] == 0) & (kind[1:] != 0) & ~first[1:n]
        start |= last
        led = np.zeros(n, bool)
        led[1:] = (last & (points == 32))[:-1]
        start &= ~led
        mark = np.flatnonzero((points == 39) & start)  # apostrophes that begin a piece: contractions
        if len(mark):
            end = np.append(offsets, n)[np.searchsorted(offsets, mark, "right")]
            one, two = (points[np.minimum(mark + k, n - 1)] * (mark + k < end) for k in (1, 2))
            size = np.where(np.isin(one, CONTRACTED_ONE), 1, np.where((one == ord("l")) & (two == ord("l")) | np.isin(one, CONTRACTED_TWO) & (two == ord("e")), 2, 0))
            mark, size, end = (x[size > 0] for x in (mark, size, end))
            start[mark + 1] = False
            after = mark + 1 + size
            start[after[after < end]] = True
        return np.flatnonzero(start)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and their n+1 offsets."""
        data, at = texts(column)
        n = len(at) - 1
        raw = data.tobytes()
        odd = sorted({int(np.searchsorted(at, m.start(), "right")) - 1 for x in self.added if x in raw for m in re.finditer(re.escape(x), raw)})
        if odd:  # texts with an added token's content
            keep = np.ones(n, bool)
            keep[odd] = False
            ids, out = self.encode(column.filter(pa.array(keep)))
            lists = {i: ids[x:y] for i, x, y in zip(np.flatnonzero(keep).tolist(), out, out[1:], strict=False)}
            lists |= dict(zip(odd, self.whole([raw[at[i] : at[i + 1]].decode() for i in odd]), strict=True))
            return np.concatenate([lists[i] for i in range(n)]), np.concatenate(([0], np.cumsum([len(lists[i]) for i in range(n)]))).astype(np.int64)
        joined = raw.decode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if len(points) < len(data):
            at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))[at]
        a = self.pieces(points, at)
        b = np.append(a[1:], len(points))
        number = self.look_up(span_hashes(points, a, b) | np.uint64(1), a, b, joined)
        many = self.many.held[number]
        ids = self.flat.held[ragged(self.place.held[number], many)]
        total = np.concatenate(([0], np.cumsum(many, dtype=np.int64)))
        return ids, total[np.searchsorted(a, at)]

    def new_pieces(self, texts_: list[str]) -> list[list[int]]:
        """Ids of pieces: the library's merges, on the pieces' bytes as the vocabulary writes them."""
        joined = "".join(texts_)
        sizes = map(len, texts_) if joined.isascii() else [len(t.encode()) for t in texts_]
        written, at, tokenize, out = joined.encode().decode("latin-1").translate(BYTE_CHARACTERS), 0, self.tokenizer.model.tokenize, []
        for n in sizes:
            out.append([t.id for t in tokenize(written[at : at + n])])
            at += n
        return out

    def look_up(self, h, a, b, joined: str) -> np.ndarray:
        """Numbers of the pieces with these hashes among those kept, once the new ones are encoded."""
        if self.known.size > KEPT_WORDS:
            self.clear()
        at = self.known.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, which, number = np.unique(h[missing], return_index=True, return_inverse=True)
            which = missing[which]
            ids = self.new_pieces([joined[x:y] for x, y in zip(a[which].tolist(), b[which].tolist(), strict=True)])
            many = np.array([len(x) for x in ids], np.int32)
            self.place.add(self.flat.n + np.cumsum(many, dtype=np.int64) - many)
            self.many.add(many)
            self.flat.add(np.fromiter(chain.from_iterable(ids), np.int32, int(many.sum())))
            at[missing] = self.known.size + number
            self.known.add(new)
        return at


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.n, self.held = 0, np.zeros(1 << 12, kind)

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.append(self.held, np.zeros(max(len(self.held), len(values)), self.held.dtype))
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class HashTable:
    """Numbers 0, 1, ... of 64-bit hashes other than 0, in order of their addition: open addressing, all look-ups of a batch together."""

    def __init__(self):
        self.size, self.bits = 0, 16
        self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The hashes' numbers, -1 for those not there."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.numbers[slot], np.int32(-1))
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = slot[left]
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.numbers[at[hit]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        numbers = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        if self.size * 2 > len(self.keys):
            full = self.keys != 0
            h, numbers = np.append(self.keys[full], h), np.append(self.numbers[full], numbers)
            while self.size * 2 > 1 << self.bits:
                self.bits += 2
            self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]  # of several for one slot one stays
            won = self.keys[at] == h[left]
            self.numbers[at[won]] = numbers[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes, in order, for those from U+0100 on."""
    out, spare = {}, 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x:
            out[x] = chr(x)
        else:
            out[x], spare = chr(spare), spare + 1
    return out


BYTE_CHARACTERS = _byte_characters()
_ENCODERS: dict[str, Encoder] = {}


def _tokenized(batches, path: str, end: int):
    """(doc_id, n, ids, counts) of each document: its ids as two planes, low 16 bits and (if needed) high ones, each byte by byte, which compress better so;
    at last one row that holds only ``counts``, how often each id stands in all these documents."""
    if path not in _ENCODERS:  # one for all tasks of a worker
        _ENCODERS[path] = Encoder(path)
    encoder = _ENCODERS[path]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
    total = np.zeros(end + 1, np.int64)
    for part in chunks(batches, most=CHUNK):
        ids, at = encoder.encode(part.column("text"))
        total = added(total, np.bincount(ids))
        total[end] += part.num_rows
        ids, n = np.insert(ids, at[1:], end), np.diff(at) + 1
        yield emit(schema, doc_id=part.column("doc_id"), n=n, ids=planes(ids, n), counts=pa.nulls(len(n), pa.binary()))
    yield emit(schema, doc_id=[None], n=[0], ids=[None], counts=[total.astype("<i8").tobytes()])


def added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of two arrays of counts, the shorter one continued by zeros."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    x = x.copy()
    x[: len(y)] += y
    return x


def _planes_at(counts: np.ndarray, wide: int) -> np.ndarray:
    """Where each byte of rows of ids stands once each row's bytes are sorted into planes: (bytes of an id, ids)."""
    first = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) + np.repeat(first * (wide - 1), counts)
    return place + np.arange(wide)[:, None] * np.repeat(counts, counts)


def planes(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ids (end to end, ``counts`` of each, one at least) as planes of 2 bytes an id, or 4 in rows with an id of more than 16 bits."""
    if not len(ids) or ids.max() < 1 << 16:
        out = np.empty(2 * len(ids), np.uint8)
        out[_planes_at(counts, 2)] = ids.astype("<u2").view(np.uint8).reshape(-1, 2).T
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(2 * counts))).astype(np.int32)), pa.py_buffer(out)])
    rows = np.split(ids, np.cumsum(counts)[:-1])
    wide = [2 if x.max() < 1 << 16 else 4 for x in rows]
    return pa.array([x.astype(f"<u{k}").view(np.uint8).reshape(-1, k).T.tobytes() for x, k in zip(rows, wide, strict=True)], pa.binary())


def unplanes(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The ids of all rows end to end."""
    data, offsets = texts(column)
    if np.array_equal(np.diff(offsets), 2 * counts):
        low, high = data[_planes_at(counts, 2)]
        return low.astype(np.int64) | high.astype(np.int64) << 8
    rows = ((data[a:b], n) for a, b, n in zip(offsets, offsets[1:], counts.tolist(), strict=False))
    return np.concatenate([np.ascontiguousarray(x.reshape(-1, n).T).view(f"<u{len(x) // n}").ravel().astype(np.int64) for x, n in rows])


def tokenize(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, n (ids with the end id), ids (see ``planes``), counts (null) of each row, and a row of counts for each partition (see ``_tokenized``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, lambda b: _tokenized(b, path, end), "doc_id long, n long, ids binary, counts binary")


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit into {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, merged = [], leaf
    kinds = [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
        both = np.concatenate((leaf, packages))
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        kinds.append(rank < len(leaf))
    levels = np.zeros(len(leaf), np.uint8)
    take = 2 * len(leaf) - 2
    for kind in reversed(kinds):  # of the cheapest ``take`` items: leaves get a bit more, packages open two items of the level below
        leaves = int(kind[:take].sum())
        levels[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = levels
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by id, ids in code order)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    if not len(n):
        return np.zeros(len(lengths), np.uint32), order
    step = 1 << (n.max() - n)
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = (np.cumsum(step) - step) >> (n.max() - n)
    return codes, order


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length, bits): for each value of the next ``bits`` bits the id that they begin with and its code's length."""
    _, order = canonical(lengths)
    if not len(order):
        return np.zeros(2, np.int32), np.ones(2, np.uint8), 1
    bits = int(lengths.max())
    many = 1 << (bits - lengths[order].astype(np.int64))
    ids, n = np.repeat(order, many), np.repeat(lengths[order], many)
    pad = (1 << bits) - len(ids)  # with a single id only
    return np.append(ids, np.zeros(pad, ids.dtype)).astype(np.int32), np.append(n, np.ones(pad, n.dtype)), bits


def encode_ids(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids (end to end, ``counts`` of each) as (bytes, n+1 byte offsets, bit offset of each block from its document's start)."""
    first = np.concatenate(([0], np.cumsum(counts)))
    n = lengths[ids].astype(np.int64)
    total = np.concatenate(([0], np.cumsum(n)))
    size = (total[first[1:]] - total[first[:-1]] + 7) // 8
    offsets = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(counts)), counts)
    inside = total[:-1] - total[first[:-1]][row]
    data = pack(codes[ids], n, inside + offsets[:-1][row] * 8, int(offsets[-1]))
    at = np.arange(len(ids)) - first[:-1][row]
    return data, offsets, inside[at % block == 0]


def decode_blocks(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of blocks that begin at the bits ``starts``, ``counts`` of each, end to end. All blocks advance together."""
    ids, n, bits = decoding_table(lengths)
    n = n.astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.int32)
    most = int(counts.max())
    order = np.argsort(-counts, kind="stable")  # so that the blocks that go on are always the first ones
    at = starts[order].astype(np.int64)
    left = np.searchsorted(-counts[order], -np.arange(1, most + 1), "right")
    out = np.empty(int(counts.sum()), np.int32)
    place = np.concatenate(([0], np.cumsum(counts)[:-1]))[order]
    window = windows(data)
    for k in range(most):
        m = left[k]
        now = at[:m]
        value = (window[now >> 3] << (now & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[place[:m] + k] = ids[value]
        at[:m] = now + n[value]
    return out


# ---------------------------------------------------------------- files


def _sections(lengths: np.ndarray, doc_ids: list, counts: np.ndarray, starts: np.ndarray, checkpoints: np.ndarray, codes: list[bytes], block: int) -> list[bytes]:
    last = int(np.flatnonzero(lengths)[-1]) + 1 if lengths.any() else 0
    sections = {
        "lengths": zlib.compress(lengths[:last].tobytes()), "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(), "nulls": bytes(x is None for x in doc_ids),
        "counts": counts.astype("<u4").tobytes(), "starts": starts.astype("<u8").tobytes(), "checkpoints": checkpoints.astype("<u8").tobytes(),
    }
    header = {"limit": LIMIT, "block": block, "documents": len(doc_ids), "tokens": int(counts.sum()), "symbols": last}

    def text(shift: int) -> bytes:
        at, places = 16 + shift, {}
        for name, data in [*sections.items(), ("codes", b"")]:
            n = len(data) if name != "codes" else sum(map(len, codes))
            places[name], at = [at, n], at + n
        return json.dumps(header | {"sections": places}).encode()

    shift = 0
    while len(text(shift)) > shift:
        shift = len(text(shift))
    return [MAGIC, shift.to_bytes(8, "little"), text(shift).ljust(shift), *sections.values(), *codes]


def read_file(uri: str):
    """(doc_ids, counts, ids end to end) of one file."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        start = f.read(16)
        if start[:8] != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        header = json.loads(f.read(int.from_bytes(start[8:], "little")))

        def section(name: str, kind: str = "u1") -> np.ndarray:
            at, n = header["sections"][name]
            return np.frombuffer(f.read_at(n, at), kind)

        lengths = np.frombuffer(zlib.decompress(section("lengths").tobytes()), np.uint8)
        nulls, counts, starts, checkpoints = section("nulls").astype(bool), section("counts", "<u4").astype(np.int64), section("starts", "<u8").astype(np.int64), section("checkpoints", "<u8").astype(np.int64)
        doc_ids = pa.array(section("doc_ids", "<i8"), mask=nulls)
        codes = section("codes")
    block = header["block"]
    blocks = -(-counts // block)
    inside = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = np.minimum(block, np.repeat(counts, blocks) - inside * block)
    # Some blocks at a time, so that the windows of the whole file aren't held at once.
    out, step = [], 4000
    for i in range(0, len(own), step):
        low = int(checkpoints[i]) >> 3
        high = (int(checkpoints[i + step]) >> 3) + 1 if i + step < len(own) else len(codes)
        out.append(decode_blocks(codes[low:high], checkpoints[i : i + step] - low * 8, own[i : i + step], lengths))
    del starts
    return doc_ids, counts, np.concatenate(out) if out else np.zeros(0, np.int32)


def write_files(docs: DataFrame, *, path: str | None = None, end: int = END, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the documents' ids; one row per file: uri, part, seq (its order among files is part, then seq), documents, tokens, start (ids in all files before it)."""
    spark = docs.sparkSession
    path, folder = path or tokenizer_path(), folder or work_dir(spark, "tokens")
    held = stored(tokenize(docs, path, end), spark, "ids")
    tokens = held.where("counts is null").select("doc_id", "n", "ids")
    counts = map_arrow(held.where("counts is not null").select("counts"), _counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the vocabulary at most
    total = np.zeros(int(counts["id"].to_numpy().max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(total)
    parts = min(MOST_PARTS, max(1, int(-(-total.sum() // min(file_tokens, PART_TOKENS)))))
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)[0]))  # a vocabulary of code lengths and codes
    bounds = tokens.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts + 1000)).first()[0] or []
    edges = spark.sparkContext.broadcast(np.unique(np.array(bounds if parts > 1 else [], np.int64)))  # fewer than MOST_PARTS numbers
    coded = map_arrow(tokens, lambda b: _coded(b, shared.value, edges.value), "part int, doc_id long, n long, tie long, data binary, checkpoints binary")
    # Ranges of ids of about equal size; each holds whole ids, so files follow one another.
    dealt = coded.repartitionById(len(edges.value) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie", "n")
    kept = stored(map_arrow(dealt, lambda b: _written(b, folder, shared.value[0], file_tokens), "part int, seq int, uri string, documents long, tokens long"), spark, "token-files")
    discard(held)
    rows = kept.orderBy("part", "seq").collect()  # one small row per file
    out, start = [], 0
    for r in rows:
        out.append((r.uri, r.part, r.seq, r.documents, r.tokens, start))
        start += r.tokens
    return spark.createDataFrame(out, "uri string, part int, seq int, documents long, tokens long, start long")


def _counted(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for own in batch.column("counts"):
            total = added(total, np.frombuffer(own.as_py(), "<i8"))
    at = np.flatnonzero(total)
    yield emit(pa.schema([("id", pa.int64()), ("n", pa.int64())]), id=at, n=total[at])


def _coded(batches, code, edges):
    lengths, codes = code
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("tie", pa.int64()), ("data", pa.binary()), ("checkpoints", pa.binary())])
    for batch in chunks(batches, "ids", 1_000_000):
        n = batch.column("n").to_numpy()
        data, offsets, inside = encode_ids(unplanes(batch.column("ids"), n), n, codes, lengths)
        blocks = np.concatenate(([0], np.cumsum(-(-n // BLOCK))))
        raw, at = texts(batch.column("ids"))
        ties = mix(np.array([zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], np.uint64)).view(np.int64)
        doc_ids = batch.column("doc_id")
        part = np.searchsorted(edges, doc_ids.fill_null(-(1 << 63)).to_numpy(), "right")
        rows = lambda x, first: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
        yield emit(schema, part=part.astype(np.int32), doc_id=doc_ids, n=n, tie=ties, data=rows(data, offsets), checkpoints=rows(inside.astype("<u8"), blocks * 8))


def _written(batches, folder: str, lengths: np.ndarray, file_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])
    held: list = []
    part, seq, tokens = None, 0, 0

    def close():
        data = [x[3] for x in held]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in data])))[:-1].astype(np.int64)
        marks = [np.frombuffer(x[4], "<u8").astype(np.int64) + s * 8 for x, s in zip(held, starts, strict=True)]
        counts = np.array([x[2] for x in held], np.int64)
        pieces = _sections(lengths, [x[1] for x in held], counts, starts, np.concatenate(marks), data, BLOCK)
        return emit(schema, part=[part], seq=[seq], uri=[put_file(folder, f"{part:06d}-{seq:04d}", ".hid", pieces)], documents=[len(held)], tokens=[int(counts.sum())])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "data", "checkpoints")), strict=True):
            if held and (row[0] != part or tokens + row[2] > file_tokens):
                yield close()
                held, tokens, seq = [], 0, seq + 1 if row[0] == part else 0
            part = row[0]
            held.append(row)
            tokens += row[2]
    if held:
        yield close()


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                doc_ids, counts, ids = read_file(uri)
                first = np.concatenate(([0], np.cumsum(counts)))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first, first[1:], strict=False)]
                yield emit(schema, doc_id=doc_ids, start=first[:-1] + start, n_tokens=counts, ids_crc32=crc)

    n = max(1, files.count())
    return map_arrow(files.repartition(n, "uri"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents")))
