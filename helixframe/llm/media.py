"""Media columns: AVI motion JPEG, decoded frame by frame and cut into shots.

``encode`` stores bytes as grey frames of SIDE x SIDE 8-bit samples, padded with 255 to a positive multiple of a frame: a RIFF AVI whose frames
are JPEG pictures of the lossless Huffman process (ITU-T T.81, SOF3, predictor 1), so that the samples come back exactly. ``read`` parses the RIFF
chunks, takes the frames' places from the ``idx1`` index, and decodes all frames of one head together, one sample of each at a time. Frames that other programs
write are mostly baseline JPEG (SOF0, Huffman, 8 bits); of these the luma plane is decoded, frame by frame. ``clips``
detects shots: the difference of neighbouring frames' histograms is a cut where it exceeds FACTOR times the mean of the WINDOW differences before it, and FLOOR.
It yields one timed row per clip; no decoded frame is left out.

Defined results: a null text is empty and gives one frame of padding. Rows are handled one by one, so repeated rows, null ids and extra columns
don't matter; equal texts have equal media. A null media value has no frames and no clips. Longer values just have more frames. Frames that are damaged
or of another process (progressive, arithmetic) are left out and counted (``bad_frames``); media that is no AVI has no frames, and one bad frame by definition.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bits import pack, windows
from ._common import chunks, emit, map_arrow, ragged, table, texts

SIDE, FPS, BINS, WINDOW, FACTOR, FLOOR = 24, 25, 16, 8, 1.6, 0.25
FRAME = SIDE * SIDE
#: Code lengths of the difference categories 0 to 8: fixed, chosen for text.
LENGTHS = (5, 4, 3, 2, 2, 4, 5, 3, 6)

# ---------------------------------------------------------------- JPEG


def huffman_table() -> tuple[bytes, np.ndarray]:
    """(BITS and HUFFVAL of a DHT segment, code of each category)."""
    order = sorted(range(len(LENGTHS)), key=lambda c: (LENGTHS[c], c))
    codes, code, n = np.zeros(len(LENGTHS), np.uint32), 0, 0
    for c in order:
        code <<= LENGTHS[c] - n
        n = LENGTHS[c]
        codes[c] = code
        code += 1
    return bytes(LENGTHS.count(k) for k in range(1, 17)) + bytes(order), codes


def jpeg_head(side: int = SIDE) -> bytes:
    """All of a frame before its entropy-coded data."""
    table_ = huffman_table()[0]
    size = side.to_bytes(2, "big")
    return (
        b"\xff\xd8" + b"\xff\xc3" + (11).to_bytes(2, "big") + b"\x08" + size + size + b"\x01\x01\x11\x00"
        + b"\xff\xc4" + (3 + len(table_)).to_bytes(2, "big") + b"\x00" + table_
        + b"\xff\xda" + (8).to_bytes(2, "big") + b"\x01\x01\x00\x01\x00\x00"
    )


@dataclass
class Head:
    """What stands before a frame's entropy-coded data."""

    size: int = 0  # of the head itself
    process: int = 0  # the SOF marker
    height: int = 0
    width: int = 0
    components: list = field(default_factory=list)  # (id, blocks across, blocks down, quantisation table)
    quantisation: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)  # (class, number): (BITS, HUFFVAL)
    scan: list = field(default_factory=list)  # (component id, DC table, AC table)
    predictor: int = 0
    restart: int = 0


@lru_cache(maxsize=256)
def read_head(data: bytes) -> Head:
    """The head at the beginning of a frame; ValueError if it isn't one that can be decoded."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    h, at = Head(huffman=dict(STANDARD)), 2
    while at + 4 <= len(data) and data[at] == 255:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if at > len(data) or size < 2:
            break
        if marker in (0xC0, 0xC1, 0xC3) and len(body) >= 6 + 3 * body[5]:
            h.process, h.height, h.width = marker, int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            h.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            if body[0] != 8 or not h.height or not h.width or not h.components or any(not x or not y for _, x, y, _ in h.components):
                raise ValueError("only 8-bit samples")
        elif marker == 0xC4:
            place = 0
            while place + 17 <= len(body):
                bits = body[place + 1 : place + 17]
                h.huffman[body[place] >> 4, body[place] & 15] = (bits, body[place + 17 : place + 17 + sum(bits)])
                place += 17 + sum(bits)
        elif marker == 0xDB:
            place = 0
            while place < len(body):
                wide = 1 + (body[place] >> 4)
                h.quantisation[body[place] & 15] = np.frombuffer(body[place + 1 : place + 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.float64)
                place += 1 + 64 * wide
        elif marker == 0xDD:
            h.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            h.scan = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            h.predictor, h.size = body[1 + 2 * body[0]], at
            if not h.process or len(h.scan) != len(h.components):
                break
            if h.process == 0xC3 and (h.width != h.height or len(h.components) > 1 or h.predictor != 1):
                raise ValueError("only square grey lossless frames with predictor 1")
            return h
        elif marker in range(0xC2, 0xD0) and marker not in (0xC8, 0xCC):
            raise ValueError("another process")
    raise ValueError("no scan")


def short_codes(bits: bytes, values: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, length) of the code that each number of ``most`` bits begins with; length 0 if none."""
    value, length, code, place = np.zeros(1 << most, np.int64), np.zeros(1 << most, np.int64), 0, 0
    if sum(bits[most:]) or len(values) < sum(bits):
        raise ValueError("codes too long")
    for n in range(1, most + 1):
        for _ in range(bits[n - 1]):
            low = code << (most - n)
            if low >= 1 << most:
                raise ValueError("too many codes")
            value[low : low + (1 << most - n)], length[low : low + (1 << most - n)] = values[place], n
            code, place = code + 1, place + 1
        code <<= 1
    return value, length


# The Huffman tables that frames without their own use (ITU-T T.81, K.3 to K.6), as (BITS, HUFFVAL).
STANDARD = {
    (0, 0): (bytes.fromhex("00010501010101010100000000000000"), bytes(range(12))),
    (0, 1): (bytes.fromhex("00030101010101010101010000000000"), bytes(range(12))),
    (1, 0): (
        bytes.fromhex("0002010303020403050504040000017d"),
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
            "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
            "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        ),
    ),
    (1, 1): (
        bytes.fromhex("00020102040403040705040400010277"),
        bytes.fromhex(
            "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
            "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
            "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        ),
    ),
}


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of samples (frames x FRAME)."""
    n = len(samples)
    x = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    before = np.empty_like(x)
    before[:, :, 1:], before[:, 1:, 0], before[:, 0, 0] = x[:, :, :-1], x[:, :-1, 0], 128
    d = (x - before).reshape(-1).astype(np.int32)
    size = _CATEGORY[np.abs(d)]
    extra = np.where(d < 0, d + (1 << size) - 1, d).astype(np.uint32)
    bits = _CODE_LENGTH[size] + size
    code = _CODE[size] << size.astype(np.uint32) | extra
    bits = bits.reshape(n, FRAME)
    total = bits.sum(1)
    n_bytes = (total + 7) // 8
    first = np.concatenate(([0], np.cumsum(n_bytes)))
    at = (np.cumsum(bits, 1) - bits + first[:-1, None] * 8).ravel()
    data = pack(code, bits.ravel(), at, int(first[-1])).copy()
    data[first[1:] - 1] |= ((1 << (n_bytes * 8 - total)) - 1).astype(np.uint8)  # the last byte is filled with ones
    full = data == 255
    stuffed = np.insert(data, np.flatnonzero(full) + 1, 0)
    first += np.concatenate(([0], np.cumsum(full)))[first]
    raw, head = stuffed.tobytes(), jpeg_head()
    return [head + raw[a:b] + b"\xff\xd9" for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]


_CATEGORY = np.array([x.bit_length() for x in range(256)], np.int32)
_CODE = huffman_table()[1]
_CODE_LENGTH = np.array(LENGTHS, np.int32)


def unstuffed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entropy-coded bytes of all scans without the zeros after 255, n+1 offsets)."""
    coded = data[ragged(starts, ends - starts)]
    first = np.concatenate(([0], np.cumsum(ends - starts)))
    keep = np.ones(len(coded), bool)
    keep[1:] = ~((coded[1:] == 0) & (coded[:-1] == 255))
    return coded[keep], np.concatenate(([0], np.cumsum(keep)))[first]


def decode_lossless(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """(samples (frames x side squared) of lossless frames data[start:end] with this head, whether each frame's data ended where its samples did)."""
    side = head.width
    category, length = short_codes(*head.huffman[0, head.scan[0][1]], 8)
    coded, first = unstuffed(data, starts + head.size, np.maximum(starts + head.size, ends - 2))
    at = first[:-1] * 8
    window = windows(np.append(coded, np.zeros(4 * side * side + 8, np.uint8)))  # a damaged frame can't lead beyond
    out = np.empty((side * side, len(starts)), np.int32)
    for k in range(side * side):
        w = window[at >> 3] << (at & 7).astype(np.uint32)
        c = (w >> np.uint32(24)).astype(np.int64)
        size, n = category[c], length[c]
        extra = ((w << n.astype(np.uint32)) >> np.uint32(16)).astype(np.int64) >> (16 - size)
        out[k] = np.where(extra >> np.maximum(size - 1, 0), extra, extra - (1 << size) + 1)
        at = at + n + size
    d = out.T.reshape(-1, side, side)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
    ended = ((at + 7) >> 3 == first[1:]) & (data[ends - 2] == 0xFF) & (data[ends - 1] == 0xD9)
    return (np.cumsum(d, 2) & 255).astype(np.uint8).reshape(len(starts), -1), ended


def _zigzag() -> np.ndarray:
    """The place in a block, row by row, of each coefficient: diagonals, up and down in turn."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in order])


_ZIGZAG = _zigzag()
_WAVES = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)


def decode_baseline(data: bytes, head: Head) -> np.ndarray:
    """The first component (luma) of one baseline frame, as height x width samples; ValueError if its data is damaged."""
    first_of = {c[0]: k for k, c in enumerate(head.components)}
    across, down = max(c[1] for c in head.components), max(c[2] for c in head.components)
    single = len(head.components) == 1
    parts = []  # of a unit: component, blocks, tables
    for name, dc, ac in head.scan:
        k = first_of[name]
        _, x, y, _ = head.components[k]
        tables = [[a << 8 | b for a, b in zip(*(t.tolist() for t in short_codes(*head.huffman[kind, n], 16)), strict=True)] for kind, n in ((0, dc), (1, ac))]
        parts.append((k, 1 if single else x * y, *tables))
    _, x, y, table_ = head.components[0]
    x, y, across, down = (1, 1, 1, 1) if single else (x, y, across, down)
    wide, high = -(-head.width // (8 * across)), -(-head.height // (8 * down))
    raw = np.frombuffer(data, np.uint8)[head.size :]
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0))  # restarts, and the end
    starts, ends = np.concatenate(([0], marks[:-1] + 2)), marks
    coded, edges = unstuffed(raw, starts, ends)
    window = windows(np.append(coded, np.zeros(8, np.uint8))).tolist()
    blocks = np.zeros((wide * high * x * y, 64))
    piece, at, done, previous = 0, 0, 0, [0] * len(head.components)

    def bits(n: int) -> int:
        nonlocal at
        if at >> 3 >= len(coded):
            raise ValueError("the data ends early")
        value = (window[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - n) if n else 0
        at += n
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    def symbol(codes: list) -> int:
        nonlocal at
        if at >> 3 >= len(coded):
            raise ValueError("the data ends early")
        found = codes[(window[at >> 3] << (at & 7) & 0xFFFFFFFF) >> 16]
        if not found & 255:
            raise ValueError("no such code")
        at += found & 255
        return found >> 8

    for unit in range(wide * high):
        if head.restart and unit and unit % head.restart == 0:
            piece, previous = piece + 1, [0] * len(head.components)
            if piece >= len(starts):
                raise ValueError("no restart")
            at = int(edges[piece]) * 8
        for k, many, dc, ac in parts:
            for _ in range(many):
                previous[k] += bits(symbol(dc))
                own = blocks[done] if k == 0 else None
                if own is not None:
                    own[0], done = previous[k], done + 1
                i = 1
                while i < 64:
                    run = symbol(ac)
                    if not run & 15:
                        if run != 0xF0:
                            break
                        i += 16
                        continue
                    i += run >> 4
                    value = bits(run & 15)
                    if i > 63:
                        raise ValueError("too many coefficients")
                    if own is not None:
                        own[i] = value
                    i += 1
    if table_ not in head.quantisation or len(head.quantisation[table_]) != 64:
        raise ValueError("no quantisation table")
    flat = np.zeros_like(blocks)
    flat[:, _ZIGZAG] = blocks * head.quantisation[table_]
    pixels = np.clip(np.rint(_WAVES @ flat.reshape(-1, 8, 8) @ _WAVES.T + 128), 0, 255).astype(np.uint8)
    plane = pixels.reshape(high, wide, y, x, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * y * 8, wide * x * 8)
    return plane[: -(-head.height * y // down), : -(-head.width * x // across)]


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray | None] | np.ndarray:
    """The samples of each frame data[start:end], row by row; None for a damaged frame or one of another process. An array if all frames are sound lossless ones of one head."""
    out: list[np.ndarray | None] = [None] * len(starts)
    sound = (starts >= 0) & (ends <= len(data)) & (ends - starts > 8)
    groups: list[tuple[Head, np.ndarray]] = []
    left = np.flatnonzero(sound)
    while len(left):  # frames that begin with the same head, together
        a, b = int(starts[left[0]]), int(ends[left[0]])
        try:
            head = read_head(data[a : min(b, a + 4096)].tobytes())
        except (ValueError, IndexError):
            left = left[1:]
            continue
        fits = (ends - starts)[left] >= head.size + 2
        same = fits.copy()
        same[fits] = (data[starts[left[fits]][:, None] + np.arange(head.size)] == data[a : a + head.size]).all(1)
        same[0] = True
        groups.append((head, left[same]))
        left = left[~same]
    for head, which in groups:
        if head.process == 0xC3:
            try:
                samples, ended = decode_lossless(data, starts[which], ends[which], head)
            except (ValueError, KeyError):
                continue
            if len(which) == len(starts) and ended.all():
                return samples
            for i, x, ok in zip(which.tolist(), samples, ended.tolist(), strict=True):
                out[i] = x if ok else None
        else:
            for i in which.tolist():
                try:
                    out[i] = decode_baseline(data[starts[i] : ends[i]].tobytes(), head).ravel()
                except (ValueError, KeyError, IndexError):
                    continue
    return out


# ---------------------------------------------------------------- AVI


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)


def avi(frames: list[bytes], n_bytes: int) -> bytes:
    """A RIFF AVI of motion-JPEG frames; n_bytes, the length without padding, is its comment."""
    u = lambda *x: b"".join(int(v).to_bytes(4, "little") for v in x)
    most = max(map(len, frames))
    header = _chunk(b"avih", u(1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0))
    stream = _chunk(b"strh", b"vidsMJPG" + u(0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, SIDE | SIDE << 16))
    stream += _chunk(b"strf", u(40, SIDE, SIDE, 1 | 8 << 16) + b"MJPG" + u(FRAME, 0, 0, 256, 0))
    head = _chunk(b"LIST", b"hdrl" + header + _chunk(b"LIST", b"strl" + stream)) + _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(n_bytes).encode() + b"\0"))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        own = _chunk(b"00dc", f)
        movie.append(own)
        index.append(b"00dc" + u(0x10, at, len(f)))
        at += len(own)
    body = b"AVI " + head + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(data: bytes) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """(starts, ends) of the video frames by the index, the length in the comment, microseconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    movie = index = comment = None
    micro, todo = 1_000_000 // FPS, [(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movie = at + 8
                else:
                    todo.append((at + 12, min(len(data), at + 8 + size)))
            elif name == b"avih":
                micro = int.from_bytes(data[at + 8 : at + 12], "little")
            elif name == b"ICMT":
                text = data[at + 8 : at + 8 + size].rstrip(b"\0")
                comment = int(text) if text.isdigit() else None
            elif name == b"idx1":
                size_here = min(size, len(data) - at - 8) // 16 * 16
                index = np.frombuffer(data, "<u4", size_here // 4, at + 8).reshape(-1, 4).astype(np.int64)
            at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("no frames or no index")
    index = index[np.isin(index[:, 0] & 0xFFFF0000, [int.from_bytes(b"\0\0" + x, "little") for x in (b"dc", b"db")])]
    # Offsets count from the list of frames, or, as some programs write them, from the file's start.
    base = movie if not len(index) or index[0, 2] < movie else 0
    starts = index[:, 2] + base + 8
    return starts, starts + index[:, 3], comment, micro or 1_000_000 // FPS


# ---------------------------------------------------------------- shots


def cuts(frames) -> list[int]:
    """Frames at which a new shot begins, from the histograms' differences (0 to 1); frames may differ in size."""
    n = len(frames)
    if n < 2:
        return []
    if isinstance(frames, np.ndarray):
        h = np.bincount((np.arange(n)[:, None] * BINS + (frames >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / frames.shape[1]
    else:
        h = np.stack([np.bincount(x >> 4, minlength=BINS) / len(x) for x in frames])
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    total = np.concatenate(([0.0], np.cumsum(d)))
    at = np.arange(len(d))
    low = np.maximum(0, at - WINDOW)
    mean = (total[at] - total[low]) / np.maximum(1, at - low)
    return (np.flatnonzero((d > FACTOR * mean) & (d > FLOOR)) + 1).tolist()


# ---------------------------------------------------------------- operators


def _encoded(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
    for part in chunks(batches):
        data, offsets = texts(part.column("text"))
        n = np.diff(offsets)
        frames = np.maximum(1, -(-n // FRAME))
        first = np.concatenate(([0], np.cumsum(frames)))
        padded = np.full(int(first[-1]) * FRAME, 255, np.uint8)
        padded[ragged(first[:-1] * FRAME, n)] = data
        coded = encode_frames(padded.reshape(-1, FRAME))
        yield emit(schema, doc_id=part.column("doc_id"), media=[avi(coded[a:b], k) for a, b, k in zip(first.tolist(), first[1:].tolist(), n.tolist(), strict=False)])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media (an AVI with the text's UTF-8 bytes as samples) of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, _encoded, "doc_id long, media binary")


@dataclass
class Film:
    frames: list | np.ndarray  # samples of the frames that could be decoded
    places: np.ndarray  # and their numbers among all frames
    bad: int
    n_bytes: int | None  # the length in the comment
    micro: int  # microseconds a frame

    def clips(self) -> list[dict]:
        """Shots in order; times are those of the frames' numbers, bad ones counted."""
        n = len(self.frames)
        edges = [0, *cuts(self.frames), n] if n else [0]
        place = np.append(self.places, self.places[-1] + 1 if n else 0)
        level = self.frames.mean(1) if isinstance(self.frames, np.ndarray) else [x.mean() for x in self.frames]
        return [
            {"first_frame": int(place[a]), "end_frame": int(place[b]), "start_ms": int(place[a]) * self.micro / 1000, "end_ms": int(place[b]) * self.micro / 1000, "mean_level": float(np.mean(level[a:b]))}
            for a, b in zip(edges, edges[1:], strict=False)
        ]


def _decoded(part: pa.RecordBatch) -> list[Film]:
    """Of each row its film."""
    media, none = [m or b"" for m in part.column("media").to_pylist()], np.zeros(0, np.int64)
    parsed = []
    for m in media:
        try:
            parsed.append((*parse_avi(m), 0) if m else (none, none, None, 0, 0))
        except (ValueError, IndexError):
            parsed.append((none, none, None, 0, 1))
    base = np.concatenate(([0], np.cumsum([len(m) for m in media])))
    data = np.frombuffer(b"".join(media), np.uint8)
    inside = [(p[0] >= 0) & (p[1] <= len(m)) for p, m in zip(parsed, media, strict=True)]  # an index may point beyond its own file
    starts = np.concatenate([np.where(ok, p[0] + b, -1) for p, ok, b in zip(parsed, inside, base, strict=False)])
    ends = np.concatenate([np.where(ok, p[1] + b, -1) for p, ok, b in zip(parsed, inside, base, strict=False)])
    samples = decode_frames(data, starts, ends)
    first, out = np.concatenate(([0], np.cumsum([len(p[0]) for p in parsed]))).tolist(), []
    for a, b, p in zip(first, first[1:], parsed, strict=False):
        own = frames = samples[a:b]
        places = np.arange(b - a)
        if not isinstance(own, np.ndarray):
            places = np.array([i for i, x in enumerate(own) if x is not None], np.int64)
            frames = [x for x in own if x is not None]
            if len({len(x) for x in frames}) == 1:
                frames = np.stack(frames)
        out.append(Film(frames, places, len(own) - len(places) + p[4], p[2], p[3]))
    return out


_CLIP = "first_frame:long,end_frame:long,start_ms:double,end_ms:double,mean_level:double"


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, end_frame, start_ms, end_ms, mean_level: one row per clip, from rows (doc_id, media)."""
    found = read(media).select("doc_id", F.posexplode("clips").alias("clip", "c"))
    return found.select("doc_id", F.col("clip").cast("long").alias("clip"), "c.*")


def read(media: DataFrame) -> DataFrame:
    """What is stored: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, bad_frames, clips (array of structs as in ``clips``)."""
    clip = pa.struct([("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("mean_level", pa.float64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()), ("feature", pa.string()), ("bad_frames", pa.int64()), ("clips", pa.list_(clip)),
    ])

    def run(batches):
        for part in chunks(batches, "media"):
            rows = []
            for doc_id, m, film in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), _decoded(part), strict=True):
                m, payload, found = m or b"", b"".join(x.tobytes() for x in film.frames), film.clips()
                mean = np.frombuffer(payload, np.uint8).mean() if payload else 0.0
                feature = f"frames={len(film.frames)};shots={len(found)};cuts={','.join(str(c['first_frame']) for c in found[1:])};mean={mean:.4f}"
                rows.append((doc_id, film.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, film.bad, found))
            yield emit(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_frames long"
    return map_arrow(media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")), run, f"{columns}, clips array<struct<{_CLIP}>>")


def op9_media(spark, sf_dir: str) -> DataFrame:
    return read(encode(table(spark, sf_dir, "documents")))
