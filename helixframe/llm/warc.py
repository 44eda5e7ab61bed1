"""WARC archives with a two-level capture index.

``write`` makes one record per page: a response with the HTML, or a revisit that only refers to the response with the same payload. Of pages
with equal payloads of at least MIN_BYTES bytes, that with the smallest page_id is the response. Each record is a gzip member of its own, in files of
about FILE_BYTES.

The index sorts the keys (reversed host, then the rest of the URL, with the page id as the tie-breaker) into shards by range; a shard file holds
compressed blocks of BLOCK entries and, behind them, a sparse directory of the blocks' first keys. ``lookup`` sends each wanted key to its shard,
binary-searches the directory, reads that block by its byte range, and binary-searches the block; the captures found are dealt out by archive and sorted by offset, so that
each archive's records are read by their byte ranges from front to back. The only thing kept on the driver is one row per shard.

Shard (``.hxi``), integers little-endian: blocks (zlib of lines key TAB page TAB archive TAB offset TAB length), directory (zlib of JSON: archives,
first [key, page], offset, length of each block), then 8 bytes offset of the directory, 8 bytes its length, b"HXINDEX1".

Defined results: null HTML is an empty payload; a null url has the empty key and no target URI; line ends and tabs in a url are percent-encoded. Repeated rows
with the smallest id are each a response. Null page ids are kept as such; they are revisits if another id has the same payload, else responses. Extra columns are
ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunks, discard, emit, map_arrow, open_fs, put_file, salted, stored, table, work_dir

MIN_BYTES, FILE_BYTES, BLOCK, DATE, LEVEL = 0, 32_000_000, 512, "1970-01-01T00:00:00Z", 4
MAGIC, NONE = b"HXINDEX1", -(1 << 63)


def key_of(url: str = "url"):
    """Reversed host, ``)``, and what follows the host; the whole text if there is no ``://``; empty for null."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    for bad, good in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        u = F.replace(u, F.lit(bad), F.lit(good))
    host, rest = (F.regexp_extract(u, r"(?s)\A.*?://([^/?#]*)(.*)", k) for k in (1, 2))
    return F.when(F.contains(u, F.lit("://")), F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest)).otherwise(u)


# ---------------------------------------------------------------- records


def record_id(page: int | None) -> str:
    """A version-8 UUID that holds the page id."""
    x = (page or 0) & (1 << 64) - 1
    n = x >> 16 << 80 | 8 << 76 | (x >> 4 & 0xFFF) << 64 | 2 << 62 | (x & 15) << 58 | (page is None)
    h = f"{n:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(record: str) -> int | None:
    n = int(record.removeprefix("<urn:uuid:").removesuffix(">").replace("-", ""), 16)
    x = n >> 80 << 16 | (n >> 64 & 0xFFF) << 4 | n >> 58 & 15
    return None if n & 1 else x - (1 << 64) if x >> 63 else x


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {''.join(c if c not in '\t\n\r' else f'%{ord(c):02X}' for c in url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> dict:
    """Headers (lower-case names), http (its headers) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


# ---------------------------------------------------------------- writing


def _archived(batches, folder: str):
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    info = "software: helixframe\r\nformat: WARC File Format 1.1\r\n"
    info = member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-8000-8000-000000000000>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r\n".encode())
    pieces, rows, size = [info], [], len(info)

    def close():
        uri = put_file(folder, "pages", ".warc.gz", pieces)
        keys, pages, at, n = zip(*rows, strict=True)
        return emit(schema, key=list(keys), page_id=list(pages), archive=[uri] * len(rows), offset=list(at), length=list(n))

    for batch in batches:
        for part in chunks([batch], "html", 8_000_000):
            for page, url, html, key, first, many in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "key", "first", "revisit")), strict=True):
                payload = (html or "").encode()
                data = member(record(page, url, payload, base32(hashlib.sha1(payload).digest()), first, many))
                pieces.append(data)
                rows.append((key, page, size, len(data)))
                size += len(data)
                if size >= FILE_BYTES:
                    yield close()
                    pieces, rows, size = [info], [], len(info)
    if rows:
        yield close()


def _indexed(batches, folder: str, block: int):
    schema = pa.schema([("uri", pa.string()), ("first_key", pa.string()), ("first_page", pa.int64()), ("entries", pa.int64())])
    pieces, directory, held, archives, n, at = [], [], [], {}, 0, 0

    def flush():
        nonlocal at
        data = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode())
        directory.append([held[0][0], held[0][1], at, len(data)])
        pieces.append(data)
        at += len(data)
        held.clear()

    for batch in batches:
        for key, page, archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "archive", "offset", "length")), strict=True):
            held.append((key, NONE if page is None else page, archives.setdefault(archive, len(archives)), offset, length))
            n += 1
            if len(held) == block:
                flush()
    if held:
        flush()
    if n:
        top = zlib.compress(json.dumps({"archives": list(archives), "blocks": directory}).encode())
        uri = put_file(folder, "index", ".hxi", [*pieces, top, at.to_bytes(8, "little"), len(top).to_bytes(8, "little"), MAGIC])
        yield emit(schema, uri=[uri], first_key=[directory[0][0]], first_page=[directory[0][1]], entries=[n])


def write(pages: DataFrame, *, folder: str | None = None, min_bytes: int = MIN_BYTES, block: int = BLOCK, shards: int | None = None) -> DataFrame:
    """Writes archives and index; one row per shard file: uri, first_key, first_page, entries."""
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), key_of().alias("key"))
    digest = [F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("n")]
    same = rows.select("page_id", *digest).where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
    rows = salted(rows.select("*", *digest), same, ["sha1", "n"], "page_id", "left")  # a payload may have a third of all pages
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    entries = stored(map_arrow(rows.select("page_id", "url", "html", "key", "first", "revisit"), lambda b: _archived(b, folder), "key string, page_id long, archive string, offset long, length long"), spark, "captures")
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = entries.repartitionByRange(n, "key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", F.col("page_id").asc_nulls_first(), "archive", "offset")
    shards = stored(map_arrow(dealt, lambda b: _indexed(b, folder, block), "uri string, first_key string, first_page long, entries long"), spark, "shards")
    discard(entries)
    return shards


# ---------------------------------------------------------------- reading


class Files:
    """Open files, at most 32 at a time."""

    def __init__(self):
        self.open: OrderedDict = OrderedDict()

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            fs, path = open_fs(uri)
            self.open[uri] = fs.open_input_file(path)
            if len(self.open) > 32:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        f = self.open[uri]
        if offset < 0:
            offset += f.size()
        return f.read_at(length, offset)


class Shard:
    """One shard of the index."""

    def __init__(self, files: Files, uri: str):
        self.files, self.uri = files, uri
        tail = files.read(uri, -24, 24)
        if tail[16:] != MAGIC:
            raise ValueError(f"{uri} isn't an index shard")
        top = json.loads(zlib.decompress(files.read(uri, int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little"))))
        self.archives, self.blocks = top["archives"], top["blocks"]
        self.first = [(k, p) for k, p, _, _ in self.blocks]
        self.held: tuple[int, list] = (-1, [])

    def block(self, i: int) -> list:
        if self.held[0] != i:
            lines = zlib.decompress(self.files.read(self.uri, *self.blocks[i][2:])).decode().split("\n")
            parts = (x.rsplit("\t", 4) for x in lines)
            self.held = i, [((k, int(p)), int(a), int(o), int(n)) for k, p, a, o, n in parts]
        return self.held[1]

    def find(self, key: str, page: int | None):
        """(archive, offset, length) of the captures of a key and page; with page None of all its pages."""
        low = (key, NONE if page is None else page)
        i = max(0, bisect_left(self.first, low) - 1)
        while i < len(self.blocks):
            entries = self.block(i)
            for entry in entries[bisect_left(entries, low, key=lambda x: x[0]) :]:
                if entry[0][0] != key or page is not None and entry[0][1] != page:
                    return
                yield self.archives[entry[1]], entry[2], entry[3]
            i += 1


def lookup(shards: DataFrame, wanted: DataFrame, *, whole_keys: bool = False) -> DataFrame:
    """The captures of distinct (key, page_id): key, page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    whole_keys: all captures of each key, whatever the page (a key whose captures run over several shards is looked up in each)."""
    spark = wanted.sparkSession
    order = sorted((r.first_key, r.first_page, r.uri) for r in shards.collect())  # one row per shard file
    starts, uris = [(k, p) for k, p, _ in order], [u for *_, u in order]
    shared = spark.sparkContext.broadcast((starts, uris))
    columns = "key string, page_id long"
    wanted = wanted.select("key", F.lit(None).cast("long").alias("page_id") if whole_keys else F.col("page_id")).distinct()

    def place(batches):
        starts = shared.value[0]
        schema = pa.schema([("shard", pa.int32()), ("key", pa.string()), ("page_id", pa.int64())])
        for b in batches:
            rows = []
            for key, page in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                low = max(0, bisect_right(starts, (key, NONE if page is None else page)) - 1)
                high = max(low, bisect_right(starts, (key, (1 << 63) - 1)) - 1) if whole_keys else low
                rows += [(s, key, page) for s in range(low, high + 1)]
            shard, keys, pages = zip(*rows, strict=True) if rows else ((), (), ())
            yield emit(schema, shard=list(shard), key=list(keys), page_id=list(pages))

    places = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def locate(batches):
        files, at, shard = Files(), -1, None
        for b in batches:
            out = []
            for s, key, page in () if not shared.value[1] else zip(*(b.column(c).to_pylist() for c in ("shard", "key", "page_id")), strict=True):
                if s != at:
                    at, shard = s, Shard(files, shared.value[1][s])
                out += [(key, *place) for place in shard.find(key, NONE if page is None and not whole_keys else page)]
            if out:
                yield emit(places, **dict(zip(places.names, map(list, zip(*out, strict=True)), strict=True)))

    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def fetch(batches):
        files = Files()
        for b in batches:
            out, size = [], 0
            for key, archive, offset, length in zip(*(b.column(c).to_pylist() for c in places.names), strict=True):
                r = parse(zlib.decompress(files.read(archive, offset, length), 31))
                head, response = r["headers"], r["headers"]["warc-type"] == "response"
                digest, n = head["warc-payload-digest"].removeprefix("sha1:"), int(r["http"]["content-length"])
                if response and (base32(hashlib.sha1(r["payload"]).digest()), len(r["payload"])) != (digest, n):
                    raise ValueError(f"{archive} at {offset}: the payload doesn't match its digest")
                out.append((key, page_of(head["warc-record-id"]), n, digest, head["warc-type"], None if response else page_of(head["warc-refers-to"]), r["payload"] if response else None))
                size += len(r["payload"])
                if size > 8_000_000:
                    yield emit(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))
                    out, size = [], 0
            if out:
                yield emit(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))

    n = max(1, min(len(uris), 100_000))
    placed = map_arrow(wanted, place, f"shard int, {columns}").repartition(n, "shard").sortWithinPartitions("shard", "key", F.col("page_id").asc_nulls_first())
    found = map_arrow(placed, locate, "key string, archive string, offset long, length long")
    found = found.repartition("archive").sortWithinPartitions("archive", "offset")
    return map_arrow(found, fetch, f"{columns}, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = lookup(write(pages), pages.select(key_of().alias("key"), F.col("page_id").cast("long").alias("page_id")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "key")
