"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds, in the order that breaks ties of start: email, ip, card, phone (the base kinds), iban, national_id. Matches are leftmost and
non-overlapping within a kind, in code points, end exclusive; a match that fails its test is dropped and its text isn't tried again.

* email: local part, ``@``, dotted domain.             * ip: four dotted numbers, each at most 255.
* card: 14 to 19 digits, single blanks or hyphens between them, confirmed by the Luhn sum.
* phone: ``+`` and 10 to 15 digits.
* iban (added): two letters, two digits, 11 to 30 letters or digits, also in blocks of four; confirmed by mod-97 = 1.
* national_id (added): ``ddd-dd-dddd``; it has no checksum, so it counts only if its score, raised by context, is at least THRESHOLD.

A base span always stays. Its score tells how sure it is: BASE per kind, raised by CONTEXT if one of the kind's context words stands within
WINDOW characters before or after it. Null and empty texts have no spans; texts are scanned whole, in linear time, whatever their length.
Each row is handled alone, so repeated rows, null ids and extra columns don't matter (``redact`` keeps extra columns).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, emit, map_arrow, reachable, table

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE_KINDS = KINDS[:4]
WINDOW, CONTEXT, THRESHOLD = 40, 0.35, 0.6
BASE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "national_id": 0.3}
WORDS = {
    "email": ("mail", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "llame"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social", "security", "id", "taxpayer"),
}
_NEARBY = {k: re.compile(r"(?i)(?<![a-z])(?:" + "|".join(map(re.escape, v)) + r")(?![a-z])") for k, v in WORDS.items()}
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The lookbehind changes no match: a match takes whole runs of digits, so the next one can't begin inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    double = "0246813579"
    return (sum(map(int, digits[-1::-2])) + sum(int(double[int(x)]) for x in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(x, 36)) for x in turned)) % 97 == 1


def emails(text: str):
    """Matches of local-part@domain, found from each ``@`` outwards: the same spans as a left-to-right scan, without its rescanning of long runs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end:  # the local part, a block at a time
            low = max(end, start - 64)
            if not (m := _LOCAL_END.search(text, low, start)):
                break
            start = m.start()
            if start > low:
                break
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score), by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    found.append((m.start(), m.end(), "phone"))
        found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
        found += [(m.start(), m.end(), "national_id") for m in _NATIONAL.finditer(text)]
    out = []
    for a, b, kind in found:
        near = _NEARBY[kind].search(text[max(0, a - WINDOW) : a]) or _NEARBY[kind].search(text[b : b + WINDOW])
        score = min(1.0, BASE[kind] + (CONTEXT if near else 0))
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((a, b, kind, score))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _find(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", kind)])
    for part in chunks(batches):
        texts = part.column("text").fill_null("").to_pylist()
        yield emit(schema, doc_id=part.column("doc_id"), spans=[[{"kind": k, "start": a, "end": b, "score": s, "value": t[a:b]} for a, b, k, s in spans(t)] for t in texts])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score, value>> of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, _find, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,value:string>>")


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their personal data replaced in ``text``; all columns stay."""
    reachable(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([redact_text(t) for t in column.to_pylist()], pa.string())

    return docs.withColumn("text", clean(F.col("text").cast("string")))


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("mean_score", pa.float64())])
    for batch in batches:
        rows = [[(x["kind"], x["start"], x["end"], x["score"]) for x in row] for row in batch.column("spans").to_pylist()]
        joined = lambda row, kinds: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in row if k in kinds)
        yield emit(
            schema, doc_id=batch.column("doc_id"), **{f"n_{k}": [sum(x[0] == k for x in row) for row in rows] for k in KINDS},
            base_sha256=[hashlib.sha256(joined(row, BASE_KINDS).encode()).hexdigest() for row in rows], spans=[joined(row, KINDS) for row in rows],
            mean_score=[sum(x[3] for x in row) / len(row) if row else None for row in rows],
        )


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of what ``find`` finds in all documents, in one pass."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, lambda batches: _digest(_find(batches)), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, mean_score double")
