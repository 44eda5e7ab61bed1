"""The registered sequence queries and the SQL that must give the same rows.

No table holds nucleotide sequences, so they are derived: MD5 digits of a line item's keys, read as the sixteen codes, 9 to 63 bases long. Arbitrary bytes
are the documents' texts.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as H
from ..functions.alphabet import CHARACTERS, COMPLEMENT_CHARACTERS, COMPLEMENT_HEX, HEX, iupac
from ..operators import benchmark_log, reports
from ..sources import sequences as io
from ..streaming import sequences as streaming


def _digits(first: str, second: str, kind: str) -> str:
    return f"translate(concat(md5(cast({first} as {kind})), md5(cast({second} as {kind}))), '0123456789abcdef', '{CHARACTERS}')"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, seq."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", F.expr(f"substr({_digits('l_orderkey', 'l_partkey', 'string')}, 1, cast(l_linenumber * 9 as int))").alias("seq"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark log made of the line items: value and the keys."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    unit = F.element_at(F.array(*map(F.lit, ("ns", "µs", "us", "ms"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    operation = F.element_at(F.array(*map(F.lit, benchmark_log.OPERATIONS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    line = F.format_string("%s/method_%d/%d  time:   [%d.25 %s %d.5 %s %d.75 %s]", operation, F.col("l_linenumber").cast("long"), F.col("l_suppkey").cast("long"), *(x for _ in range(3) for x in (F.col("l_partkey").cast("long"), unit)))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_orderkey") % 10 == 9, F.lit("Benchmarking something else")).otherwise(line).alias("value"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_log.parse(log_lines(spark, sf_dir))


# ---------------------------------------------------------------- queries

_KEYS = ("l_orderkey", "l_linenumber")


def _hex(data):
    return F.lower(F.hex(data))


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _sequence_query(**columns):
    return lambda spark, d: sequences(spark, d).select(*_KEYS, *(c().alias(n) for n, c in columns.items()))


def _document_query(**columns):
    return lambda spark, d: documents(spark, d).select("doc_id", *(c().alias(n) for n, c in columns.items()))


def _n():
    return F.octet_length(F.col("seq").cast("binary"))


def decode4_prefix(spark, d):
    k = (F.col("l_orderkey") % 70).cast("int")
    return sequences(spark, d).select(*_KEYS, k.alias("k"), H.decode4(H.encode4("seq"), k).alias("decoded"))


def decode4_padded(spark, d):
    return sequences(spark, d).select(*_KEYS, _hex(H.decode4(H.encode4("seq"), F.lit(66), pad=True)).alias("decoded_hex"))


def roundtrip_report(spark, d):
    out = reports.roundtrip_report(sequences(spark, d))
    return out.select(*_KEYS, F.col("n_bases").cast("long").alias("n"), F.octet_length("packed").cast("long").alias("packed_bytes"), "verified", "ratio")


def demo_report(spark, d):
    out = reports.demo_report(reports.demo_sequences(spark))
    return out.select("id", "seq", "packed_hex", "packed_bits", "decoded", "verified", "ratio", "complement_hex", "revcomp", "revcomp_packed_hex", "revcomp_from_packed")


def nibble_table(spark, d):
    rows = spark.range(16).select(F.col("id").cast("int").alias("code"))
    own = rows.select("code", H.nibble_to_base("code").alias("base"), H.complement_nibble("code").alias("complement_code"))
    own = own.select("*", H.nibble_to_base("complement_code").alias("complement_base"), H.base_to_nibble("base").alias("code_of_base"))
    return own.join(F.broadcast(iupac(spark).select("code", F.array_join("bases", "").alias("bases"))), "code")  # 16 rows


def byte_table(spark, d):
    rows = spark.range(256).select(F.col("id").cast("int").alias("byte"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("b"))
    return rows.select("byte", H.base_to_nibble("b").alias("code"), H.normalize("b").alias("normalized"), H.complement_byte("byte").alias("complemented"), H.base_to_two_bits("b").alias("two_bits"), H.two_bits_to_base(H.base_to_two_bits("b")).alias("two_bit_base"))


def roundtrip_laws(spark, d):
    """Rows that break a law of the codec: none."""
    x = documents(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("seq"))
    x = x.select("doc_id", "seq", H.encode4("seq").alias("p"), F.octet_length("seq").alias("n"), H.normalize("seq").alias("norm"))
    laws = {
        "decoded": H.decode4("p", "n") == F.col("norm"), "size": F.octet_length("p") == F.ceil(F.col("n") / 2), "twice": H.reverse_complement(H.reverse_complement("seq")) == F.col("norm"),
        "packed": H.decode4(H.reverse_complement_packed("p", "n"), "n") == H.reverse_complement("seq"), "length": F.length(H.reverse_complement("seq")) == F.col("n"),
    }
    return x.agg(F.count("*").alias("n_rows"), *(F.sum(F.when(law, 0).otherwise(1)).alias(f"broken_{name}") for name, law in laws.items()))


def sql_functions(spark, d):
    H.register(spark)
    sequences(spark, d).createOrReplaceTempView("helixframe_sequences")
    return spark.sql(
        "SELECT l_orderkey, l_linenumber, lower(hex(dna_encode(seq))) AS packed_hex, dna_decode(dna_encode(seq), length(seq)) AS decoded, dna_revcomp(seq) AS rc,"
        " lower(hex(dna_revcomp_packed(dna_encode(seq), length(seq)))) AS rc_hex FROM helixframe_sequences"
    )


def arrow_functions(spark, d):
    x = sequences(spark, d).select(*_KEYS, "seq", H.encode4_arrow("seq").alias("p"), F.length("seq").alias("n"))
    return x.select(*_KEYS, _hex("p").alias("packed_hex"), H.decode4_arrow("p", "n").alias("decoded"), H.reverse_complement_arrow("seq").alias("rc"), _hex(H.reverse_complement_packed_arrow("p", "n")).alias("rc_hex"))


def arrow_two_bit(spark, d):
    x = sequences(spark, d).select(*_KEYS, H.encode2_arrow("seq").alias("p"), F.length("seq").alias("n"))
    return x.select(*_KEYS, _hex("p").alias("packed_hex"), H.decode2_arrow("p", "n").alias("decoded"))


def sql_two_bit(spark, d):
    H.register(spark)
    sequences(spark, d).createOrReplaceTempView("helixframe_sequences")
    return spark.sql(
        "SELECT l_orderkey, l_linenumber, lower(hex(dna_encode2(seq))) AS packed_hex, dna_decode2(dna_encode2(seq), length(seq)) AS decoded, lower(hex(dna_encode_pairs(seq))) AS pairs_hex,"
        " dna_cyclic(cast(l_linenumber * 7 as int)) AS cyclic, dna_seeded(cast(cast(l_orderkey as string) as binary), cast(l_linenumber * 5 as int)) AS seeded,"
        " dna_valid_iupac(unhex(md5(cast(l_orderkey as string)))) AS valid FROM helixframe_sequences"
    )


def fasta_roundtrip(spark, d):
    """Written as files of records, read by the file reader."""
    name = F.concat(F.lit(">seq"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    record = F.concat(name, F.lit(" made up\n"), F.regexp_replace("seq", "(.{20})", "$1\n"))
    path = _folder(spark, "fasta")
    sequences(spark, d).select(record.alias("value")).write.text(path)
    return io.read_fasta(spark, path).select("id", "description", F.col("seq").alias("seq"), _hex(H.encode4("seq")).alias("packed_hex"))


def fastq_records(spark, d):
    """Written as files of four-line records, some of whose qualities begin like a header, and read by the file reader."""
    name = F.concat(F.lit("@r"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    quality = F.concat(F.when(F.col("l_orderkey") % 5 == 0, F.lit("@")).otherwise(F.lit("I")), F.repeat(F.lit("I"), F.length("seq") - 1))
    path = _folder(spark, "fastq")
    sequences(spark, d).select(F.concat(name, F.lit(" x\n"), F.col("seq"), F.lit("\n+\n"), quality).alias("value")).write.text(path)
    return io.read_fastq(spark, path).select("id", "description", "seq", F.length("quality").cast("long").alias("n_quality"), F.substring("quality", 1, 1).alias("first_quality"))


def packed_parquet(spark, d):
    path = _folder(spark, "packed")
    io.write_packed(sequences(spark, d), path)
    return io.read_packed(spark, path, decode=False).where("n_bases >= 36").select(*_KEYS, F.col("n_bases").cast("long").alias("n"), H.decode4("packed", "n_bases").alias("decoded"))


def stream_encode(spark, d):
    path = _folder(spark, "stream")
    events = streaming.parquet_stream(spark, f"{d}/events.parquet", f"{d}/event*.parquet")
    stream = streaming.encoded(events.select("event_id", F.expr(f"substr({_digits('event_id', 'user_id', 'string')}, 1, cast(event_id % 64 as int))").alias("seq")))
    return streaming.run_once(stream, f"{path}/out", f"{path}/state").select("event_id", F.col("n_bases").cast("long").alias("n"), _hex("packed").alias("packed_hex"), "revcomp")


def iupac_counts(spark, d):
    """How often each code occurs: what each digit's removal takes off the packed digits, in one aggregate."""
    digits = F.substring(F.hex(H.encode4("seq")), F.lit(1), F.length("seq"))
    of = lambda x: F.length("digits") - F.length(F.replace(F.col("digits"), F.lit(x), F.lit("")))
    row = sequences(spark, d).select(digits.alias("digits")).agg(*(F.sum(of(x)).alias(x) for x in HEX))
    counted = row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("code"), F.coalesce(F.col(x), F.lit(0)).alias("n")) for k, x in enumerate(HEX)))).alias("c")).select("c.*").where("n > 0")
    return counted.join(F.broadcast(iupac(spark).select("code", "base", "meaning")), "code")


def log_summary(spark, d):
    return benchmark_log.summary(results(spark, d).distinct()).select("operation", "method", "seq_length", "time_median_ns", "line")


def log_latest(spark, d):
    found = log_lines(spark, d).withColumn("at", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey"))
    matches = found.select("at", F.explode(F.regexp_extract_all("value", F.lit(benchmark_log.PATTERN), F.lit(0))).alias("m"))
    parsed = benchmark_log.split(matches, "m", "at").select("at", "operation", "method", "seq_length", "time_median_ns")
    return benchmark_log.latest(parsed, "at")


def log_csv(spark, d):
    path = _folder(spark, "csv")
    benchmark_log.write_csv(results(spark, d), path)
    return benchmark_log.read_csv(spark, path)


QUERIES = {
    "encode4": _sequence_query(n=lambda: _n().cast("long"), packed_hex=lambda: _hex(H.encode4("seq"))),
    "encode4_documents": _document_query(packed_hex=lambda: _hex(H.encode4("text"))),
    "encode4_pairs": _sequence_query(packed_hex=lambda: _hex(H.encode4_pairs("seq"))),
    "decode4_roundtrip": _sequence_query(decoded=lambda: H.decode4(H.encode4("seq"), _n())),
    "decode4_prefix": decode4_prefix,
    "decode4_padded": decode4_padded,
    "normalize_bytes": _document_query(norm=lambda: H.normalize("text")),
    "revcomp": _sequence_query(rc=lambda: H.reverse_complement("seq")),
    "revcomp_documents": _document_query(rc=lambda: H.reverse_complement("text")),
    "revcomp_packed": _sequence_query(n=lambda: _n().cast("long"), rc_hex=lambda: _hex(H.reverse_complement_packed(H.encode4("seq"), _n()))),
    "try_revcomp_packed": _sequence_query(rc_hex=lambda: _hex(H.try_reverse_complement_packed(H.encode4("seq"), F.col("l_linenumber").cast("int") * 9 - F.col("l_orderkey").cast("int") % 3))),
    "complement_packed": _sequence_query(comp_hex=lambda: _hex(H.complement_packed(H.encode4("seq")))),
    "nibble_table": nibble_table,
    "byte_table": byte_table,
    "encode2": _sequence_query(packed_hex=lambda: _hex(H.encode2("seq"))),
    "decode2": _sequence_query(decoded=lambda: H.decode2(H.encode2("seq"), _n())),
    "roundtrip_report": roundtrip_report,
    "demo_report": demo_report,
    "cyclic_sequences": _sequence_query(made=lambda: H.cyclic_sequence(F.col("l_linenumber") * 7)),
    "seeded_sequences": _sequence_query(made=lambda: H.seeded_sequence(F.col("l_orderkey").cast("string").cast("binary"), F.col("l_linenumber") * 5)),
    "valid_iupac_sequences": _sequence_query(made=lambda: H.valid_iupac_sequence(F.unhex(F.md5(F.col("l_orderkey").cast("string").cast("binary"))))),
    "roundtrip_laws": roundtrip_laws,
    "sql_functions": sql_functions,
    "arrow_functions": arrow_functions,
    "arrow_two_bit": arrow_two_bit,
    "sql_two_bit": sql_two_bit,
    "fasta_roundtrip": fasta_roundtrip,
    "fastq_records": fastq_records,
    "packed_parquet": packed_parquet,
    "stream_encode": stream_encode,
    "iupac_counts": iupac_counts,
    "log_results": results,
    "log_csv": log_csv,
    "log_overview": lambda s, d: benchmark_log.overview(results(s, d)),
    "log_throughput": lambda s, d: benchmark_log.throughput(results(s, d)).select("operation", "method", "seq_length", "throughput", "throughput_low", "throughput_high", benchmark_log.format_throughput("throughput").alias("shown")),
    "log_error_bars": lambda s, d: benchmark_log.error_bars(results(s, d)).select("operation", "method", "seq_length", "error_low", "error_high"),
    "log_summary": log_summary,
    "log_latest": log_latest,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode and reverse-complement in one projection."""
    x = sequences(spark, sf_dir).select(*_KEYS, "seq", H.encode4("seq").alias("packed"), _n().alias("n_bases"))
    return x.select(*_KEYS, "n_bases", _hex("packed").alias("packed_hex"), H.decode4("packed", "n_bases").alias("decoded"), H.reverse_complement("seq").alias("revcomp"))


# ---------------------------------------------------------------- SQL

_SEQ = f"(SELECT l_orderkey, l_linenumber, substr({_digits('l_orderkey', 'l_partkey', 'varchar')}, 1, cast(l_linenumber * 9 as int)) AS seq FROM lineitem)"
_GAPS = "regexp_replace(regexp_replace(regexp_replace({0}, '[\\x{{80}}-\\x{{7FF}}]', '--', 'g'), '[\\x{{800}}-\\x{{FFFF}}]', '---', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', '----', 'g')"
_LETTERS = "ACMTWYHGRSVKDBN"


def _clean(text: str) -> str:
    letters = _LETTERS + _LETTERS.lower()
    return f"translate(regexp_replace({_GAPS.format(text)}, '[^{letters}Uu.\\-]', '-', 'g'), '{letters}Uu.', '{_LETTERS}{_LETTERS}TT-')"


def _hexed(norm: str) -> str:
    return f"translate({norm}, '{CHARACTERS}', '{HEX.lower()}')"


def _packed(norm: str) -> str:
    d = _hexed(norm)
    return f"({d} || repeat('0', length({d}) % 2))"


def _rc(norm: str) -> str:
    return f"reverse(translate({norm}, '{CHARACTERS}', '{COMPLEMENT_CHARACTERS}'))"


def _from_sequences(columns: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, {columns} FROM {_SEQ}"


_PAIR_DIGITS = "translate(regexp_replace(seq, '[^CGT]', '0', 'g'), 'CGT', '123')"
_PADDED = f"({_PAIR_DIGITS} || repeat('0', (4 - length(seq) % 4) % 4))"
_ENCODE2 = f"array_to_string(list_transform(range(1, length({_PADDED}), 2), lambda i: substr('0123456789abcdef', 4 * cast(substr({_PADDED}, i, 1) as int) + cast(substr({_PADDED}, i + 1, 1) as int) + 1, 1)), '')"
_DECODE2 = "translate(regexp_replace(seq, '[^CGT]', 'A', 'g'), '', '')"
_VALID = (
    "array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN substr(md5(cast(l_orderkey as varchar)), cast(i * 2 + 1 as int), 1) >= '8'"
    " THEN substr('acgturyswkmbdhvn', cast(instr('0123456789abcdef', substr(md5(cast(l_orderkey as varchar)), cast(i * 2 + 2 as int), 1)) as int), 1)"
    " ELSE substr('ACGTURYSWKMBDHVN', cast(instr('0123456789abcdef', substr(md5(cast(l_orderkey as varchar)), cast(i * 2 + 2 as int), 1)) as int), 1) END), '')"
)
_SEEDED = "array_to_string(list_transform(range(0, l_linenumber * 5), lambda i: substr('ACGTRYSWKMBDHVN-', cast(ord(substr(cast(l_orderkey as varchar), cast(i % length(cast(l_orderkey as varchar)) + 1 as int), 1)) % 16 + 1 as int), 1)), '')"
_UNIT = "CASE l_orderkey % 4 WHEN 0 THEN 1 WHEN 3 THEN 1000000 ELSE 1000 END"
_RESULTS = (
    "(SELECT CASE l_partkey % 4 WHEN 0 THEN 'encode' WHEN 1 THEN 'decode' WHEN 2 THEN 'roundtrip' ELSE 'reverse_complement' END AS operation, 'method_' || l_linenumber AS method,"
    f" cast(l_suppkey as int) AS seq_length, (l_partkey + 0.25::double) * {_UNIT} AS time_low_ns, (l_partkey + 0.5::double) * {_UNIT} AS time_median_ns, (l_partkey + 0.75::double) * {_UNIT} AS time_high_ns,"
    " (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS place FROM lineitem WHERE l_orderkey % 10 != 9)"
)
_SHOWN = "CASE WHEN t >= 1e9 THEN printf('%.1f G', t / 1e9) WHEN t >= 1e6 THEN printf('%.0f M', t / 1e6) WHEN t >= 1e3 THEN printf('%.0f K', t / 1e3) ELSE printf('%.0f', t) END"
_EVENTS = f"(SELECT event_id, substr({_digits('event_id', 'user_id', 'varchar')}, 1, cast(event_id % 64 as int)) AS seq FROM events)"
_BYTE = "(SELECT i AS byte, CASE WHEN i < 128 THEN chr(i::int) ELSE '-' END AS c FROM range(256) t(i))"
_NIBBLES = f"(SELECT cast(i as int) AS code, substr('{CHARACTERS}', cast(i as int) + 1, 1) AS base, cast((i * 4 + i // 4) % 16 as int) AS complement_code FROM range(16) t(i))"
_DEMO_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(reports.DEMO, 1))
_BITS = "array_to_string(list_transform(range(1, length(packed_hex), 2), lambda i: array_to_string(list_transform([0, 1], lambda k: array_to_string(list_transform([8, 4, 2, 1], lambda b: cast((instr('0123456789abcdef', substr(packed_hex, i + k, 1)) - 1) // b % 2 as int)), '')), '')), ' ')"

ORACLE_SQL = {
    "encode4": _from_sequences(f"length(seq) AS n, {_packed('seq')} AS packed_hex"),
    "encode4_documents": f"SELECT doc_id, {_packed('norm')} AS packed_hex FROM (SELECT doc_id, {_clean('text')} AS norm FROM documents)",
    "encode4_pairs": _from_sequences(f"substr({_hexed('seq')}, 1, length(seq) // 2 * 2) AS packed_hex"),
    "decode4_roundtrip": _from_sequences("seq AS decoded"),
    "decode4_prefix": _from_sequences("cast(l_orderkey % 70 as int) AS k, substr(seq || repeat('-', length(seq) % 2), 1, cast(l_orderkey % 70 as int)) AS decoded"),
    "decode4_padded": _from_sequences("lower(hex(encode(seq || repeat('-', length(seq) % 2)))) || repeat('00', 66 - length(seq) - length(seq) % 2) AS decoded_hex"),
    "normalize_bytes": f"SELECT doc_id, {_clean('text')} AS norm FROM documents",
    "revcomp": _from_sequences(f"{_rc('seq')} AS rc"),
    "revcomp_documents": f"SELECT doc_id, {_rc(_clean('text'))} AS rc FROM documents",
    "revcomp_packed": _from_sequences(f"length(seq) AS n, {_packed(_rc('seq'))} AS rc_hex"),
    "try_revcomp_packed": _from_sequences(
        f"CASE l_orderkey % 3 WHEN 0 THEN {_packed(_rc('seq'))} WHEN 1 THEN CASE WHEN length(seq) % 2 = 0 THEN {_packed(_rc('substr(seq, 1, length(seq) - 1)'))} END END AS rc_hex"
    ),
    "complement_packed": _from_sequences(f"translate({_packed('seq')}, '{HEX.lower()}', '{COMPLEMENT_HEX.lower()}') AS comp_hex"),
    "nibble_table": f"SELECT code, base, complement_code, substr('{CHARACTERS}', complement_code + 1, 1) AS complement_base, code AS code_of_base,"
    " (CASE WHEN code % 2 = 1 THEN 'A' ELSE '' END || CASE WHEN code // 2 % 2 = 1 THEN 'C' ELSE '' END || CASE WHEN code // 8 % 2 = 1 THEN 'G' ELSE '' END || CASE WHEN code // 4 % 2 = 1 THEN 'T' ELSE '' END) AS bases"
    f" FROM {_NIBBLES}",
    "byte_table": f"SELECT cast(byte as int) AS byte, cast(instr('{CHARACTERS}', norm) - 1 as int) AS code, norm AS normalized, cast((byte & 51) * 4 + (byte & 204) // 4 as int) AS complemented,"
    " cast(greatest(instr('ACGT', upper(c)) - 1, 0) as int) AS two_bits, substr('ACGT', greatest(cast(instr('ACGT', upper(c)) as int), 1), 1) AS two_bit_base"
    f" FROM (SELECT byte, c, CASE WHEN upper(c) = 'U' THEN 'T' WHEN c != '' AND instr('{CHARACTERS}', upper(c)) > 0 THEN upper(c) ELSE '-' END AS norm FROM {_BYTE})",
    "encode2": _from_sequences(f"{_ENCODE2} AS packed_hex"),
    "decode2": _from_sequences(f"{_DECODE2} AS decoded"),
    "roundtrip_report": _from_sequences("length(seq) AS n, (length(seq) + 1) // 2 AS packed_bytes, true AS verified, round(length(seq) / ((length(seq) + 1) // 2), 2) AS ratio"),
    "demo_report": f"SELECT id, seq, packed_hex, {_BITS} AS packed_bits, seq AS decoded, true AS verified, 2.0::double AS ratio, translate(packed_hex, '{HEX.lower()}', '{COMPLEMENT_HEX.lower()}') AS complement_hex,"
    f" {_rc('seq')} AS revcomp, {_packed(_rc('seq'))} AS revcomp_packed_hex, {_rc('seq')} AS revcomp_from_packed FROM (SELECT id, seq, {_packed('seq')} AS packed_hex FROM (VALUES {_DEMO_ROWS}) t(id, seq))",
    "cyclic_sequences": "SELECT l_orderkey, l_linenumber, substr(repeat('ACGT', 20), 1, cast(l_linenumber * 7 as int)) AS made FROM lineitem",
    "seeded_sequences": f"SELECT l_orderkey, l_linenumber, {_SEEDED} AS made FROM lineitem",
    "valid_iupac_sequences": f"SELECT l_orderkey, l_linenumber, {_VALID} AS made FROM lineitem",
    "arrow_two_bit": _from_sequences(f"{_ENCODE2} AS packed_hex, {_DECODE2} AS decoded"),
    "sql_two_bit": _from_sequences(f"{_ENCODE2} AS packed_hex, {_DECODE2} AS decoded, substr({_hexed('seq')}, 1, length(seq) // 2 * 2) AS pairs_hex, substr(repeat('ACGT', 20), 1, cast(l_linenumber * 7 as int)) AS cyclic, {_SEEDED} AS seeded, {_VALID} AS valid"),
    "roundtrip_laws": "SELECT count(*) AS n_rows, 0::bigint AS broken_decoded, 0::bigint AS broken_size, 0::bigint AS broken_twice, 0::bigint AS broken_packed, 0::bigint AS broken_length FROM documents",
    "sql_functions": _from_sequences(f"{_packed('seq')} AS packed_hex, seq AS decoded, {_rc('seq')} AS rc, {_packed(_rc('seq'))} AS rc_hex"),
    "arrow_functions": _from_sequences(f"{_packed('seq')} AS packed_hex, seq AS decoded, {_rc('seq')} AS rc, {_packed(_rc('seq'))} AS rc_hex"),
    "fasta_roundtrip": f"SELECT 'seq' || l_orderkey || '.' || l_linenumber AS id, 'made up' AS description, seq, {_packed('seq')} AS packed_hex FROM {_SEQ}",
    "fastq_records": f"SELECT 'r' || l_orderkey || '.' || l_linenumber AS id, 'x' AS description, seq, length(seq) AS n_quality, CASE WHEN l_orderkey % 5 = 0 THEN '@' ELSE 'I' END AS first_quality FROM {_SEQ}",
    "packed_parquet": _from_sequences("length(seq) AS n, seq AS decoded") + " WHERE length(seq) >= 36",
    "stream_encode": f"SELECT event_id, length(seq) AS n, {_packed('seq')} AS packed_hex, {_rc('seq')} AS revcomp FROM {_EVENTS}",
    "iupac_counts": f"SELECT code, n, base, ['gap', 'adenine', 'cytosine', 'amino', 'thymine', 'weak', 'pyrimidine', 'not G', 'guanine', 'purine', 'strong', 'not T', 'keto', 'not C', 'not A', 'any'][code + 1] AS meaning"
    f" FROM (SELECT cast(instr('{CHARACTERS}', base) - 1 as int) AS code, base, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS base FROM {_SEQ}) GROUP BY base)",
    "log_results": f"SELECT operation, method, seq_length, time_low_ns, time_median_ns, time_high_ns FROM {_RESULTS}",
    "log_csv": f"SELECT operation, method, seq_length, time_low_ns, time_median_ns, time_high_ns FROM {_RESULTS}",
    "log_overview": f"SELECT string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, min(seq_length) AS min_length, max(seq_length) AS max_length, count(DISTINCT seq_length) AS n_lengths, count(*) AS n_rows FROM {_RESULTS}",
    "log_throughput": f"SELECT operation, method, seq_length, t AS throughput, throughput_low, throughput_high, {_SHOWN} AS shown FROM (SELECT operation, method, seq_length, seq_length / time_median_ns * 1e9::double AS t, seq_length / time_high_ns * 1e9::double AS throughput_low, seq_length / time_low_ns * 1e9::double AS throughput_high FROM {_RESULTS})",
    "log_error_bars": f"SELECT operation, method, seq_length, time_median_ns - time_low_ns AS error_low, time_high_ns - time_median_ns AS error_high FROM {_RESULTS}",
    "log_summary": f"SELECT operation, method, seq_length, time_median_ns, printf('    %-15s: %10.2f ns [%10.2f - %10.2f]', method, time_median_ns, time_low_ns, time_high_ns) AS line FROM (SELECT DISTINCT operation, method, seq_length, time_low_ns, time_median_ns, time_high_ns FROM {_RESULTS})",
    "log_latest": f"SELECT operation, method, seq_length, arg_max(time_median_ns, place) AS time_median_ns FROM {_RESULTS} GROUP BY operation, method, seq_length",
}
