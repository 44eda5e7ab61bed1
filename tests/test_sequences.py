"""The codec against an independent byte-by-byte model."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe import functions as H
from helixframe.functions import alphabet
from helixframe.operators import reports

CODE = {c: k for k, c in enumerate("-ACMTWYHGRSVKDBN")} | {"U": 4, ".": 0}
PARTNER = dict(zip("-ACMTWYHGRSVKDBN", "-TGKAWRDCYSBMHVN", strict=True))
LENGTHS = [0, 1, 2, 3, 15, 16, 17, 31, 32, 33, 47, 48, 49, 61, 62, 63, 64, 65, 127, 128, 129, 255, 256, 257, 511, 512, 513, 1023, 1024, 1025, 10_007]


def codes(data: bytes):
    return [CODE.get(chr(b).upper(), 0) if b < 128 else 0 for b in data]


def norm(data):
    return "".join("-ACMTWYHGRSVKDBN"[c] for c in codes(data))


def packed(data):
    c = codes(data) + [0] * (len(data) % 2)
    return bytes(a << 4 | b for a, b in zip(c[::2], c[1::2], strict=True))


def rc(data):
    return "".join(PARTNER[c] for c in reversed(norm(data)))


def samples():
    r = random.Random(3)
    iupac = b"ACGTRYSWKMBDHVN-acgtryswkmbdhvn.Uu"
    rows = [bytes(r.choice(iupac) for _ in range(n)) for n in LENGTHS] + [bytes(r.randrange(256) for _ in range(n)) for n in LENGTHS]
    return rows + [x.encode() for x in ("é", "ſ", "ß", "A\nC", "AC.GT", "ACXZGT", "AC GT", "A1C2G3T4", "ACGU", "日本")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(samples())], "id int, seq binary").cache()


def test_native_equals_model(table):
    x = table.select("id", "seq", H.encode4("seq").alias("p"), F.octet_length("seq").alias("n"))
    x = x.select(
        "*", H.decode4("p", "n").alias("d"), H.normalize("seq").alias("norm"), H.reverse_complement("seq").alias("rc"), H.reverse_complement_packed("p", "n").alias("rcp"),
        H.complement_packed("p").alias("cp"), H.encode4_pairs("seq").alias("pairs"),
    )
    for r in x.collect():
        s = bytes(r.seq)
        assert (bytes(r.p), r.d, r.norm, r.rc) == (packed(s), norm(s), norm(s), rc(s))
        assert bytes(r.rcp) == packed(rc(s).encode()) and bytes(r.pairs) == packed(s[: len(s) // 2 * 2])
        assert bytes(r.cp) == packed("".join(PARTNER[c] for c in norm(s)).encode())


def test_arrow_equals_native(table):
    x = table.union(table.limit(1).select("id", F.lit(None).cast("binary"))).withColumn("n", F.octet_length("seq")).withColumn("p", H.encode4("seq"))
    for native, arrow in (
        (H.encode4("seq"), H.encode4_arrow("seq")), (H.decode4("p", "n"), H.decode4_arrow("p", "n")), (H.reverse_complement("seq"), H.reverse_complement_arrow("seq")),
        (H.reverse_complement_packed("p", "n"), H.reverse_complement_packed_arrow("p", "n")),
    ):
        assert x.withColumn("a", arrow).withColumn("b", native).where("not (a <=> b)").count() == 0


def two_bit(data):
    c = ["ACGT".find(chr(b).upper()) for b in data]
    c = [max(0, x) for x in c] + [0] * (-len(data) % 4)
    return bytes(c[i] << 6 | c[i + 1] << 4 | c[i + 2] << 2 | c[i + 3] for i in range(0, len(c), 4))


def seeded(seed, n, alphabet):
    return "".join(alphabet[(seed[i % len(seed)] if seed else i % 256) % len(alphabet)] for i in range(n))


def valid(data):
    return "".join(c.lower() if b >> 7 else c for b, c in ((b, "ACGTURYSWKMBDHVN"[b & 15]) for b in data))


def test_generators_equal_model(spark, table):
    """Each byte of every value, empty and short seeds, lengths below 1, null in and null out; in SQL the same."""
    H.register(spark)
    lengths = spark.createDataFrame([(-3,), (0,), (1,), (7,), (600,), (None,)], "k int")
    x = table.union(table.limit(1).select("id", F.lit(None).cast("binary"))).where("seq is null or octet_length(seq) < 700").union(spark.createDataFrame([(-1, bytearray(range(256)))], "id int, seq binary")).crossJoin(lengths)
    x = x.select("seq", "k", H.valid_iupac_sequence("seq").alias("v"), F.expr("dna_valid_iupac(seq)").alias("vs"), H.seeded_sequence("seq", "k").alias("m"), F.expr("dna_seeded(seq, k)").alias("ms"), H.seeded_sequence("seq", "k", "xyz").alias("three"))
    rows = x.collect()
    assert any(r.seq is None for r in rows) and any(r.seq is not None and not len(r.seq) for r in rows)
    for r in rows:
        s = None if r.seq is None else bytes(r.seq)
        assert r.v == r.vs == (None if s is None else valid(s))
        of = lambda alphabet: None if s is None or r.k is None else seeded(s, r.k, alphabet)  # noqa: E731, B023
        assert r.m == r.ms == of("ACGTRYSWKMBDHVN-") and r.three == of("xyz")


def test_codecs_and_generators_evaluate_no_lambda(spark, table):
    """Lambdas and lists of matches are interpreted for each character, outside of code generation."""
    H.register(spark)
    x = table.withColumn("n", F.octet_length("seq"))
    columns = {"encode2": H.encode2("seq"), "decode2": H.decode2("seq", "n"), "seeded": H.seeded_sequence("seq", "n"), "valid": H.valid_iupac_sequence("seq")}
    columns |= {f: F.expr(f) for f in ("dna_encode2(seq)", "dna_decode2(seq, n)", "dna_seeded(seq, n)", "dna_valid_iupac(seq)", "dna_encode_pairs(seq)", "dna_cyclic(n)")}
    for name, c in columns.items():
        plan = x.select(c.alias("c"))._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "regexp" not in plan, name


def test_two_bit_equals_model(spark, table):
    H.register(spark)
    x = table.union(table.limit(1).select("id", F.lit(None).cast("binary"))).withColumn("n", F.octet_length("seq")).withColumn("p", H.encode2("seq"))
    x = x.select("*", H.encode2_arrow("seq").alias("pa"), H.decode2("p", "n").alias("d"), H.decode2_arrow("p", "n").alias("da"), F.expr("dna_encode2(seq)").alias("ps"), F.expr("dna_decode2(p, n)").alias("ds"), H.decode2("p", F.lit(-1)).alias("none"), H.decode2("p", 10**6).alias("all"))
    for r in x.collect():
        if r.seq is None:
            assert r.p is r.pa is r.d is r.da is r.ps is r.ds is r.none is r["all"] is None
            continue
        s = bytes(r.seq)
        text = "".join(chr(b).upper() if chr(b).upper() in "CGT" and b < 128 else "A" for b in s)
        assert bytes(r.p) == bytes(r.pa) == bytes(r.ps) == two_bit(s)
        assert r.d == r.da == r.ds == text and r.none == "" and r["all"] == text + "A" * (-len(s) % 4)


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=60), st.integers(-2, 320))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.data_too_large])
def test_properties(spark, rows, k):
    """Any bytes: round trip, size, prefixes, either way of reverse complement, twice applied."""
    x = spark.createDataFrame([(bytearray(r),) for r in rows], "seq binary").withColumn("n", F.octet_length("seq")).withColumn("p", H.encode4("seq")).withColumn("norm", H.normalize("seq"))
    x = x.withColumn("rc", H.reverse_complement("seq")).withColumn("rcp", H.reverse_complement_packed("p", "n"))
    laws = [
        H.decode4("p", "n") == F.col("norm"), F.octet_length("p") == F.ceil(F.col("n") / 2), H.decode4("p", F.least(F.lit(k), "n")) == F.substring("norm", F.lit(1), F.greatest(F.lit(0), F.least(F.lit(k), "n"))),
        H.reverse_complement("rc") == F.col("norm"), H.decode4("rcp", "n") == F.col("rc"), H.reverse_complement_packed("rcp", "n") == F.col("p"), H.encode4("rc") == F.col("rcp"), H.encode4("norm") == F.col("p"),
        H.complement_packed(H.complement_packed("p")) == F.col("p"), H.try_reverse_complement_packed("p", F.col("n") + 2).isNull(), H.try_reverse_complement_packed("p", "n") == F.col("rcp"),
        F.length("norm") == F.col("n"), H.encode4_pairs("seq") == F.substring("p", F.lit(1), (F.col("n") / 2).cast("int")),
    ]
    broken = x.select(*(F.sum(F.when(law, 0).otherwise(1)).alias(f"law{i}") for i, law in enumerate(laws))).first()
    assert tuple(broken) == (0,) * len(laws)


@given(st.lists(st.binary(max_size=80), min_size=1, max_size=60))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_valid_sequences_come_back(spark, rows):
    x = spark.createDataFrame([(bytearray(r),) for r in rows], "data binary").withColumn("seq", H.valid_iupac_sequence("data"))
    x = x.withColumn("d", H.decode4(H.encode4("seq"), F.length("seq")))
    assert x.where((F.length("seq") != F.octet_length("data")) | (F.col("d") != F.translate(F.upper("seq"), "U", "T"))).count() == 0


def test_golden(spark):
    pairs = {"AC": "12", "GT": "84", "RY": "96", "SW": "A5", "KM": "C3", "BD": "ED", "HV": "7B", "N-": "F0", "ACGT": "1284", "": "", "A": "10", "ACG": "1280"}
    x = spark.createDataFrame(list(pairs.items()), "s string, h string")
    assert x.where(F.hex(H.encode4("s")) != F.col("h")).count() == 0
    turned = {"ACGT": "ACGT", "AACG": "CGTT", "GATTACA": "TGTAATC", "ACRYGT": "ACRYGT", "SWN": "NWS", "": ""}
    assert spark.createDataFrame(list(turned.items()), "s string, r string").where(H.reverse_complement("s") != F.col("r")).count() == 0


def test_lengths(spark):
    x = spark.sql("SELECT X'1284' AS p")
    get = lambda c: x.select(c).first()[0]
    assert [get(H.decode4("p", n)) for n in (0, 1, 3, 4, 9, -1)] == ["", "A", "ACG", "ACGT", "ACGT", ""]
    assert get(H.decode4("p", 6, pad=True)) == "ACGT\0\0"
    assert get(H.try_reverse_complement_packed("p", F.lit(5))) is None and get(H.try_reverse_complement_packed("p", F.lit(2))) is None
    assert get(H.reverse_complement_packed(F.lit(None).cast("binary"), F.lit(2))) is None
    with pytest.raises(Exception, match="don't fit"):
        get(H.reverse_complement_packed("p", F.lit(6)))


def test_tables(spark):
    assert alphabet.COMPLEMENT_HEX == "048C159D26AE37BF" and alphabet.BYTES_TO_HEX.count("0") == 222 + 2
    b = spark.range(256).select(F.col("id").cast("int").alias("b"), H.complement_byte("id").alias("c"))
    assert all(r.c == alphabet.complement(r.b >> 4) << 4 | alphabet.complement(r.b & 15) for r in b.collect())
    assert [r.bases for r in alphabet.iupac(spark).orderBy("code").collect()][15] == ["A", "C", "G", "T"]


def test_two_bit(spark):
    rows = [("ACGT", "1B", "ACGT"), ("A", "00", "A"), ("T", "C0", "T"), ("NNNN", "00", "AAAA"), ("ACGU", "18", "ACGA"), ("acgtac", "1B10", "ACGTAC"), ("", "", "")]
    x = spark.createDataFrame(rows, "s string, h string, d string")
    assert x.where((F.hex(H.encode2("s")) != F.col("h")) | (H.decode2(H.encode2("s"), F.length("s")) != F.col("d"))).count() == 0


def test_sql_functions(spark, table):
    assert "dna_encode" in H.register(spark)
    table.createOrReplaceTempView("samples")
    got = spark.sql("SELECT seq, dna_encode(seq) e, dna_decode(dna_encode(seq), octet_length(seq)) d, dna_revcomp(seq) r, dna_normalize(seq) n, dna_revcomp_packed(dna_encode(seq), octet_length(seq)) p FROM samples")
    for r in got.collect():
        s = bytes(r.seq)
        assert (bytes(r.e), r.d, r.r, r.n, bytes(r.p)) == (packed(s), norm(s), rc(s), norm(s), packed(rc(s).encode()))


def test_plan_stays_in_codegen(table):
    plan = table.select(H.encode4("seq"), H.reverse_complement("seq"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_demo(spark):
    rows = reports.demo_report(reports.demo_sequences(spark)).collect()
    assert len(rows) == 6 and all(r.verified and r.ratio == 2.0 and r.revcomp == r.revcomp_from_packed for r in rows)
