"""The round-trip report and the demonstration set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complement_packed, decode4, encode4, hex_to_bits, normalize, reverse_complement, reverse_complement_packed

#: Fixed values.
DEMO = ("ACGTACGTACGTACGT", "GATCGATCGATCGATC", "ACGTRYSWKMBDHVN-", "NNNNNNNNNNNNNNNN", "ACGTACGTACGTACGTACGTACGTACGTACGT", "ATGCNNNNRYSWACGT")


def demo_sequences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DEMO, 1)), "id int, seq string")


def roundtrip_report(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The columns of ``df`` and n_bases, packed, decoded, verified, ratio (bases per packed byte; null for no bases)."""
    packed = df.withColumn("n_bases", F.octet_length(F.col(seq).cast("binary"))).withColumn("packed", encode4(seq)).withColumn("decoded", decode4("packed", "n_bases"))
    ratio = F.round(F.col("n_bases") / F.nullif(F.octet_length("packed"), F.lit(0)), 2)
    return packed.withColumn("verified", F.col("decoded") == normalize(seq)).withColumn("ratio", ratio)


def demo_report(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``roundtrip_report`` with packed data as hex and bits, complement, and reverse complement by text and by packed data."""
    out = roundtrip_report(df, seq)
    turned = reverse_complement_packed("packed", "n_bases")
    return out.withColumns({
        "packed_hex": F.lower(F.hex("packed")), "packed_bits": hex_to_bits("packed"), "complement_hex": F.lower(F.hex(complement_packed("packed"))),
        "revcomp": reverse_complement(seq), "revcomp_packed_hex": F.lower(F.hex(turned)), "revcomp_from_packed": decode4(turned, "n_bases"),
    })
