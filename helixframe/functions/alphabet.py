"""The IUPAC nucleotide alphabet as four-bit codes: a code's bits say which of A=1, C=2, G=8, T=4 a base may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The character of each code from 0 to 15, and the further characters that are read.
CHARACTERS = "-ACMTWYHGRSVKDBN"
ALIASES = {"U": "T", ".": "-"}
BITS = {"A": 1, "C": 2, "T": 4, "G": 8}
MEANINGS = ("gap", "adenine", "cytosine", "amino", "thymine", "weak", "pyrimidine", "not G", "guanine", "purine", "strong", "not T", "keto", "not C", "not A", "any")

HEX = "0123456789ABCDEF"
GAP, A, C, M, T, W, Y, H, G, R, S, V, K, D, B, N = range(16)


def complement(code: int) -> int:
    """A<->T and C<->G are two bits apart, so that a complement turns the code by two bits; higher bits of the input leak into the result as they come."""
    return (code << 2 | code >> 2) & 15


COMPLEMENT_CHARACTERS = "".join(CHARACTERS[complement(x)] for x in range(16))
COMPLEMENT_HEX = "".join(HEX[complement(x)] for x in range(16))


def code_of(byte: int) -> int:
    """The code of a byte: ASCII letters of either case, U as T, and 0 for all others."""
    c = chr(byte).upper() if byte < 128 else "-"
    return max(0, CHARACTERS.find(ALIASES.get(c, c)))


CODES = bytes(map(code_of, range(256)))
#: All bytes as Latin-1 characters, and what becomes of each under ``translate``.
BYTES = "".join(map(chr, range(256)))
BYTES_TO_HEX = "".join(HEX[x] for x in CODES)
BYTES_TO_BASE = "".join(CHARACTERS[x] for x in CODES)
BYTES_TO_COMPLEMENT = "".join(COMPLEMENT_CHARACTERS[x] for x in CODES)


def iupac(spark: SparkSession) -> DataFrame:
    """code, base, complement_code, complement_base, bases, meaning: 16 rows."""
    rows = [(x, CHARACTERS[x], complement(x), COMPLEMENT_CHARACTERS[x], [b for b, bit in sorted(BITS.items()) if x & bit], MEANINGS[x]) for x in range(16)]
    return spark.createDataFrame(rows, "code int, base string, complement_code int, complement_base string, bases array<string>, meaning string")
