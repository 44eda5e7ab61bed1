"""The sequence functions as temporary SQL functions. Their bodies are expressions, which the analyzer puts in place of the calls."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .alphabet import BYTES_TO_BASE, BYTES_TO_COMPLEMENT, BYTES_TO_HEX, CHARACTERS, COMPLEMENT_HEX, HEX
from .sequence import BYTES_TO_LETTER, SEEDED, bytes_to
from .two_bit import _DIGITS, ORDER, PAIRS, SPREAD

_BYTES = "decode(unhex('" + bytes(range(256)).hex() + "'), 'ISO-8859-1')"
_LATIN1 = "decode(s, 'ISO-8859-1')"


def _digits(s: str) -> str:
    return f"translate(decode({s}, 'ISO-8859-1'), {_BYTES}, '{BYTES_TO_HEX}')"


def _even(digits: str) -> str:
    return f"unhex(if(length({digits}) % 2 = 1, concat({digits}, '0'), {digits}))"


_TURNED = f"reverse(translate(hex(p), '{HEX}', '{COMPLEMENT_HEX}'))"
_TURN = f"unhex(if(n % 2 = 1, concat(substring({_TURNED}, 2), '0'), {_TURNED}))"
_FITS = "n in (2 * octet_length(p), 2 * octet_length(p) - 1)"

_FOUR = f"translate(decode(s, 'ISO-8859-1'), {_BYTES}, '{_DIGITS}')"


_PAIRS = "decode(unhex('" + PAIRS.encode().hex() + "'), 'ISO-8859-1')"
_PADDED = f"rpad({_FOUR}, cast(ceil(octet_length(s) / 4) as int) * 4, '0')"

_MADE = f"if(octet_length(s) = 0, '{bytes_to(SEEDED)}', translate({_LATIN1}, {_BYTES}, '{bytes_to(SEEDED)}'))"

FUNCTIONS = {
    "dna_encode_pairs": ("s BINARY", "BINARY", f"unhex(substring({_digits('s')}, 1, cast(octet_length(s) / 2 as int) * 2))"),
    "dna_encode2": ("s BINARY", "BINARY", f"unhex(translate(decode(unhex({_PADDED}), 'ISO-8859-1'), {_PAIRS}, '{HEX}'))"),
    "dna_decode2": ("p BINARY, n INT", "STRING", f"translate(substring(hex(translate(hex(p), '{HEX}', '{SPREAD}')), 1, n), '01234567', '{ORDER * 2}')"),
    "dna_base_to_bits": ("s BINARY", "INT", f"cast(substring({_FOUR}, 1, 1) as int)"),
    "dna_bits_to_base": ("b INT", "STRING", f"substring('{ORDER}', (b & 3) + 1, 1)"),
    "dna_cyclic": ("n INT", "STRING", "substring(repeat('ACGT', cast(n / 4 as int) + 1), 1, n)"),
    "dna_seeded": ("s BINARY, n INT", "STRING", f"substring(repeat({_MADE}, cast(n / if(octet_length(s) = 0, 256, octet_length(s)) as int) + 1), 1, n)"),
    "dna_valid_iupac": ("s BINARY", "STRING", f"translate({_LATIN1}, {_BYTES}, '{BYTES_TO_LETTER}')"),
    "dna_encode": ("s BINARY", "BINARY", _even(_digits("s"))),
    "dna_decode": ("p BINARY, n INT", "STRING", f"substring(translate(hex(p), '{HEX}', '{CHARACTERS}'), 1, greatest(n, 0))"),
    "dna_normalize": ("s BINARY", "STRING", f"translate({_LATIN1}, {_BYTES}, '{BYTES_TO_BASE}')"),
    "dna_revcomp": ("s BINARY", "STRING", f"reverse(translate({_LATIN1}, {_BYTES}, '{BYTES_TO_COMPLEMENT}'))"),
    "dna_revcomp_packed": ("p BINARY, n INT", "BINARY", f"if(p is null or n is null, null, if({_FITS}, {_TURN}, cast(raise_error(concat(n, ' bases don\\'t fit into ', octet_length(p), ' bytes')) as binary)))"),
    "try_dna_revcomp_packed": ("p BINARY, n INT", "BINARY", f"if({_FITS}, {_TURN}, null)"),
    "dna_complement_packed": ("p BINARY", "BINARY", f"unhex(translate(hex(p), '{HEX}', '{COMPLEMENT_HEX}'))"),
    "dna_complement_nibble": ("b INT", "INT", "(shiftleft(b, 2) | shiftright(b, 2)) & 15"),
    "dna_complement_byte": ("b INT", "INT", "shiftleft(b & 51, 2) | shiftright(b & 204, 2)"),
    "dna_base_to_nibble": ("s BINARY", "INT", f"instr('{HEX}', substring({_digits('s')}, 1, 1)) - 1"),
    "dna_nibble_to_base": ("b INT", "STRING", f"substring('{CHARACTERS}', (b & 15) + 1, 1)"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in this session; returns their names. A string argument is cast to its bytes."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
