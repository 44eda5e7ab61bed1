"""Four-bit sequence functions of built-in expressions only, which stay within whole-stage code generation.

Sequences are bytes: a string counts as its UTF-8 bytes. Each byte becomes one Latin-1 character, so that ``translate`` works per byte; a code is one hex
digit, so that ``hex`` and ``unhex`` unpack and pack two bases a byte, the first in the high half. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import BYTES, BYTES_TO_BASE, BYTES_TO_COMPLEMENT, BYTES_TO_HEX, CHARACTERS, COMPLEMENT_HEX, HEX


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def latin1(seq: Column | str) -> Column:
    """One character per byte."""
    return F.decode(column(seq).cast("binary"), "ISO-8859-1")


def normalize(seq: Column | str) -> Column:
    """Upper-case IUPAC text: U as T, any byte that is no code as a gap."""
    return F.translate(latin1(seq), BYTES, BYTES_TO_BASE)


def encode4(seq: Column | str) -> Column:
    """Packed codes, two a byte; an odd last one has 0 in the low half."""
    digits = F.translate(latin1(seq), BYTES, BYTES_TO_HEX)
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def encode4_struct(seq: Column | str) -> Column:
    """struct(packed, n_bases), since packed data doesn't hold its length."""
    return F.struct(encode4(seq).alias("packed"), F.octet_length(column(seq).cast("binary")).alias("n_bases"))


def encode4_pairs(seq: Column | str) -> Column:
    """Packed codes of whole pairs of bases only; an odd last base is dropped."""
    digits = F.translate(latin1(seq), BYTES, BYTES_TO_HEX)
    return F.unhex(F.substring(digits, F.lit(1), (F.length(digits) / 2).cast("int") * 2))


def decode4(packed: Column | str, n_bases: Column | str | int, *, pad: bool = False) -> Column:
    """Text of the first n bases. Beyond the data it ends, or goes on in NUL characters with ``pad``; n below 1 gives empty text."""
    n = F.lit(n_bases) if isinstance(n_bases, int) else column(n_bases)
    text = F.translate(F.hex(column(packed)), HEX, CHARACTERS)
    text = F.substring(text, F.lit(1), F.greatest(n, F.lit(0)))
    return F.rpad(text, F.greatest(n, F.lit(0)), F.lit("\0")) if pad else text


def reverse_complement(seq: Column | str) -> Column:
    """Text of the other strand; equal to decoding the reverse complement of the packed sequence, without packing."""
    return F.reverse(F.translate(latin1(seq), BYTES, BYTES_TO_COMPLEMENT))


def _turned(packed: Column, n: Column, size) -> Column:
    """``size`` makes of the number of hex digits the number to give, or null. The digits are named in unconditional places only, so that generated code makes them once."""
    digits = F.hex(packed)
    turned = F.reverse(F.translate(digits, HEX, COMPLEMENT_HEX))
    return F.unhex(F.rpad(F.substring(turned, n % 2 + 1, F.length(digits)), size(F.length(digits)), F.lit("0")))


def reverse_complement_packed(packed: Column | str, n_bases: Column | str) -> Column:
    """Packed reverse complement; raises where n_bases doesn't fit the number of bytes."""
    packed, n = column(packed), column(n_bases).cast("int")
    message = lambda size: F.format_string("%s bases don't fit into %s bytes", n.cast("string"), (size / 2).cast("int").cast("string"))
    fitting = lambda size: F.when(size.isNull() | n.isNull(), F.lit(None)).when(n.isin(size, size - 1), size).otherwise(F.raise_error(message(size)).cast("int"))
    return _turned(packed, n, fitting)


def try_reverse_complement_packed(packed: Column | str, n_bases: Column | str) -> Column:
    """Like ``reverse_complement_packed``, but null where n_bases doesn't fit."""
    packed, n = column(packed), column(n_bases).cast("int")
    return _turned(packed, n, lambda size: F.when(n.isin(size, size - 1), size))


def complement_packed(packed: Column | str) -> Column:
    """Packed complement in the same order (padding stays 0)."""
    return F.unhex(F.translate(F.hex(column(packed)), HEX, COMPLEMENT_HEX))


def complement_nibble(code: Column | str) -> Column:
    """Complement of a code from 0 to 15."""
    x = column(code).cast("int")
    return F.shiftleft(x, 2).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(15))


def complement_byte(packed: Column | str) -> Column:
    """Complements of both codes of a packed byte from 0 to 255, each in its place."""
    x = column(packed).cast("int")
    return F.shiftleft(x.bitwiseAND(F.lit(0x33)), 2).bitwiseOR(F.shiftright(x.bitwiseAND(F.lit(0xCC)), 2))


def base_to_nibble(base: Column | str) -> Column:
    """Code of a text's first byte."""
    digit = F.translate(F.substring(latin1(base), 1, 1), BYTES, BYTES_TO_HEX)
    return F.instr(F.lit(HEX), digit) - F.lit(1)


def nibble_to_base(code: Column | str) -> Column:
    """Character of a code; higher bits than four are ignored."""
    return F.substring(F.lit(CHARACTERS), column(code).cast("int").bitwiseAND(F.lit(15)) + 1, F.lit(1))


def hex_to_bits(data: Column | str) -> Column:
    """Binary digits of binary data, eight to a byte, bytes separated by blanks. (A lambda: outside of code generation.)"""
    digits = F.hex(column(data))
    byte = lambda i: F.lpad(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 2), 8, "0")
    return F.when(F.length(digits) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), byte), " "))


# Generators of test sequences.


def cyclic_sequence(n: Column | str, pattern: str = "ACGT") -> Column:
    """The pattern over and over, n characters."""
    n = column(n).cast("int")
    return F.substring(F.repeat(F.lit(pattern), (n / len(pattern)).cast("int") + 1), F.lit(1), n)


#: The default alphabet of seeded sequences.
SEEDED = "ACGTRYSWKMBDHVN-"


def bytes_to(alphabet: str) -> str:
    """The character of each byte, the alphabet over and over."""
    return "".join(alphabet[x % len(alphabet)] for x in range(256))


def seeded_sequence(seed: Column | str, n: Column | str, alphabet: str = SEEDED) -> Column:
    """n characters: the i-th is the alphabet's at seed[i mod length] mod its size; an empty seed counts i itself."""
    if "\0" in alphabet:
        raise ValueError("translate can't give NUL characters")
    size, n, made = F.octet_length(column(seed).cast("binary")), column(n).cast("int"), bytes_to(alphabet)
    once = F.when(size == 0, F.lit(made)).otherwise(F.translate(latin1(seed), BYTES, made))
    return F.substring(F.repeat(once, (n / F.when(size == 0, 256).otherwise(size)).cast("int") + 1), F.lit(1), n)


#: The letters of valid sequences.
LETTERS = "ACGTURYSWKMBDHVN"
BYTES_TO_LETTER = bytes_to(LETTERS)[:128] + bytes_to(LETTERS.lower())[:128]


def valid_iupac_sequence(data: Column | str) -> Column:
    """A valid sequence from any bytes: the low half of each picks a letter or U, its highest bit the case."""
    return F.translate(latin1(data), BYTES, BYTES_TO_LETTER)
