"""The two-bit comparison codec: A, C, G, T as 0 to 3, four bases a byte, everything else (U too) and the padding as A."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import BYTES, HEX
from .sequence import column, latin1

ORDER = "ACGT"
_DIGITS = "".join(str(max(0, ORDER.find(c.upper()))) if c.isascii() else "0" for c in BYTES)


#: What ``unhex`` makes of two of the digits 0 to 3, as Latin-1 characters; each stands for one hex digit.
PAIRS = "".join(chr(16 * a + b) for a in range(4) for b in range(4))
#: Characters whose own hex digits are, apart from the first one's 4, the two of each hex digit.
SPREAD = "".join(chr(64 + ord(x)) for x in PAIRS)


def encode2(seq: Column | str) -> Column:
    """Packed two-bit codes: two rounds of pairing digits, by ``unhex``."""
    size = F.ceil(F.octet_length(column(seq).cast("binary")) / 4).cast("int") * 4
    digits = F.rpad(F.translate(latin1(seq), BYTES, _DIGITS), size, F.lit("0"))
    return F.unhex(F.translate(latin1(F.unhex(digits)), PAIRS, HEX))


def decode2(packed: Column | str, n_bases: Column | str | int) -> Column:
    """Text of the first n bases."""
    n = F.lit(n_bases) if isinstance(n_bases, int) else column(n_bases)
    first = F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(0)), F.lit(2**31 - 1))).cast("int")
    return F.translate(F.substring(F.hex(F.translate(F.hex(column(packed)), HEX, SPREAD)), F.lit(1), first), "01234567", ORDER * 2)


def base_to_two_bits(base: Column | str) -> Column:
    return F.translate(F.substring(latin1(base), 1, 1), BYTES, _DIGITS).cast("int")


def two_bits_to_base(code: Column | str) -> Column:
    return F.substring(F.lit(ORDER), column(code).cast("int").bitwiseAND(F.lit(3)) + 1, F.lit(1))
