"""Column functions for nucleotide sequences."""

from .arrow import decode2_arrow, decode4_arrow, encode2_arrow, encode4_arrow, reverse_complement_arrow, reverse_complement_packed_arrow
from .sequence import (
    base_to_nibble, complement_byte, complement_nibble, complement_packed, cyclic_sequence, decode4, encode4, encode4_pairs, encode4_struct, hex_to_bits,
    nibble_to_base, normalize, reverse_complement, reverse_complement_packed, seeded_sequence, try_reverse_complement_packed, valid_iupac_sequence,
)
from .sql import register
from .two_bit import base_to_two_bits, decode2, encode2, two_bits_to_base

__all__ = [
    "base_to_nibble", "base_to_two_bits", "complement_byte", "complement_nibble", "complement_packed", "cyclic_sequence", "decode2", "decode2_arrow", "decode4", "decode4_arrow", "encode2",
    "encode2_arrow", "encode4", "encode4_arrow", "encode4_pairs", "encode4_struct", "hex_to_bits", "nibble_to_base", "normalize", "register", "reverse_complement", "reverse_complement_arrow",
    "reverse_complement_packed", "reverse_complement_packed_arrow", "seeded_sequence", "try_reverse_complement_packed", "two_bits_to_base", "valid_iupac_sequence",
]
