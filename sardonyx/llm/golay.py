"""Keys from the perfect (23, 12) Golay code: words at most two bits apart share one.

Each 23-bit word lies within three bits of exactly one codeword.  The keys of
a word are the indices of all codewords within four bits: one where the word
is within two bits of its codeword, six where it is three bits away (its own
and the five others at distance four).  Two words that differ in at most two
bits have a codeword within four bits of both: if either is within two bits of
its codeword, that codeword; else, with both three bits from theirs, either
the first's own codeword is still near the second, or one of the five blocks
that hold the first's error has one of the differing bits left in it.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

WIDTH = 23
#: Fixed value: the code's generator polynomial, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(WIDTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; per syndrome up to six error words (-1: none)."""
    unit = np.array([_remainder(1 << b) for b in range(WIDTH)], np.int64)

    def span(bits: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for u in bits:
            out = np.concatenate([out, out ^ u])
        return out

    errors = np.full((2048, 6), -1, np.int64)
    for weight in range(4):
        for bits in combinations(range(WIDTH), weight):
            errors[int(np.bitwise_xor.reduce(unit[list(bits)])) if bits else 0, 0] = sum(1 << b for b in bits)
    filled = np.ones(2048, int)
    for bits in combinations(range(WIDTH), 4):
        s = int(unit[bits[0]] ^ unit[bits[1]] ^ unit[bits[2]] ^ unit[bits[3]])
        if int(errors[s, 0]).bit_count() == 3:
            errors[s, filled[s]] = sum(1 << b for b in bits)
            filled[s] += 1
    return span(unit[:12]), span(unit[12:]), errors


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(n, 6)`` codeword indices (12 bits) of 23-bit words, and which of them count."""
    low, high, errors = tables()
    found = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return (words[:, None] ^ found) >> 11, found >= 0
