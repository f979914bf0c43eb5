"""The binary Golay code [23, 12, 7], from its generator polynomial."""

from __future__ import annotations

from functools import cache

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words divided by the generator: their syndromes."""
    out = words.astype(np.uint32).copy()
    for k in range(22, 10, -1):
        out ^= np.where(out >> np.uint32(k) & 1, np.uint32(GENERATOR << (k - 11)), np.uint32(0)).astype(np.uint32)
    return out


@cache
def decoder() -> np.ndarray:
    """For every 23-bit word the 12-bit index of its codeword, which is the only one within 3 bits."""
    bit = 1 << np.arange(23, dtype=np.uint32)
    errors = [np.zeros(1, np.uint32), bit]
    errors.append(np.array([a | b for i, a in enumerate(bit) for b in bit[:i]], np.uint32))
    errors.append(np.array([a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j]], np.uint32))
    every = np.concatenate(errors)
    error = np.zeros(2048, np.uint32)
    error[_remainder(every)] = every
    table = np.empty(1 << 23, np.uint16)
    for start in range(0, len(table), 1 << 19):  # in parts, so that a worker never holds large temporaries
        words = np.arange(start, start + (1 << 19), dtype=np.uint32)
        table[start : start + len(words)] = (words ^ error[_remainder(words)]) >> np.uint32(11)
    return table


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: for each 23-bit word the indices of the codewords of all words within one bit of it.

    That is one key, or six; two words that differ in at most two bits share at least one.
    """
    table = decoder()
    words = words.astype(np.uint32)
    near = np.stack([words, *(words ^ np.uint32(1 << k) for k in range(23))], axis=1)
    found = np.sort(table[near], axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    row, _ = np.nonzero(first)
    return row, found[first]
