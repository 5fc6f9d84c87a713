"""CRC-32 of joined byte strings from the parts' CRC-32, as arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLY = 0xEDB88320
#: Lengths are taken in units of UNIT bytes and in digits of BITS bits.
UNIT, BITS = 4, 12


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the CRC's polynomial, bits reflected; uint32 arrays."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    out, one, poly = np.zeros_like(a), np.uint32(1), np.uint32(POLY)
    for k in range(31, -1, -1):
        out ^= b * ((a >> np.uint32(k)) & one)
        b = (b >> one) ^ (poly * (b & one))
    return out


@lru_cache
def powers() -> list[np.ndarray]:
    """For each digit of a length: what moves a CRC past so many units of bytes."""
    one = np.array([1 << 31], np.uint32)
    step, tables = np.array([1 << 30], np.uint32), []
    for _ in range((8 * UNIT).bit_length() - 1):
        step = multiply(step, step)
    for _ in range(3):
        table = one
        for _ in range(BITS):  # doubles the table: entries n.. are the first n moved by n steps
            table = np.concatenate([table, multiply(table, np.full_like(table, step[0]))])
            step = multiply(step, step)
        tables.append(table)
    return tables


def moved(crc: np.ndarray, units: np.ndarray) -> np.ndarray:
    """CRCs of parts, each as it counts in a whole that goes on for so many units after it.

    The CRC-32 of the whole is the exclusive or of its moved parts.
    """
    out, units = crc.astype(np.uint32), units.astype(np.int64)
    for k, table in enumerate(powers()):
        digit = (units >> (BITS * k)) & ((1 << BITS) - 1)
        if digit.any():
            out = multiply(table[digit], out)
    return out
