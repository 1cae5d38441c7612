"""Counting quotient filters over 64-bit fingerprints, as plain bytes.

A filter covers one block: the fingerprints that share their top `block_bits`
bits.  What is left of a fingerprint is split into a quotient and a remainder.
The remainders of one quotient form a run, sorted; runs follow each other in
order of their quotients, without empty slots.  Three bit maps go with the slots:

    occupied   one bit a quotient: does it have a run?
    run end    one bit a slot: is it the last of its run?
    digit      one bit a slot: does it hold a digit of a count, not a remainder?

A remainder seen once takes one slot.  One seen more often is followed by the
digits of its count, lowest first, in base 2^(bits of a slot).  Nothing is lost,
so a filter gives back its fingerprints and counts, and filters of any number of
quotients can be merged: their entries come out in sorted order.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBII")  # quotient bits, bytes of a slot, entries, slots


def _unpack(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = (n + 7) // 8
    return np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool), at + size


def encode(values: np.ndarray, counts: np.ndarray, block_bits: int) -> bytes:
    """A filter of sorted distinct fingerprints (uint64) of one block and their counts."""
    n = len(values)
    quotient_bits = max(0, int(n - 1).bit_length()) if n else 0
    quotient_bits = min(quotient_bits, 63 - block_bits)
    remainder_bits = 64 - block_bits - quotient_bits
    slot = (remainder_bits + 7) // 8
    low = values << np.uint64(block_bits) >> np.uint64(block_bits) if block_bits else values
    wide = remainder_bits >= 64
    quotient = np.zeros(n, np.int64) if wide else (low >> np.uint64(remainder_bits)).astype(np.int64)
    remainder = low if wide else low & np.uint64((1 << remainder_bits) - 1)

    rest = np.where(counts > 1, counts, 0).astype(np.uint64)
    digits = []
    while rest.any():
        digits.append(rest & np.uint64((1 << 8 * slot) - 1) if slot < 8 else rest)
        rest = rest >> np.uint64(8 * slot) if slot < 8 else np.zeros_like(rest)
    n_digits = np.zeros(n, np.int64)
    for k, d in enumerate(digits):
        higher = np.any(np.stack(digits[k:]) > 0, axis=0)
        n_digits += higher
    start = np.cumsum(1 + n_digits) - 1 - n_digits
    total = int(n + n_digits.sum())
    slots = np.zeros(total, np.uint64)
    is_digit = np.ones(total, bool)
    slots[start] = remainder
    is_digit[start] = False
    for k, d in enumerate(digits):
        has = n_digits > k
        slots[start[has] + 1 + k] = d[has]
    run_end = np.zeros(total, bool)
    if n:
        last = np.append(quotient[1:] != quotient[:-1], True)
        run_end[(start + n_digits)[last]] = True
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient] = True
    body = slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :slot]
    return b"".join(
        (
            _HEAD.pack(quotient_bits, slot, n, total),
            np.packbits(occupied).tobytes(),
            np.packbits(run_end).tobytes(),
            np.packbits(is_digit).tobytes(),
            body.tobytes(),
        )
    )


def decode(data: bytes, block: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    quotient_bits, slot, n, total = _HEAD.unpack_from(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    occupied, at = _unpack(data, _HEAD.size, 1 << quotient_bits)
    run_end, at = _unpack(data, at, total)
    is_digit, at = _unpack(data, at, total)
    raw = np.zeros((total, 8), np.uint8)
    raw[:, :slot] = np.frombuffer(data, np.uint8, total * slot, at).reshape(total, slot)
    slots = raw.reshape(-1).view("<u8").astype(np.uint64)
    remainder_bits = 64 - block_bits - quotient_bits
    run = np.cumsum(run_end) - run_end  # runs that ended before this slot
    first = np.flatnonzero(~is_digit)
    quotient = np.flatnonzero(occupied)[run[first]].astype(np.uint64)
    values = slots[first]
    if remainder_bits < 64:
        values = values | quotient << np.uint64(remainder_bits)
    if block_bits:
        values = values | np.uint64(block) << np.uint64(64 - block_bits)
    counts = np.ones(n, np.int64)
    at_digit = np.flatnonzero(is_digit)
    if len(at_digit):
        owner = np.searchsorted(first, at_digit) - 1
        place = at_digit - first[owner] - 1
        held = np.zeros(n, np.uint64)
        np.add.at(held, owner, slots[at_digit] << (place * 8 * slot).astype(np.uint64))
        counts[np.unique(owner)] = held[np.unique(owner)].astype(np.int64)
    return values, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of several filters with their counts added up."""
    values = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")  # merges the sorted parts
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], (np.add.reduceat(counts, first) if len(first) else counts)
