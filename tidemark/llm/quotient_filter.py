"""Counting quotient filters over packed word-id n-grams, without loss.

A key is ``n`` word ids of ``width`` bits, one in each row of a (n, m) array. An invertible permutation
spreads the keys evenly; the top bits of the first permuted id name the shard, the next ones the quotient,
and everything else is the remainder, kept in full. A filter holds the entries of one shard in order: run
lengths per quotient in unary, remainders at fixed width, counters of one byte with an escape. No two keys
share a counter, so a filter gives back exactly what went in, and filters of a shard merge by adding up.
"""

from __future__ import annotations

import struct

import numpy as np

#: Rounds of the permutation; after two, every bit of a key reaches the shard and the quotient.
ROUNDS = 2
#: Counters from here on stand in the list of wide ones.
WIDE = 255
_HEAD = struct.Struct("<BBBBI")


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A well spread 64-bit function of each value (multiply and xor-shift; constants are odd)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def gram_hash(limbs: np.ndarray) -> np.ndarray:
    """64 bits for each key, not invertible; says where a key stands in a bitmap."""
    out = mix(limbs[0], len(limbs))
    for i in range(1, len(limbs)):
        out = mix(out ^ limbs[i], i)
    return out


def permute(limbs: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Each id in turn is xored with a function of the id before it, which undoes itself in reverse order."""
    out, mask = limbs.astype(np.uint64, copy=True), np.uint64(2**width - 1)
    steps = [(r, i) for r in range(ROUNDS) for i in range(len(out))]
    for r, i in reversed(steps) if back else steps:
        out[i] ^= mix(out[i - 1], 16 * r + i) & mask
    return out


def add_up(limbs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order, each once, with the sum of its counts."""
    if limbs.shape[1] == 0:
        return limbs, counts
    order = np.lexsort(limbs[::-1])
    limbs, counts = limbs[:, order], counts[order]
    first = np.flatnonzero(np.r_[True, (limbs[:, 1:] != limbs[:, :-1]).any(axis=0)])
    return limbs[:, first], np.add.reduceat(counts, first)


def _low_bytes(values: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` of each value in whole bytes."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _from_low_bytes(data: bytes, at: int, bits: int, m: int) -> tuple[np.ndarray, int]:
    size = -(-bits // 8)
    out = np.zeros((m, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, m * size, at).reshape(m, size)
    return out.reshape(-1).view("<u8").astype(np.uint64), at + m * size


def pack(limbs: np.ndarray, counts: np.ndarray, width: int, shard_bits: int) -> bytes:
    """One filter of permuted keys in ascending order that share their shard."""
    n, m = limbs.shape
    quotient_bits = min(max(m.bit_length() - 1, 0), width - shard_bits)
    rest = width - shard_bits - quotient_bits
    quotients = (limbs[0] >> np.uint64(rest)) & np.uint64(2**quotient_bits - 1)
    runs = np.bincount(quotients.astype(np.int64), minlength=2**quotient_bits)
    unary = np.ones(m + len(runs), np.uint8)
    unary[np.cumsum(runs) + np.arange(len(runs))] = 0
    wide = counts >= WIDE
    return b"".join([
        _HEAD.pack(n, width, shard_bits, quotient_bits, m), np.packbits(unary).tobytes(),
        _low_bytes(limbs[0] & np.uint64(2**rest - 1), rest), *(_low_bytes(x, width) for x in limbs[1:]),
        np.where(wide, WIDE, counts).astype(np.uint8).tobytes(), counts[wide].astype("<u8").tobytes(),
    ])


def unpack(data: bytes, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The permuted keys and counts of a filter."""
    n, width, shard_bits, quotient_bits, m = _HEAD.unpack_from(data)
    rest, at = width - shard_bits - quotient_bits, _HEAD.size
    size = m + 2**quotient_bits
    unary = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size)
    at += -(-size // 8)
    runs = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    limbs = np.zeros((n, m), np.uint64)
    low, at = _from_low_bytes(data, at, rest, m)
    quotients = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
    limbs[0] = (np.uint64(shard) << np.uint64(width - shard_bits) if shard_bits else np.uint64(0)) | (quotients << np.uint64(rest)) | low
    for i in range(1, n):
        limbs[i], at = _from_low_bytes(data, at, width, m)
    counts = np.frombuffer(data, np.uint8, m, at).astype(np.int64)
    counts[counts == WIDE] = np.frombuffer(data, "<u8", int((counts == WIDE).sum()), at + m)
    return limbs, counts


def merge(filters: list[bytes], shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of filters of one shard."""
    parts = [unpack(f, shard) for f in filters]
    return add_up(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]))


def by_shard(limbs: np.ndarray, counts: np.ndarray, width: int, shard_bits: int) -> list[tuple[int, bytes]]:
    """(shard, filter) of permuted keys in ascending order."""
    shards = (limbs[0] >> np.uint64(width - shard_bits)).astype(np.int64) if shard_bits else np.zeros(limbs.shape[1], np.int64)
    cuts = np.flatnonzero(np.diff(shards, prepend=-1))
    return [
        (int(shards[a]), pack(limbs[:, a:b], counts[a:b], width, shard_bits))
        for a, b in zip(cuts, [*cuts[1:], len(shards)], strict=True)
    ]
