"""The values of ``hash_unit`` and ``hash_normal`` for many keys and counters at once, in NumPy."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

#: Keys hashed at once, and the longest text that is one block of the hash.
TILE, BLOCK = 16384, 55
SHIFTS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, axis=0).reshape(4, 4, 4).reshape(64)
CONSTANTS = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(words: list[np.ndarray | np.uint32], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of one block each of n rows, given as its 16 words; one that all rows share is a number."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = (7 * i) % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        f += words[g]
        f += CONSTANTS[i]
        s = SHIFTS[i]
        np.right_shift(f, np.uint32(32 - s), out=t)
        np.left_shift(f, np.uint32(s), out=f)
        np.bitwise_or(f, t, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(START[0]), b + np.uint32(START[1])


def units(texts: Sequence[str], ends: Sequence[str]) -> np.ndarray:
    """(text, end): the value in (0, 1) of 52 bits of the MD5 of each text followed by each end."""
    raw, tails = [t.encode() for t in texts], [e.encode() for e in ends]
    lengths = np.array([len(r) for r in raw], np.int64)
    out = np.empty((len(tails), len(raw)))
    for length in np.unique(lengths):
        group = np.flatnonzero(lengths == length)
        for lo in range(0, len(group), TILE):
            at = group[lo : lo + TILE]
            block = np.zeros((len(at), 64), np.uint8)
            block[:, : min(64, length)] = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), length)[:, :64]
            own = np.ascontiguousarray(block.view("<u4").T[: -(-min(64, int(length)) // 4)])
            for j, tail in enumerate(tails):
                size = int(length) + len(tail)
                if size > BLOCK:
                    out[j, at] = [(int(hashlib.md5(raw[i] + tail).hexdigest()[:13], 16) + 0.5) / 2**52 for i in at]
                    continue
                rest = np.frombuffer(bytes(int(length)) + tail + b"\x80" + bytes(BLOCK - size) + (8 * size).to_bytes(8, "little"), "<u4")
                a, b = _first_words([own[w] | rest[w] if w < len(own) else rest[w] for w in range(16)], len(at))
                out[j, at] = ((a.byteswap().astype(np.uint64) << np.uint64(20) | b.byteswap().astype(np.uint64) >> np.uint64(12)).astype(float) + 0.5) / 2**52
    return out.T


def normals(texts: Sequence[str], counters: Sequence[int], seed: int) -> np.ndarray:
    """(text, counter): the values of ``hash_normal`` with the keys of a text (joined by ``|``) and a counter."""
    u = units(texts, [f"|{s}|{k}" for k in (seed, seed + 7_919) for s in counters])
    n = len(counters)
    return np.sqrt(-2.0 * np.log(u[:, :n])) * np.cos(6.283185307179586 * u[:, n:])
