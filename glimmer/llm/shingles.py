"""Distinct word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: A-Z to lower case, white space (9-13, 32) to a blank.
FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Texts are hashed together up to about this many bytes.
BATCH_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """BASE**i and its inverse, modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(20, (n - 1).bit_length())
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, BASE))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, inverse))), dtype=np.uint64)
        return self.up[:n], self.down

    def drop(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)


_powers = _Powers()


def forget() -> None:
    """Let go of the powers: workers live on into stages that do not use them."""
    _powers.drop()


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice of bytes: a polynomial of them, from prefix sums, mixed with its length."""
    up, down = _powers.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of folded bytes."""
    blank = data == 32
    inside = np.concatenate(([True], blank, [True]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    return slice_hashes(data, starts, ends), starts


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles; of shorter texts the whole sequence; none for null or blank text."""
    out: list[np.ndarray] = []
    coded = [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
    start = 0
    while start < len(coded):
        end, n = start, 0
        while end < len(coded) and (end == start or n + len(coded[end]) < BATCH_BYTES):
            n += len(coded[end]) + 1
            end += 1
        out += _batch(coded[start:end], size)
        start = end
    return out


def _batch(coded: list[bytes], size: int) -> list[np.ndarray]:
    words, at = word_hashes(np.frombuffer(b" ".join(coded) + b" ", np.uint8))
    bounds = np.cumsum([0] + [len(c) + 1 for c in coded])
    cut = np.searchsorted(at, bounds)
    factors = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(0, np.uint64)
    if len(words) >= size:
        n = len(words) - size + 1
        whole = mix64(sum(words[k : k + n] * factors[k] for k in range(size)))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(whole[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix64(np.sum(words[a:b] * factors[: b - a], dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
