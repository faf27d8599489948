"""Vectorised word cutting and hashing over UTF-8 bytes, for use inside Arrow tasks.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Work goes in sections of about
SECTION bytes, so memory stays bounded whatever the batch and text sizes; only a single word longer
than a section makes a section longer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SECTION = 1 << 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _tables(seed: int, size: int):
    """Random byte codes, powers of an odd base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
    steps = [np.full(size + 1, x, np.uint64) for x in (base, pow(base, -1, 2**64))]
    for step in steps:
        step[0] = 1
    powers, inverse = (np.cumprod(step, dtype=np.uint64) for step in steps)
    return codes, powers, inverse


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null gives b''."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def cut(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a buffer."""
    space = np.empty(len(buf) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def _hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    size = SECTION + (1 << 16)
    while size < len(buf) + 1:
        size *= 2
    codes, powers, inverse = _tables(seed, size)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * powers[: len(buf)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def _sections(texts: list[bytes]):
    """(index of the text, bytes) grouped to about SECTION bytes; long texts are cut at white space."""
    group, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > SECTION:
            end = _last_space(text, at)
            group.append((k, text[at:end]))
            yield group
            group, size, at = [], 0, end
        rest = text[at:] if at else text
        if size + len(rest) > SECTION and group:
            yield group
            group, size = [], 0
        group.append((k, rest))
        size += len(rest) + 1
    if group:
        yield group


def _last_space(text: bytes, at: int) -> int:
    """The end of a section from ``at``: behind its last white space, or behind the word that fills it."""
    spaces = [32, 9, 10, 11, 12, 13]
    end = max(text.rfind(bytes([c]), at, at + SECTION) for c in spaces)
    if end > at:
        return end + 1
    ends = [x for c in spaces if (x := text.find(bytes([c]), at + SECTION)) >= 0]
    return min(ends) + 1 if ends else len(text)


def word_hashes(texts: list[bytes], seeds: tuple[int, ...] = (1,), lower: bool = False, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words per text, and for each seed the 64-bit hashes of all words in order.

    lower: A-Z count as a-z. heads: also the hashes of the words' first so many bytes.
    """
    counts = np.zeros(len(texts), np.int64)
    out: list[list[np.ndarray]] = [[] for _ in (*seeds, *heads)]
    for group in _sections(texts):
        joined = b" ".join(x for _, x in group)
        buf = np.frombuffer(joined, np.uint8)
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf).astype(np.uint8)
        starts, ends = cut(buf)
        if len(starts):
            bounds = np.cumsum([len(x) + 1 for _, x in group])
            where = np.searchsorted(bounds, starts, side="right")
            counts += np.bincount(np.array([k for k, _ in group])[where], minlength=len(texts))
            for hashes, seed in zip(out, seeds):
                hashes.append(_hash(buf, starts, ends, seed))
            for hashes, size in zip(out[len(seeds) :], heads):
                hashes.append(_hash(buf, starts, np.minimum(ends, starts + size), 1))
    return counts, [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


@lru_cache(maxsize=16)
def _multipliers(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + 7919).integers(1 << 40, 1 << 62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` words, by position of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, m in enumerate(_multipliers(width, seed)):
        total += words[k : k + n] * m
    return mix(total)


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """As gram_hashes for wide windows: a rolling polynomial, in time independent of the width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 1 << max(12, int(len(words)).bit_length())
    _, powers, inverse = _tables(seed + 104729, size)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], dtype=np.uint64, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse[:n])
