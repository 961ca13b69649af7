"""Shingle sets of texts, computed for many texts at once on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < size:
        size = max(size, CHUNK_BYTES * 2)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of about CHUNK_BYTES; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield begin, raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct `width`-word shingles of each text: (hashes, bounds); text i has hashes[bounds[i]:bounds[i+1]], ascending.

    Words are runs of bytes other than ASCII white space, in lower case.  A text
    with fewer words has its whole sequence as one shingle, one without words
    none.  A shingle is known by 64 bits of hash.
    """
    texts = len(offsets) - 1
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.r_[False, word[:-1]] & ~edge[:-1]
    after = np.r_[word[1:], False] & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    owner = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(owner, minlength=texts)
    first = np.r_[0, np.cumsum(counts)]
    found_owner, found = [], []
    for length in range(1, width + 1):
        if length < width:
            at = first[:-1][counts == length]
        else:
            at = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :]) if len(owner) >= width else np.zeros(0, np.int64)
        h = np.full(len(at), length, dtype=np.uint64)
        for k in range(length):
            h = mix(h * _BASE + words[at + k])
        found.append(h)
        found_owner.append(owner[at])
    h, o = np.concatenate(found), np.concatenate(found_owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    return h, np.r_[0, np.cumsum(np.bincount(o, minlength=texts))]


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each segment (0 for empty ones), modulo 2**64."""
    totals = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=totals[1:])
    return totals[bounds[1:]] - totals[bounds[:-1]]


def digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit digest of each set, as lines of two numbers; it doesn't depend on order."""
    size = np.diff(bounds).astype(np.uint64)
    low = mix(sums_of(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds) + size)
    high = mix(sums_of(mix(hashes + np.uint64(0x14057B7EF767814F)), bounds) ^ (size << np.uint64(32)))
    return np.stack([low, high], axis=1)
