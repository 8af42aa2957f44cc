"""Hashes of words and word shingles, computed over whole buffers of text.

A word is a run of ASCII letters, digits or underscores or of bytes outside
ASCII, after lower-casing. A word's hash is a polynomial of random byte values;
a shingle's hash mixes those of its words in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
SLICE = 2 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MULTIPLIERS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(SLICE + 2, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run; ``data`` has at most SLICE bytes."""
    power, inverse = _power_tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def _hash_slice(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of at most SLICE bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = _WORD[data]
    edge = np.diff(word)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return starts, hash_runs(data, starts, ends)


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """The words' hashes of each text. Texts are joined up to a slice; a longer one is cut between words.

    A single word beyond a slice is cut too, at fixed places, so equal words
    stay equal.
    """
    batch: list[bytes] = []
    size = 0
    for text in texts:
        data = text.lower().encode()
        if batch and size + len(data) + 1 > SLICE:
            yield from _joined(batch)
            batch, size = [], 0
        if len(data) >= SLICE:
            yield _long(data)
            continue
        batch.append(data)
        size += len(data) + 1
    yield from _joined(batch)


def _joined(batch: list[bytes]) -> Iterator[np.ndarray]:
    if batch:
        starts, hashes = _hash_slice(np.frombuffer(b" ".join(batch), np.uint8))
        ends = np.cumsum([len(b) + 1 for b in batch])
        at = np.searchsorted(starts, np.concatenate([[0], ends]))
        for i in range(len(batch)):
            yield hashes[at[i] : at[i + 1]]


def _long(data: bytes) -> np.ndarray:
    array, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(array):
        end = min(at + SLICE, len(array))
        if end < len(array):
            breaks = np.nonzero(~_WORD[array[at:end]])[0]
            if len(breaks):
                end = at + int(breaks[-1]) + 1
        out.append(_hash_slice(array[at:end])[1])
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes. A text of fewer words is one shingle, a text without words has none."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mix(total + np.uint64(k)))


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
