"""Sketches of the word shingles of one text, as array arithmetic.

Spark decides which texts a task sees; these functions only turn texts into
numbers.
"""

from __future__ import annotations

import numpy as np

from corpuslab.functions.rolling import scramble

# Shingles hashed by all functions of a sketch at once: keeps memory flat for very long texts.
BLOCK = 1 << 14
_LOWER = bytes(byte + 32 if 0x41 <= byte <= 0x5A else byte for byte in range(256))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words by their bytes and length."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(word) for word in words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    coded = scramble((data << np.uint64(32)) + place.astype(np.uint64))
    return scramble(np.add.reduceat(coded, starts) + lengths.astype(np.uint64))


def word_shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` neighbouring words, A-Z lowered, words between ASCII white space.

    A text of fewer words has its whole sequence as the only shingle, one
    without words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _word_hashes(words)
    width = min(size, len(hashes))
    total = np.full(len(hashes) - width + 1, np.uint64(width))
    for offset in range(width):
        total = scramble(total * _ODD + hashes[offset : offset + len(total)])
    return np.unique(total)


def digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set."""
    low = np.sum(scramble(shingles), dtype=np.uint64)
    high = np.bitwise_xor.reduce(scramble(shingles + np.uint64(1)), initial=np.uint64(len(shingles)))
    return int(low.astype(np.int64)), int(high.astype(np.int64))


def sketch(shingles: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The smallest value of each of ``size`` hash functions over the set."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    shifts = draw.integers(0, 1 << 63, size, dtype=np.uint64)
    lowest = np.full(size, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK, None]
        mixed = (part ^ shifts) * factors
        lowest = np.minimum(lowest, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return lowest


def band_hashes(lowest: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` values; equal bands at other places differ."""
    bands = lowest.reshape(-1, rows)
    total = scramble(np.arange(len(bands), dtype=np.uint64))
    for column in range(rows):
        total = scramble(total * _ODD + bands[:, column])
    return total.view(np.int64)
