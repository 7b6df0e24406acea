"""Sets of word shingles as 64-bit hashes, made for a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bytes hashed at once; one longer text is hashed on its own.
BLOCK = 1 << 20

_LOWER = bytes(
    32 if byte == 0x20 or 0x09 <= byte <= 0x0D else byte + 32 if 0x41 <= byte <= 0x5A else byte
    for byte in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(base: np.uint64, length: int) -> np.ndarray:
    out = np.full(length, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def blocks(texts: list, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes together."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered, split at ASCII white space) and the text each is in."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.translate(_LOWER), np.uint8)
    ends_of_texts = np.cumsum([len(text) + 1 for text in texts])
    gap = data == 32
    before = np.concatenate(([True], gap[:-1]))
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
    total = np.concatenate(
        (np.zeros(1, np.uint64), np.cumsum(codes[data] * powers(_STEP, len(data)), dtype=np.uint64))
    )
    unshift = powers(_BACK, len(data))[starts]
    words = mix((total[ends] - total[starts]) * unshift + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(ends_of_texts, starts, side="right")


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of ``size`` words.

    A text with fewer words has its whole sequence as the only shingle; one
    without words, or null, has none.
    """
    raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    odd = powers(np.uint64(0xD6E8FEB86659FD93), size + 2)
    for first, last in blocks(raw):
        words, owner = word_hashes(raw[first:last])
        bounds = np.searchsorted(owner, np.arange(last - first + 1))
        grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for offset in range(size):
            grams += words[offset : offset + len(grams)] * odd[offset + 1]
        grams = mix(grams)
        for at in range(last - first):
            low, high = bounds[at], bounds[at + 1]
            if high - low >= size:
                yield np.unique(grams[low : high - size + 1])
            elif high > low:
                whole = np.sum(words[low:high] * odd[1 : high - low + 1], dtype=np.uint64)
                yield mix(np.array([whole + np.uint64(high - low)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set."""
    low = np.sum(mix(shingles), dtype=np.uint64)
    high = np.bitwise_xor.reduce(mix(shingles + np.uint64(1)), initial=np.uint64(len(shingles)))
    return tuple(int(x) for x in np.array([low, high], np.uint64).view(np.int64))
