"""Rolling hashes over one text, as array arithmetic.

Spark decides which texts a task sees and moves the hashes; these functions
only turn one text into numbers. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Two odd multipliers, so that two independent 64-bit hashes name a content.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
# Positions handled at a time: keeps memory flat for very long texts.
BLOCK = 1 << 18
INDEX_BITS = 20
MAX_LENGTH = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_code_hashes: list[np.ndarray] = []


def text_codes(text: str | None, unit: str) -> np.ndarray:
    """The text as an array of bytes (``unit='bytes'``) or code points."""
    if not text:
        return np.zeros(0, dtype=np.uint8)
    if unit == "bytes":
        return np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def scramble(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (a fixed bijection)."""
    values = values + np.uint64(0x632BE59BD9B4E019)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _hash_of_code() -> np.ndarray:
    """One fixed 64-bit number per code point (bytes use the first 256)."""
    if not _code_hashes:
        _code_hashes.append(scramble(np.arange(0x110000, dtype=np.uint64)))
    return _code_hashes[0]


def _power_tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    known = _powers.get(base)
    if known is None or len(known[0]) < size:
        size = max(size, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        ups, downs = np.ones(size, np.uint64), np.ones(size, np.uint64)
        ups[1:], downs[1:] = np.uint64(base), np.uint64(inverse)
        known = (np.multiply.accumulate(ups), np.multiply.accumulate(downs))
        _powers[base] = known
    return known


class PrefixHash:
    """Hash of any slice of ``codes`` in constant time."""

    def __init__(self, codes: np.ndarray, base: int):
        ups, self._downs = _power_tables(base, len(codes) + 1)
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_hash_of_code()[codes] * ups[: len(codes)], out=self._sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return scramble((self._sums[ends] - self._sums[starts]) * self._downs[starts])

    def windows(self, size: int) -> np.ndarray:
        count = len(self._sums) - size
        return scramble((self._sums[size:] - self._sums[:count]) * self._downs[:count])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` consecutive values.

    Values are compared by their upper bits; the lower bits carry the index, so
    that the leftmost of equal values wins and one array serves for both.
    """
    mask = np.uint64((1 << INDEX_BITS) - 1)
    best = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: reach - width], best[width - reach :])
    return (best & mask).astype(np.int64)


def gram_size(length: int) -> int:
    """Length of the short grams whose minimum anchors a window."""
    return max(1, length // 2)


# ASCII whitespace as code points.
WHITESPACE = np.array([9, 10, 11, 12, 13, 32])


def query_starts(codes: np.ndarray, length: int, stride: int) -> np.ndarray:
    """Starts after each ``stride``-th whitespace, and at 0, that leave room.

    A window is used only while at least one unit is left after it.
    """
    breaks = np.concatenate(([-1], np.flatnonzero(np.isin(codes, WHITESPACE))))[::stride]
    return breaks[breaks + length + 1 < len(codes)] + 1


def _blocks(codes: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    if not 0 < length <= MAX_LENGTH:
        raise ValueError(f"window length must be between 1 and {MAX_LENGTH}")
    for at in range(0, len(codes) - length + 1, BLOCK):
        yield at, codes[at : at + BLOCK + length - 1]


def anchor_runs(codes: np.ndarray, length: int, gram: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of neighbouring windows that share their smallest gram.

    Yields arrays ``(first, last, anchor, span1, span2)``: window starts
    ``first..last`` all have the same anchoring gram, ``anchor`` is its hash
    and ``span1, span2`` name the content from the first window's start to the
    last window's end. Equal windows have equal anchors wherever they occur.
    """
    gram = gram or gram_size(length)
    for at, block in _blocks(codes, length):
        hashes = [PrefixHash(block, base) for base in BASES]
        grams = hashes[0].windows(gram)
        anchors = leftmost_minimum(grams, length - gram + 1)
        breaks = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        first = np.concatenate(([0], breaks))
        last = np.concatenate((breaks - 1, [len(anchors) - 1]))
        ends = last + length
        size = scramble((ends - first).astype(np.uint64))
        spans = [scramble(h.slices(first, ends) ^ size) for h in hashes]
        yield first + at, last + at, grams[anchors[first]], spans[0], spans[1]


def batches_of_blocks(texts: Iterator[np.ndarray], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Blocks of texts, ``(number of the text, start, codes)``, as many together as one array may hold."""
    waiting, size = [], 0
    for row, codes in enumerate(texts):
        for at, block in _blocks(codes, length):
            if waiting and size + len(block) > BLOCK:
                yield waiting
                waiting, size = [], 0
            waiting.append((row, at, block))
            size += len(block)
    if waiting:
        yield waiting


def anchored_blocks(blocks: list[tuple[int, int, np.ndarray]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of ``anchor_runs`` of several blocks at once: ``(codes, block, first, last, place, anchor)``.

    ``codes`` are all blocks one after the other; ``first``, ``last`` and
    ``place`` (of the anchor) are places in it, and ``block`` is the number of
    the block they lie in.
    """
    codes = np.concatenate([block for _, _, block in blocks])
    ends = np.cumsum([len(block) for _, _, block in blocks])
    begins = np.concatenate(([0], ends[:-1]))
    grams = PrefixHash(codes, BASES[0]).windows(gram)
    anchors = leftmost_minimum(grams, length - gram + 1)
    breaks = np.concatenate(([True], anchors[1:] != anchors[:-1]))
    breaks[begins] = True
    first = np.flatnonzero(breaks)
    block = np.searchsorted(begins, first, "right") - 1
    # Windows across two blocks are none.
    latest = ends[block] - length
    last = np.minimum(np.concatenate((first[1:], [len(anchors)])) - 1, latest)
    real = first <= latest
    first, last, block = first[real], last[real], block[real]
    place = anchors[first]
    return codes, block, first, last, place, grams[place]


def repeated(hash1: np.ndarray, hash2: np.ndarray) -> np.ndarray:
    """Whether another place has the same pair of hashes."""
    # Only places that share their lower bits with others are sorted.
    slots = (hash1 & np.uint64((1 << max(16, len(hash1).bit_length() + 2)) - 1)).astype(np.int64)
    shared = np.flatnonzero(np.bincount(slots)[slots] > 1)
    order = shared[np.argsort(hash1[shared])]
    one, two = hash1[order], hash2[order]
    if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():
        order = shared[np.lexsort((hash2[shared], hash1[shared]))]
        one, two = hash1[order], hash2[order]
    same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    found = np.zeros(len(hash1), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def windows_in(codes: np.ndarray, length: int, first: np.ndarray, last: np.ndarray):
    """``(start, hash1, hash2)`` of every window starting inside the runs."""
    for at, block in _blocks(codes, length):
        count = len(block) - length + 1
        inside = (last >= at) & (first < at + count)
        if not inside.any():
            continue
        edges = np.zeros(count + 1, np.int64)
        np.add.at(edges, np.maximum(first[inside] - at, 0), 1)
        np.add.at(edges, np.minimum(last[inside] - at + 1, count), -1)
        starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        hashes = [PrefixHash(block, base).slices(starts, starts + length) for base in BASES]
        yield starts + at, hashes[0], hashes[1]


def windows_at(codes: np.ndarray, length: int, starts: np.ndarray):
    """``(start, anchor, hash1, hash2)`` of the windows at the given starts."""
    gram = gram_size(length)
    for at, block in _blocks(codes, length):
        count = len(block) - length + 1
        here = starts[(starts >= at) & (starts < at + count)] - at
        if not len(here):
            continue
        hashes = [PrefixHash(block, base) for base in BASES]
        grams = hashes[0].windows(gram)
        anchors = grams[leftmost_minimum(grams, length - gram + 1)[here]]
        yield here + at, anchors, hashes[0].slices(here, here + length), hashes[1].slices(
            here, here + length
        )
