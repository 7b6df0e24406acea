"""Cutting texts into passages and query windows at whitespace.

Texts are cut where they lie: whitespace is found in the bytes of a whole
column at once, and a passage is a slice of them. Positions count characters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.hashing import stable_hash
from corpuslab.functions.text import ASCII_WHITESPACE
from corpuslab.operators.windows import query_window_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSAGES_PER_BATCH = 20_000
_IS_GAP = np.isin(np.arange(256), [ord(char) for char in ASCII_WHITESPACE])


class _Breaks:
    """Starts of the whitespace-separated tokens of every text of a column."""

    def __init__(self, texts: pa.Array):
        self.texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(self.texts.buffers()[1], np.int64)[self.texts.offset : self.texts.offset + len(texts) + 1]
        held = self.texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[: offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        self._data, self._offsets = data, offsets
        # Characters before each byte: every byte but the later ones of a character counts.
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        gaps = np.flatnonzero(_IS_GAP[data]) + 1
        self._gaps, self._gap_chars = gaps, chars[gaps]
        self._bounds = np.searchsorted(gaps, offsets, side="right")
        self._first = chars[offsets]

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Token starts of a text in bytes and in characters, then its end; one start per whitespace."""
        low, high = self._offsets[row], self._offsets[row + 1]
        inside = slice(self._bounds[row], self._bounds[row + 1])
        in_bytes = np.concatenate(([0], self._gaps[inside] - low, [high - low]))
        in_chars = np.concatenate(([0], self._gap_chars[inside] - self._first[row], [self._first[row + 1] - self._first[row]]))
        return in_bytes, in_chars

    def cut(self, row: int, start: int, end: int) -> bytes:
        low = self._offsets[row]
        return self._data[low + start : low + end].tobytes()


def _segments(count: int, passage: int, step: int) -> int:
    """Passages of a text with ``count`` token starts."""
    return max(0, -(-(count - passage) // step)) + 1


def _ends(seg: int, count: int, passage: int, step: int) -> tuple[int, int]:
    """Which token start a passage begins at and which it ends before; ``count`` is the end of the text."""
    return seg * step, min(seg * step + passage, count)


def _step(passage: int, overlap: int) -> int:
    if passage <= overlap:
        raise ValueError("overlap must be smaller than the passage")
    return passage - overlap


def segment(
    df: DataFrame, passage: int, overlap: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Overlapping passages: ``(key, seg, left, right, passage)``.

    A passage holds ``passage`` whitespace-separated tokens and starts
    ``passage - overlap`` tokens after the one before; the last reaches to the
    end of the text. A null text is one null passage.
    """
    step = _step(passage, overlap)
    names = [key, "seg", "left", "right", "passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            breaks, known = _Breaks(batch.column(1)), batch.column(1).is_valid().to_pylist()
            rows, segs, lefts, rights, cuts = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
                columns += [pa.array(values, pa.int32()) for values in (segs, lefts, rights)]
                return pa.RecordBatch.from_arrays([*columns, pa.array(cuts, pa.binary()).cast(pa.string())], names)

            for row in range(batch.num_rows):
                in_bytes, in_chars = breaks.of(row)
                count = len(in_bytes) - 1
                for seg in range(_segments(count, passage, step)):
                    first, last = _ends(seg, count, passage, step)
                    rows.append(row)
                    segs.append(seg)
                    lefts.append(int(in_chars[first]))
                    rights.append(int(in_chars[last]) if known[row] else None)
                    cuts.append(breaks.cut(row, in_bytes[first], in_bytes[last]) if known[row] else None)
                    if len(rows) >= PASSAGES_PER_BATCH:
                        yield flush()
                        rows, segs, lefts, rights, cuts = [], [], [], [], []
            if rows:
                yield flush()

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, seg int, left int, right int, passage string"
    return df.select(key, text).mapInArrow(run, schema)


def choose_passage(
    df: DataFrame,
    max_length: int = 1024,
    passage: int = 256,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Add ``passage``: one passage picked by seeded hash for long texts, else all.

    The pick is made inside the row, without cutting the other passages.
    """
    marked = df.withColumn("passage", stable_hash(key, seed=seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            breaks, known = _Breaks(texts), texts.is_valid().to_pylist()
            cuts = []
            for row, draw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                in_bytes, in_chars = breaks.of(row)
                count = len(in_bytes) - 1
                first, last = 0, count
                if in_chars[-1] > max_length:
                    first, last = _ends(draw % _segments(count, passage, passage), count, passage, passage)
                cuts.append(breaks.cut(row, in_bytes[first], in_bytes[last]) if known[row] else None)
            columns = [*batch.columns[:-1], pa.array(cuts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    columns = [f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema if field.name != "passage"]
    return marked.select(*[name for name in df.columns if name != "passage"], "passage").mapInArrow(
        run, ", ".join([*columns, "passage string"])
    )


def query_windows(
    df: DataFrame, length: int = 100, stride: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Query windows of a fixed number of characters: ``(key, pos, window)``.

    Windows start at 0 and after each ``stride``-th whitespace, while at least
    one character is left after them. They are cut next to their text, so no
    row but the text's own holds more than a window.
    """
    return query_window_texts(df, length, stride, key, text)
