"""Harmonic packing of documents into training sequences.

A piece of length l belongs to the class ``capacity // l``; a sequence of class
j holds exactly j pieces. Documents are cut freely, so that a piece that would
leave much room in its class is cut to the length of a class instead. Tasks
fill the sequences of their classes alone; the at most j - 1 pieces of a class
that a task has left over meet in a second step, and those left over there,
fewer than a number fixed by the capacity, are packed together by first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.tokens import Encoder, vocabulary_path
from corpuslab.session import materialize

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
FULL = f"{PIECE}, kind int, task bigint, number bigint, offset bigint"
# A sequence id holds a task and a number; those of later steps lie above 2**61.
TASK_BITS, NUMBER_BITS = 31, 30


def cut_lengths(length: int, capacity: int, waste: float) -> list[int]:
    """Lengths of the pieces a document is cut into; they sum up to ``length``."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        kind = capacity // rest
        if capacity - kind * rest <= waste * capacity:
            pieces.append(rest)
            break
        pieces.append(capacity // (kind + 1))
        rest -= pieces[-1]
    return pieces


def pack_documents(
    docs: DataFrame,
    capacity: int = 1024,
    waste: float = 0.02,
    tokenizer: str | None = None,
    ranks: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    A document is its ids and one id 0. One row per piece: ``doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset``. The pieces of a
    document cover its ids once; those of a sequence are gapless from 0 and sum
    up to ``capacity`` at most. A null or empty text is the id 0 alone; a null
    key stays null; repeated rows are packed as often as they occur. Texts are
    encoded once, and only pieces (no ids) are shuffled.
    """
    tokenizer = tokenizer or vocabulary_path("byte_bpe_50k.json")
    ranks = ranks or vocabulary_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("body"))
    first = materialize(rows.mapInArrow(_fill(capacity, waste, tokenizer, ranks), FULL))
    # `number` is -1 for pieces whose sequence their task could not fill.
    done = first.filter("number >= 0")
    sequence = F.shiftleft(F.col("task"), NUMBER_BITS) + F.col("number")
    done = done.select(*_names(), sequence.alias("sequence_id"), "offset")

    # At most kind - 1 pieces of a class from a task.
    order = Window.partitionBy("kind").orderBy("task", "offset")
    open_pieces = materialize(
        first.filter("number < 0").withColumn("place", F.row_number().over(order) - 1)
    )
    counts = open_pieces.groupBy("kind").agg(F.count("*").alias("total"))
    placed = open_pieces.join(F.broadcast(counts), "kind").withColumn(
        "number", F.floor(F.col("place") / F.col("kind")).cast("bigint")
    )
    inside = Window.partitionBy("kind", "number").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))))
    full = (F.col("number") + 1) * F.col("kind") <= F.col("total")
    second = F.shiftleft(F.lit(1).cast("bigint"), TASK_BITS + NUMBER_BITS) + F.shiftleft(
        F.col("kind").cast("bigint"), NUMBER_BITS + 8
    ) + F.col("number")
    grouped = placed.filter(full).select(*_names(), second.alias("sequence_id"), "offset")

    # Fewer than `kind` pieces of each class are left, whatever the input.
    rest = placed.filter(~full).select(*_names())
    third = rest.groupBy(F.lit(0).alias("all")).applyInPandas(
        _first_fit(capacity), f"{PIECE}, sequence_id bigint, offset bigint"
    )
    return done.unionByName(grouped).unionByName(third)


def _names() -> list[str]:
    return ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def _fill(capacity: int, waste: float, tokenizer: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        task = TaskContext.get().partitionId()
        open_bins: dict[int, list[tuple]] = {}
        number = 0

        def place(rows: list[tuple], at: int) -> list[tuple]:
            out, offset = [], 0
            for row in rows:
                out.append((*row, task, at, offset))
                offset += row[2]
            return out

        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(0)).astype("<u4")
                start = 0
                for length in cut_lengths(len(ids), capacity, waste):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    kind = capacity // length
                    rows = open_bins.setdefault(kind, [])
                    rows.append((doc, start, length, crc, len(ids), kind))
                    start += length
                    if len(rows) == kind:
                        out += place(rows, number)
                        number += 1
                        open_bins[kind] = []
            yield _batch(out)
        # The order of the open pieces of a task is kept in `offset`.
        yield _batch([(*row, task, -1, at) for rows in open_bins.values() for at, row in enumerate(rows)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*_names(), "kind", "task", "number", "offset"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    types = [pa.int32() if name == "kind" else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kind) for column, kind in zip(columns, types, strict=True)], names
    )


def _first_fit(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        # One open sequence list by room left, so a piece finds its place in capacity steps at most.
        by_room: dict[int, list[int]] = {}
        used, ids, offsets = [], [], []
        for length in pieces["length"]:
            room = next((r for r in range(length, capacity + 1) if by_room.get(r)), None)
            at = by_room[room].pop() if room is not None else len(used)
            if room is None:
                used.append(0)
            ids.append(at)
            offsets.append(used[at])
            used[at] += length
            by_room.setdefault(capacity - used[at], []).append(at)
        return pieces.assign(sequence_id=np.array(ids, np.int64) + (3 << 60), offset=offsets)

    return run
