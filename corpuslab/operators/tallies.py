"""Counts of word pairs looked up for whole texts, without a row per word.

A task gathers texts in chunks. A chunk holds its different words once, as
64-bit numbers, and the texts as places in them. Every different pair of a
chunk, and every different word, is a question. Questions go to the bucket of
their code, all of a chunk and a bucket as one compressed row, where the counts
of the model lie, and come back as counts in the same order. A pair that all
texts have is asked once a chunk, so no bucket is hotter than the others.

A bucket tells words and pairs apart by a 64-bit code; the bucket itself is
taken from a second one.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import rolling
from corpuslab.operators.windows import _of_each_bucket, _units_between
from corpuslab.session import materialize

cloudpickle.register_pickle_by_value(rolling)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pairs of a chunk, and rows of a model that a task gathers before it sends them.
PAIRS_AT_ONCE = ROWS_AT_ONCE = 1 << 21
BUCKET_BITS = 11
BUCKETS = 1 << BUCKET_BITS
# Multipliers of the two codes of a pair, and what stands for the second word in the code of a single one.
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_ALONE = np.uint64(0x5851F42D4C957F2D)


def dealt(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How pairs lie in buckets: their order, their codes in it, and where each bucket begins."""
    codes = rolling.scramble(first * _ONE + second)
    shift = np.uint64(64 - BUCKET_BITS)
    buckets = rolling.scramble(first + second * _TWO) >> shift
    order = np.argsort((buckets << shift) | (codes >> np.uint64(BUCKET_BITS)), kind="stable")
    return order, codes[order], np.concatenate(([0], np.cumsum(np.bincount(buckets.astype(np.int64), minlength=BUCKETS))))


def _squeezed(numbers: np.ndarray, codec: pa.Codec) -> bytes:
    """Numbers as bytes, the lowest of all first: upper bytes are mostly equal."""
    return codec.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T), asbytes=True)


def _opened(data: bytes, size: int, kind: type, codec: pa.Codec) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(codec.decompress(data, size * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).reshape(-1)


def _steps(codes: np.ndarray) -> np.ndarray:
    return np.diff(codes, prepend=np.uint64(0))


def _summed(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different codes in order and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[starts], *(np.add.reduceat(part[order], starts) if len(starts) else part for part in counts)


def chunks(tokens: DataFrame, key: Sequence[str]) -> DataFrame:
    """Arrays of word numbers, ``(key, codes)``, as chunks of about ``PAIRS_AT_ONCE`` neighbouring pairs.

    ``(chunk, words, sizes, places, key0, ...)``: the different words, the most
    frequent first, the pairs each text has, its places in the words, and its
    key columns. Texts of more pairs are cut into pieces. Null arrays are left out.
    """
    kinds = [tokens.schema[name].dataType for name in key]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        waiting, room = [], PAIRS_AT_ONCE
        for batch in batches:
            column = batch.column(len(kinds))
            known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            offsets = column.offsets.to_numpy().astype(np.int64)
            codes = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            pairs = offsets[known + 1] - offsets[known] - 1
            known, pairs = known[pairs > 0], pairs[pairs > 0]
            pieces = -(-pairs // PAIRS_AT_ONCE)
            rows, nth = np.repeat(known, pieces), np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = offsets[rows] + nth * PAIRS_AT_ONCE
            sizes = np.minimum(np.repeat(pairs, pieces) - nth * PAIRS_AT_ONCE, PAIRS_AT_ONCE)
            ends, at = np.cumsum(sizes), 0
            while at < len(rows):
                upto = int(np.searchsorted(ends, ends[at] - sizes[at] + room, side="right"))
                if upto > at:
                    part = slice(at, upto)
                    inside, _ = _units_between(codes, starts[part], sizes[part] + 1)
                    taken = pa.array(rows[part])
                    waiting.append((inside, sizes[part], *(batch.column(i).take(taken) for i in range(len(kinds)))))
                    room -= int(sizes[part].sum())
                if upto < len(rows):
                    yield waiting
                    waiting, room = [], PAIRS_AT_ONCE
                at = upto
        if waiting:
            yield waiting

    names = ["chunk", "words", "sizes", "places", *(f"key{i}" for i in range(len(kinds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, first = pa.Codec("zstd", compression_level=1), TaskContext.get().partitionId() << 32
        for number, parts in enumerate(held(batches)):
            words, places, copies = np.unique(
                np.concatenate([part[0] for part in parts]), return_inverse=True, return_counts=True
            )
            # Small numbers for frequent words.
            order = np.argsort(-copies, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            keys = [pa.concat_arrays([part[2 + i] for part in parts]) for i in range(len(kinds))]
            sizes = np.concatenate([part[1] for part in parts])
            cells = [
                pa.array([first + number], pa.int64()),
                pa.array([words[order].tobytes()], pa.binary()),
                pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([_squeezed(rank[places], codec)], pa.binary()),
                *(pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), part) for part in keys),
            ]
            yield pa.RecordBatch.from_arrays(cells, names)

    schema = T.StructType.fromDDL("chunk bigint, words binary, sizes array<int>, places binary")
    for name, kind in zip(names[4:], kinds, strict=True):
        schema.add(name, T.ArrayType(kind))
    return tokens.select(*key, "codes").mapInArrow(run, schema)


def _opened_chunk(batch: pa.RecordBatch | pa.Table, row: int, codec: pa.Codec) -> tuple[np.ndarray, ...]:
    """Words and sizes of a chunk, and its pairs as one number each, ``first * words + second``."""
    words = np.frombuffer(batch.column("words")[row].as_py(), np.uint64)
    sizes = batch.column("sizes")[row].values.to_numpy().astype(np.int64)
    places = _opened(batch.column("places")[row].as_py(), int(sizes.sum() + len(sizes)), np.uint32, codec).astype(np.int64)
    lasts = np.cumsum(sizes + 1) - 1
    return words, sizes, np.delete(places, lasts) * len(words) + np.delete(places, lasts - sizes)


def _questions(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second words of all pairs, then all words alone."""
    return (
        np.concatenate((words[pairs // len(words)], words)),
        np.concatenate((words[pairs % len(words)], np.full(len(words), _ALONE))),
    )


def questions(packed: DataFrame) -> DataFrame:
    """``(bucket, chunk, size, codes)``: what the chunks want to know, the codes of a chunk and a bucket as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for row in range(batch.num_rows):
                words, _, pairs = _opened_chunk(batch, row, codec)
                pairs = np.sort(pairs)
                pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
                _, codes, edges = dealt(*_questions(words, pairs))
                yield _by_bucket(edges, codes, codec, chunk=batch.column("chunk")[row].as_py())

    return packed.select("chunk", "words", "sizes", "places").mapInArrow(
        run, "bucket int, chunk bigint, size int, codes binary, counts binary, seconds binary"
    )


def _by_bucket(
    edges: np.ndarray, codes: np.ndarray, codec: pa.Codec, chunk: int | None = None, counts: Sequence[np.ndarray] = ()
) -> pa.RecordBatch:
    """A row per bucket that has any of the codes."""
    some = np.flatnonzero(np.diff(edges))
    spans = [(int(edges[bucket]), int(edges[bucket + 1])) for bucket in some]
    columns = [
        pa.array(some.astype(np.int32)),
        pa.array([chunk] * len(some), pa.int64()),
        pa.array(np.diff(edges)[some].astype(np.int32)),
        pa.array([_squeezed(_steps(codes[at:upto]), codec) for at, upto in spans], pa.binary()),
    ]
    for part in counts:
        columns.append(pa.array([_squeezed(part[at:upto], codec) for at, upto in spans], pa.binary()))
    columns += [pa.nulls(len(some), pa.binary())] * (6 - len(columns))
    return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "size", "codes", "counts", "seconds"])


def packed_model(model: DataFrame) -> DataFrame:
    """Counts ``(before, word, n)`` of word numbers by bucket, as ``questions`` without a chunk.

    ``counts`` is that of a pair, or how often a word comes before another;
    ``seconds`` is how often a word comes after another.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append([column.to_numpy() for column in batch.columns])
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                yield [np.concatenate(column) for column in zip(*waiting, strict=True)]
                waiting, size = [], 0
        if size:
            yield [np.concatenate(column) for column in zip(*waiting, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for before, word, n in gathered(batches):
            before, word = before.view(np.uint64), word.view(np.uint64)
            none = np.zeros(len(n), np.int64)
            alone = _summed(np.concatenate((before, word)), np.concatenate((n, none)), np.concatenate((none, n)))
            order, codes, edges = dealt(
                np.concatenate((before, alone[0])), np.concatenate((word, np.full(len(alone[0]), _ALONE)))
            )
            counts = [np.concatenate((n, alone[1]))[order], np.concatenate((none, alone[2]))[order]]
            yield _by_bucket(edges, codes, codec, counts=counts)

    known = model.select("before", "word", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return known.mapInArrow(run, "bucket int, chunk bigint, size int, codes binary, counts binary, seconds binary")


def answers(asked: DataFrame, model: DataFrame) -> DataFrame:
    """``(chunk, bucket, size, counts, seconds)``: the counts of all that is asked, in its order, 0 where there is none."""
    names = ["chunk", "bucket", "size", "counts", "seconds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for bucket, table in _of_each_bucket(batches):
            known, wanted = [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2]], []
            for chunk, size, codes, *counts in zip(*(table.column(i).to_pylist() for i in range(1, 6)), strict=True):
                opened = np.cumsum(_opened(codes, size, np.uint64, codec))
                if chunk is None:
                    known.append([opened, *(_opened(part, size, np.int64, codec) for part in counts)])
                else:
                    wanted.append((chunk, opened))
            if not wanted:
                continue
            codes, *counts = _summed(*(np.concatenate(column) for column in zip(*known, strict=True)))
            asked_codes = np.concatenate([opened for _, opened in wanted])
            # A place behind the last code has no counts.
            at = np.searchsorted(codes, asked_codes)
            at[np.append(codes, np.uint64(0))[at] != asked_codes] = len(codes)
            found = [np.append(part, 0)[at] for part in counts]
            ends = np.cumsum([len(opened) for _, opened in wanted])
            spans = [(int(end) - len(opened), int(end)) for end, (_, opened) in zip(ends, wanted, strict=True)]
            columns = [
                pa.array([chunk for chunk, _ in wanted], pa.int64()),
                pa.array([bucket] * len(wanted), pa.int32()),
                pa.array([upto - begin for begin, upto in spans], pa.int32()),
                *(pa.array([_squeezed(part[begin:upto], codec) for begin, upto in spans], pa.binary()) for part in found),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = asked.unionByName(model).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "chunk bigint, bucket int, size int, counts binary, seconds binary")


def sums_of_pairs(
    tokens: DataFrame, model: DataFrame, key: Sequence[str], value: Callable[..., np.ndarray]
) -> DataFrame:
    """``value(n, n_before, n_word)`` of all neighbouring words of each text: ``(key, total, valued)``.

    ``tokens`` has arrays ``codes`` of word numbers, ``model`` has counts ``n``
    of pairs ``(before, word)`` of such numbers. ``total`` is the sum of all
    values of a piece of a text that are numbers and ``valued`` how many are. A
    long text has several pieces, so a key has several rows.
    """
    key = list(key)
    names = [f"key{i}" for i in range(len(key))]
    packed = materialize(chunks(tokens, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for _, table in _of_each_bucket(batches, "chunk"):
            table = table.combine_chunks()
            is_answer = pc.is_null(table.column("words"))
            whole, told = table.filter(pc.invert(is_answer)), table.filter(is_answer)
            words, sizes, pairs = _opened_chunk(whole, 0, codec)
            pairs, places = np.unique(pairs, return_inverse=True)
            order, _, edges = dealt(*_questions(words, pairs))
            found = [np.empty(len(order), np.int64) for _ in range(2)]
            answered = (told.column(name).to_pylist() for name in ("bucket", "size", "counts", "seconds"))
            for bucket, size, *parts in zip(*answered, strict=True):
                inside = order[edges[bucket] : edges[bucket + 1]]
                for into, part in zip(found, parts, strict=True):
                    into[inside] = _opened(part, size, np.int64, codec)
            n, n_before, n_word = found[0][: len(pairs)], found[0][len(pairs) :], found[1][len(pairs) :]
            values = value(n, n_before[pairs // len(words)], n_word[pairs % len(words)])[places]
            valued, starts = ~np.isnan(values), np.cumsum(sizes) - sizes
            columns = [whole.column(name).chunk(0).flatten() for name in names]
            columns.append(pa.array(np.add.reduceat(np.where(valued, values, 0.0), starts)))
            columns.append(pa.array(np.add.reduceat(valued.astype(np.int64), starts)))
            yield pa.RecordBatch.from_arrays(columns, [*names, "total", "valued"])

    told = answers(questions(packed), packed_model(model))
    met = told.unionByName(packed, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk")
    schema = T.StructType()
    for name, origin in zip(names, key, strict=True):
        schema.add(name, tokens.schema[origin].dataType)
    schema.add("total", T.DoubleType()).add("valued", T.LongType())
    scored = met.mapInArrow(run, schema)
    return scored.select(*(F.col(name).alias(origin) for name, origin in zip(names, key, strict=True)), "total", "valued")
