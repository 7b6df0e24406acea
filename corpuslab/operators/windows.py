"""From texts to rows of window hashes.

``windows`` is the plain form, one row per position. The other functions are
what deduplication uses at scale: one row per *run* of windows that share an
anchoring gram (about one row per ``length / 4`` positions), and single windows
only where a run alone cannot decide.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import rolling
from corpuslab.operators.skew import possible
from corpuslab.session import materialize

# Ship these functions with the tasks, so that executors need no installed package.
cloudpickle.register_pickle_by_value(rolling)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_BATCH = 200_000
WINDOWS_PER_BATCH = 20_000
# Runs whose windows are compared at a time; those of one anchor are taken together.
RUNS_AT_ONCE = 1 << 14
# Units whose runs a task gathers before it sends them, those of a bucket as one row.
UNITS_AT_ONCE = 1 << 23
# Buckets that anchors are dealt to, and the map of repeated anchors: 16 MB, whatever the tables hold.
BUCKET_BITS, MAP_BITS = 10, 27
BUCKETS = 1 << BUCKET_BITS


def raw(text: str, unit: str) -> Column:
    """The text as binary in which every unit has the same width."""
    return F.encode(text, "UTF-8" if unit == "bytes" else "UTF-32")


def unit_width(unit: str) -> int:
    if unit not in ("bytes", "chars"):
        raise ValueError("unit is 'bytes' or 'chars'")
    return 1 if unit == "bytes" else 4


def text_size(text: str, unit: str) -> Column:
    return (F.octet_length(text) if unit == "bytes" else F.length(text)).cast("bigint")


def windows(
    df: DataFrame, length: int, unit: str = "bytes", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every window of ``length`` units: ``(key, pos, window)``, window as binary."""
    width = unit_width(unit)
    last = text_size(text, unit) - F.lit(length)
    return (
        df.filter(last >= 0)
        .select(key, raw(text, unit).alias("raw"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("pos"))
        .select(
            key,
            "pos",
            F.substring("raw", (F.col("pos") * width + 1).cast("int"), F.lit(length * width)).alias("window"),
        )
    )


def _field_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _emit(keys: list, names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    counts = [len(part[0]) for part in parts]
    index = pa.array(np.repeat(np.arange(len(parts)), counts))
    key_array = pa.array(keys) if not isinstance(keys[0], pa.Scalar) else pa.array([k.as_py() for k in keys], keys[0].type)
    columns = [key_array.take(index)]
    for field in range(len(parts[0])):
        joined = np.concatenate([part[field] for part in parts])
        columns.append(pa.array(joined.view(np.int64) if joined.dtype == np.uint64 else joined.astype(np.int64)))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _per_text(names: list[str], work):
    """Turn ``work(row) -> arrays`` into a function on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, waiting = [], [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                for arrays in work(batch, row):
                    if not len(arrays[0]):
                        continue
                    keys.append(batch.column(0)[row])
                    parts.append(arrays)
                    waiting += len(arrays[0])
                    if waiting >= ROWS_PER_BATCH:
                        yield _emit(keys, names, parts)
                        keys, parts, waiting = [], [], 0
        if parts:
            yield _emit(keys, names, parts)

    return run


def window_runs(
    df: DataFrame, length: int, unit: str = "bytes", key: str = "doc_id", text: str = "text", gram: int | None = None
) -> DataFrame:
    """``(key, first, last, anchor, span1, span2)``: see ``rolling.anchor_runs``."""
    names = [key, "first", "last", "anchor", "span1", "span2"]

    def work(batch, row):
        yield from rolling.anchor_runs(rolling.text_codes(batch.column(1)[row].as_py(), unit), length, gram)

    schema = f"`{key}` {_field_type(df, key)}, first bigint, last bigint, anchor bigint, span1 bigint, span2 bigint"
    return df.select(key, text).mapInArrow(_per_text(names, work), schema)


def bucket_gram(length: int) -> int:
    """Length of the grams that deal runs to buckets: shorter ones give fewer runs and larger buckets."""
    return max(1, length // 3)


def _codes_of(anchors: np.ndarray) -> np.ndarray:
    """Numbers that name anchors: the upper bits are the bucket, the next 32 the place in it."""
    return rolling.scramble(anchors) >> np.uint64(32 - BUCKET_BITS)


def _groups_of_blocks(
    batches: Iterator[pa.RecordBatch], column: int, length: int, unit: str, work
) -> Iterator[list[tuple]]:
    """``work(batch, blocks)`` of blocks of texts, as many together as have ``UNITS_AT_ONCE`` units."""
    held, size = [], 0
    for batch in batches:
        texts = (rolling.text_codes(value.as_py(), unit) for value in batch.column(column))
        for blocks in rolling.batches_of_blocks(texts, length):
            held.append(work(batch, blocks))
            size += sum(len(codes) for _, _, codes in blocks)
            if size >= UNITS_AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _bucket_edges(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(bucket, from, to)`` of sorted codes."""
    edges = np.searchsorted(codes, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(32))
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        yield bucket, int(edges[bucket]), int(edges[bucket + 1])


def run_anchors(df: DataFrame, length: int, unit: str = "bytes", text: str = "text") -> DataFrame:
    """``(bucket, codes)``: the sorted codes of the anchors of all runs, those of one bucket together."""
    gram = bucket_gram(length)

    def work(batch, blocks):
        return _codes_of(rolling.anchored_blocks(blocks, length, gram)[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups_of_blocks(batches, 0, length, unit, work):
            codes = np.sort(np.concatenate(held))
            low = codes.astype(np.uint32)
            parts = [(bucket, low[at:upto].tobytes()) for bucket, at, upto in _bucket_edges(codes)]
            if parts:
                buckets, packed = zip(*parts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "codes"])

    return df.select(text).mapInArrow(run, "bucket int, codes binary")


def _of_each_bucket(batches: Iterator[pa.RecordBatch], column: str = "bucket") -> Iterator[tuple[int, pa.Table]]:
    """The rows of each bucket, which come one after the other."""
    waiting, current = [], None
    for batch in batches:
        buckets = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for at, upto in zip(edges[:-1], edges[1:], strict=True):
            if upto == at:
                continue
            if waiting and buckets[at] != current:
                yield current, pa.Table.from_batches(waiting)
                waiting = []
            current = int(buckets[at])
            waiting.append(batch.slice(at, upto - at))
    if waiting:
        yield current, pa.Table.from_batches(waiting)


def repeated_anchors(anchors: DataFrame, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """A map with a bit for every anchor of several runs, and the codes of those of over ``crowd`` runs.

    ``anchors`` is made by ``run_anchors``. The map has ``2 ** MAP_BITS`` bits
    whatever the tables hold; anchors that share a bit are only taken for
    repeated. There are at most as many crowded codes as crowds in all runs.
    """
    shift = np.uint32(32 + BUCKET_BITS - MAP_BITS)
    size = 1 << (MAP_BITS - BUCKET_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in _of_each_bucket(batches):
            codes = np.sort(np.concatenate([np.frombuffer(part.as_py(), np.uint32) for part in table.column("codes")]))
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            counts = np.diff(np.append(starts, len(codes)))
            bits = np.zeros(size, bool)
            bits[codes[starts[counts > 1]] >> shift] = True
            crowded = codes[starts[counts > crowd]].astype(np.int64) | (bucket << 32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket], pa.int32()),
                    pa.array([np.packbits(bits).tobytes()], pa.binary()),
                    pa.array([crowded], pa.list_(pa.int64())),
                ],
                ["bucket", "bits", "crowded"],
            )

    dealt = anchors.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(run, "bucket int, bits binary, crowded array<bigint>")
    bits, crowded = np.zeros((BUCKETS, size // 8), np.uint8), [np.zeros(0, np.int64)]
    for row in found.collect():
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
        crowded.append(np.array(row["crowded"], np.int64))
    return bits.reshape(-1), np.sort(np.concatenate(crowded)).view(np.uint64)


def _is_in(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each code is one of the sorted known ones."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _units_between(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, place: np.ndarray | None = None, gram: int = 0):
    """The units of all stretches one after the other, without the ``gram`` ones at ``place``, and where each ends."""
    ends = np.cumsum(sizes)
    taken = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    if gram:
        taken += gram * (taken >= np.repeat(place, sizes))
    return codes[taken], ends


def run_units(
    df: DataFrame,
    length: int,
    repeated: tuple[np.ndarray, np.ndarray],
    unit: str = "bytes",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The runs whose anchors may be ``repeated_anchors`` and are not crowded, those of one bucket together.

    ``(bucket, keys, places, befores, anchors, sizes, units)``: of each run the
    units from the start of its first window to the end of its last, without
    the anchoring gram, which is at its place, as many units after the start as
    ``before`` says, and which its hash stands for. The units of all runs of a
    row are compressed as one.
    """
    width, gram = unit_width(unit), bucket_gram(length)
    bits, crowded = repeated
    shift = np.uint64(32 + BUCKET_BITS - MAP_BITS)
    names = ["bucket", "keys", "places", "befores", "anchors", "sizes", "units"]

    def work(batch, blocks):
        codes, block, first, last, place, anchor = rolling.anchored_blocks(blocks, length, gram)
        code = _codes_of(anchor)
        at = (code >> shift).astype(np.int64)
        kept = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        kept &= ~_is_in(code, crowded)
        block, first, last, place, anchor, code = (x[kept] for x in (block, first, last, place, anchor, code))
        begins = np.cumsum([0, *(len(codes) for _, _, codes in blocks[:-1])])
        sizes = last - first + length - gram
        units, ends = _units_between(codes, first, sizes, place, gram)
        offsets = np.concatenate(([0], ends * width)).astype(np.int32)
        content = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(units.tobytes())])
        rows = np.array([row for row, _, _ in blocks])[block]
        starts = np.array([at for _, at, _ in blocks])
        return (
            code,
            batch.column(0).take(pa.array(rows, pa.int64())),
            pa.array(place - begins[block] + starts[block], pa.int64()),
            pa.array((place - first).astype(np.int32)),
            pa.array(anchor.view(np.int64)),
            pa.array(sizes.astype(np.int32)),
            content,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for held in _groups_of_blocks(batches, 1, length, unit, work):
            codes = np.concatenate([part[0] for part in held])
            order = np.argsort(codes)
            columns = [pa.concat_arrays([part[at] for part in held]).take(pa.array(order)) for at in range(1, 7)]
            edges = list(_bucket_edges(codes[order]))
            if not edges:
                continue
            offsets = pa.array([at for _, at, _ in edges] + [len(codes)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, column) for column in columns[:5]]
            ends, data = _binary_parts(columns[5])
            packed = [codec.compress(data[ends[at] : ends[upto]], asbytes=True) for _, at, upto in edges]
            buckets = pa.array([bucket for bucket, _, _ in edges], pa.int32())
            yield pa.RecordBatch.from_arrays([buckets, *lists, pa.array(packed, pa.binary())], names)

    kind = _field_type(df, key)
    schema = (
        f"bucket int, keys array<{kind}>, places array<bigint>, befores array<int>, anchors array<bigint>, "
        "sizes array<int>, units binary"
    )
    return df.select(key, text).mapInArrow(run, schema)


def _binary_parts(content: pa.BinaryArray) -> tuple[np.ndarray, memoryview]:
    """Ends of the values, beginning with 0, and their bytes one after the other."""
    _, offsets, data = content.buffers()
    offsets = np.frombuffer(offsets, np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    data = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b"")
    return offsets - offsets[0], data


def crowded_runs(
    df: DataFrame,
    length: int,
    repeated: tuple[np.ndarray, np.ndarray],
    unit: str = "bytes",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, first, last, anchor, span1, span2)`` of the runs of crowded anchors, as in ``window_runs``."""
    gram = bucket_gram(length)
    names = [key, "first", "last", "anchor", "span1", "span2"]
    _, crowded = repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (rolling.text_codes(value.as_py(), unit) for value in batch.column(1))
            for blocks in rolling.batches_of_blocks(texts, length):
                codes, block, first, last, _, anchor = rolling.anchored_blocks(blocks, length, gram)
                kept = _is_in(_codes_of(anchor), crowded)
                if not kept.any():
                    continue
                block, first, last, anchor = block[kept], first[kept], last[kept], anchor[kept]
                sizes = last - first + length
                units, ends = _units_between(codes, first, sizes)
                told = rolling.scramble(sizes.astype(np.uint64))
                spans = [rolling.scramble(rolling.PrefixHash(units, base).slices(ends - sizes, ends) ^ told) for base in rolling.BASES]
                begins = np.cumsum([0, *(len(codes) for _, _, codes in blocks[:-1])])
                moved = np.array([at for _, at, _ in blocks])[block] - begins[block]
                rows = np.array([row for row, _, _ in blocks])[block]
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(first + moved), pa.array(last + moved)]
                columns += [pa.array(x.view(np.int64)) for x in (anchor, *spans)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {_field_type(df, key)}, first bigint, last bigint, anchor bigint, span1 bigint, span2 bigint"
    return df.select(key, text).mapInArrow(run, schema)


def repeated_in_buckets(units: DataFrame, length: int, unit: str = "bytes", key: str = "doc_id") -> DataFrame:
    """``(key, first, last)``: windows that occur at least twice, as stretches of the runs of ``run_units``.

    Equal windows have equal anchors, so all of them are in the bucket of their
    anchor: they are told apart by its hash, where it lies in them, and two
    hashes of the other units. Runs of one anchor are compared at once, so they
    must be of bounded number.
    """
    width, inner = unit_width(unit), length - bucket_gram(length)
    names = [key, "first", "last"]

    def flat(table: pa.Table, name: str) -> pa.Array:
        return pa.concat_arrays([chunk.flatten() for chunk in table.column(name).chunks])

    def runs_of_anchors(table: pa.Table) -> Iterator[tuple]:
        anchors = flat(table, "anchors").to_numpy()
        order = np.argsort(anchors, kind="stable")
        same = anchors[order[1:]] == anchors[order[:-1]]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        if not len(order):
            return
        codec = pa.Codec("zstd")
        widths = flat(table, "sizes").to_numpy().astype(np.int64) * width
        counts = [count for chunk in table.column("sizes").chunks for count in chunk.value_lengths().to_pylist()]
        wholes = np.add.reduceat(widths, np.cumsum([0, *counts[:-1]]))
        data = b"".join(
            codec.decompress(part.as_py(), int(size), asbytes=True) if size else b""
            for part, size in zip(table.column("units"), wholes, strict=True)
        )
        content = pa.Array.from_buffers(
            pa.large_binary(), len(widths), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(widths)))), pa.py_buffer(data)]
        )
        keys, places, befores = flat(table, "keys"), flat(table, "places").to_numpy(), flat(table, "befores").to_numpy()
        # Some anchors at a time, each with all of its runs.
        turns = np.append(np.flatnonzero(np.diff(anchors[order])) + 1, len(order))
        at = 0
        while at < len(order):
            upto = int(turns[min(np.searchsorted(turns, at + RUNS_AT_ONCE), len(turns) - 1)])
            part = order[at:upto]
            yield keys.take(pa.array(part)), places[part], befores[part], anchors[part], content.take(pa.array(part))
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _of_each_bucket(batches):
            for keys, places, befores, anchors, content in runs_of_anchors(table):
                _, offsets, data = content.buffers()
                edges = np.frombuffer(offsets, np.int64)[: len(content) + 1] // width
                codes = np.frombuffer(data, np.uint8 if width == 1 else np.uint32, int(edges[-1])) if edges[-1] else np.zeros(0, np.uint8)
                counts = np.diff(edges) - inner + 1
                firsts = np.cumsum(counts) - counts
                owner = np.repeat(np.arange(len(counts)), counts)
                starts = (edges[:-1] - firsts)[owner] + np.arange(len(owner))
                before = befores + firsts
                known = anchors.view(np.uint64)[owner] + (before[owner] - np.arange(len(owner))).astype(np.uint64)
                known = rolling.scramble(known)
                hashes = [np.empty(len(owner), np.uint64) for _ in rolling.BASES]
                for at in range(0, len(counts), RUNS_AT_ONCE):
                    upto = min(at + RUNS_AT_ONCE, len(counts))
                    inside = slice(firsts[at], firsts[upto - 1] + counts[upto - 1])
                    block, here = codes[edges[at] : edges[upto]], starts[inside] - edges[at]
                    for kept, base in zip(hashes, rolling.BASES, strict=True):
                        kept[inside] = rolling.PrefixHash(block, base).slices(here, here + inner)
                found = rolling.repeated(*(rolling.scramble(kept ^ known) for kept in hashes))
                turns = np.concatenate(([True], owner[1:] != owner[:-1], [True]))
                opens = np.flatnonzero(found & (turns[:-1] | ~np.concatenate(([False], found[:-1]))))
                closes = np.flatnonzero(found & (turns[1:] | ~np.concatenate((found[1:], [False]))))
                if not len(opens):
                    continue
                moved = (places - before)[owner[opens]]
                columns = [keys.take(pa.array(owner[opens])), pa.array(moved + opens), pa.array(moved + closes)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = units.schema["keys"].dataType.elementType.simpleString()
    dealt = units.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"`{key}` {kind}, first bigint, last bigint")


def windows_of_runs(
    df: DataFrame,
    runs: DataFrame,
    length: int,
    unit: str = "bytes",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, pos, hash1, hash2)`` of the windows in ``runs(key, first, last)``.

    The runs of one document are gathered next to its text; their number is
    bounded by the length of that one text. Texts without runs are not moved.
    """
    names = [key, "pos", "hash1", "hash2"]
    wanted = materialize(runs.groupBy(key).agg(F.collect_list(F.struct("first", "last")).alias("runs")))

    def work(batch, row):
        codes = rolling.text_codes(batch.column(1)[row].as_py(), unit)
        pairs = batch.column(2)[row].values
        first = pairs.field("first").to_numpy(zero_copy_only=False)
        last = pairs.field("last").to_numpy(zero_copy_only=False)
        yield from rolling.windows_in(codes, length, first, last)

    schema = f"`{key}` {_field_type(df, key)}, pos bigint, hash1 bigint, hash2 bigint"
    return (
        possible(df.select(key, text), wanted, key).join(wanted, key).mapInArrow(_per_text(names, work), schema)
    )


def query_window_hashes(
    df: DataFrame, length: int, stride: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, pos, anchor, hash1, hash2)`` of windows of characters after whitespace."""
    names = [key, "pos", "anchor", "hash1", "hash2"]

    def work(batch, row):
        codes = rolling.text_codes(batch.column(1)[row].as_py(), "chars")
        yield from rolling.windows_at(codes, length, rolling.query_starts(codes, length, stride))

    schema = f"`{key}` {_field_type(df, key)}, pos bigint, anchor bigint, hash1 bigint, hash2 bigint"
    return df.select(key, text).mapInArrow(_per_text(names, work), schema)


def query_window_texts(
    df: DataFrame, length: int, stride: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, pos, window)`` of windows of characters after whitespace, as text."""
    names = [key, "pos", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, found = [], [], []

            def flush() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())]
                return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], names)

            for row in range(batch.num_rows):
                value = batch.column(1)[row].as_py() or ""
                for at in rolling.query_starts(rolling.text_codes(value, "chars"), length, stride).tolist():
                    rows.append(row)
                    places.append(at)
                    found.append(value[at : at + length])
                    if len(rows) == WINDOWS_PER_BATCH:
                        yield flush()
                        rows, places, found = [], [], []
            if rows:
                yield flush()

    schema = f"`{key}` {_field_type(df, key)}, pos bigint, window string"
    return df.select(key, text).mapInArrow(run, schema)
