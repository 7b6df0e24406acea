"""Repeated passages by super-k-mers.

The anchor of a window of words is the smallest hashed gram in it (its
minimiser). Neighbouring windows mostly share theirs, so a text is a short list
of runs, each the words of all its windows: a super-k-mer. Equal windows have
equal minimisers, so they meet in the bucket of their minimiser.

Runs first travel as numbers. A minimiser that one document has alone is done;
so are runs that a document of a smaller id has as a whole. What is left are
buckets of several different runs. One copy of each such run goes to its bucket
as a packed string of words, and there the windows of all runs are sorted.
Buckets of many different runs (a passage in ever other surroundings) have no
bound; their windows are grouped one by one by Spark instead, which spreads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.shingles import blocks, mix, powers
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

# Words of a gram whose minimum anchors a window, as a share of the window.
GRAM_SHARE = 5
# Runs of one bucket that are sorted together, and strings sorted at a time.
BUCKET, AT_ONCE = 4096, 4096
ROWS = 100_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SECOND = np.uint64(0xD1342543DE82EF95)
_SECOND_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_INDEX = np.uint64((1 << 20) - 1)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def remove_repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words left in every text after removing passages an earlier document has.

    Words are what lies between ASCII white space. Every word goes that is
    covered by a window of ``window`` words whose sequence also starts in a
    document with a smaller key. One row per row of ``docs``: ``key, n_words,
    n_removed, kept_sha256`` (of the words left, joined by one space). A null
    text has no words. A row with a null key keeps all its words and takes none
    from others; rows of equal keys take nothing from each other. Windows that
    decide are compared word by word in their bucket. Runs are told apart by two
    64-bit hashes, as are the windows of buckets of over ``BUCKET`` runs.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("mark", F.xxhash64("id", "body"))
    removed = removals(rows, window).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    kept = rows.join(removed, ["id", "mark"], "left").select("id", "body", "parts")
    schema = f"`{key}` bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return kept.mapInArrow(_keep(key), schema)


def removals(rows: DataFrame, window: int) -> DataFrame:
    """Ranges of words to remove, ``(id, mark, start, end)``, from ``rows(id, mark, body)``."""
    gram = max(1, window // GRAM_SHARE)
    whole = rows.filter("id is not null")
    runs = whole.mapInArrow(
        _runs(window, gram), "id bigint, mark bigint, anchor bigint, span bigint, first int, last int"
    )
    shared = runs.groupBy("anchor").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("fan_in")
    )
    shared = materialize(shared.filter("low < high").select("anchor", "fan_in"))
    held = materialize(join_counted(runs, shared, "anchor", "fan_in"))

    same = ["anchor", "span"]
    contents = held.groupBy(*same).agg(
        F.min(F.struct("id", "mark", "first", "last")).alias("one"), F.max("id").alias("high"), F.count("*").alias("fan_in")
    )
    contents = materialize(contents)
    kinds = materialize(contents.groupBy("anchor").agg(F.count("*").alias("kinds")).withColumn("fan_in", F.col("kinds")))
    contents = join_counted(contents.withColumnRenamed("fan_in", "copies"), kinds, "anchor", "fan_in")
    contents = materialize(contents.filter("kinds > 1 or one.id < high"))

    parts = _repeated_parts(whole, contents.filter("kinds > 1"), window)
    judged = contents.select(*same, F.col("one.id").alias("low"), "high", F.col("copies").alias("fan_in"))
    judged = materialize(judged.join(parts, same, "left").filter("low < high or parts is not null"))
    found = join_counted(held, judged, same, "fan_in")
    every = F.array(F.struct(F.lit(0).alias("start"), (F.col("last") - F.col("first")).alias("stop")))
    found = found.select("id", "mark", "first", F.inline(F.when(F.col("id") > F.col("low"), every).otherwise(F.col("parts"))))
    ranges = found.select("id", "mark", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop") + window).alias("end"))
    return ranges.distinct()


def _repeated_parts(rows: DataFrame, contents: DataFrame, window: int) -> DataFrame:
    """``(anchor, span, parts)``: windows of a run, from its start, that a smaller id has in another run."""
    wanted = contents.select("one.*", "anchor", "span", (F.col("kinds") > BUCKET).alias("many"))
    wanted = wanted.groupBy("id", "mark").agg(
        F.collect_list(F.struct("first", "last", "anchor", "span", "many")).alias("wanted")
    )
    cut = rows.join(wanted, ["id", "mark"]).select("id", "mark", "body", "wanted")
    sent = materialize(
        cut.mapInArrow(
            _cut(window), "anchor bigint, span bigint, id bigint, words binary, at int, one bigint, two bigint"
        )
    )
    few = sent.filter("words is not null").select("anchor", "span", "id", "words")
    few = few.repartition("anchor").sortWithinPartitions("anchor", "span")
    sorted_parts = few.mapInArrow(_sort_buckets(window), "anchor bigint, span bigint, at int")

    many = sent.filter("words is null").select("anchor", "span", "id", "at", "one", "two").distinct()
    lowest = many.groupBy("one", "two").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("fan_in"))
    lowest = materialize(lowest.filter("low < high").select("one", "two", "low", "fan_in"))
    grouped = join_counted(many, lowest, ["one", "two"], "fan_in").filter("id > low").select("anchor", "span", "at")
    both = sorted_parts.unionByName(grouped)
    # At most as many as the windows of a run.
    return both.groupBy("anchor", "span").agg(
        F.transform(F.collect_list("at"), lambda at: F.struct(at.alias("start"), at.alias("stop"))).alias("parts")
    )


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words as they are, and the text each is in."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_texts = np.cumsum([len(text) + 1 for text in texts])
    gap = _GAP[data]
    before = np.concatenate(([True], gap[:-1]))
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
    total = _prefix(codes[data], _STEP)
    words = mix(_slices(total, starts, ends, _BACK) + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(ends_of_texts, starts, side="right")


def _prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)) if len(values) else values, out=sums[1:])
    return sums


def _slices(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, back: np.uint64) -> np.ndarray:
    """Hashes of slices, equal for equal slices wherever they start."""
    return (prefix[ends] - prefix[starts]) * powers(back, len(prefix))[starts]


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` neighbours by their upper 44 bits, the first of equal ones.

    Indices wrap at 2**20, far above ``width``, and are put right from the window's own place.
    """
    place = np.arange(len(values), dtype=np.uint64)
    out = np.zeros(max(0, len(values) - width + 1), np.int64)
    half = 1 << 19
    for low in range(0, len(out), half):
        best = (values[low : low + half + width - 1] & ~_INDEX) | (place[low : low + half + width - 1] - np.uint64(low))
        reach = 1
        while reach * 2 <= width:
            best = np.minimum(best[:-reach], best[reach:])
            reach *= 2
        if reach < width:
            best = np.minimum(best[: reach - width], best[width - reach :])
        out[low : low + half] = (best & _INDEX).astype(np.int64) + low
    return out


def find_runs(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of all texts: ``text, first, last`` (window starts in words), ``anchor, span`` hashes."""
    words, owner = _words(texts)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    count = len(words) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    odd = powers(np.uint64(0xD6E8FEB86659FD93), gram + 1)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for offset in range(gram):
        grams += words[offset : offset + len(grams)] * odd[offset + 1]
    grams = mix(grams)
    anchors = _leftmost_minimum(grams, window - gram + 1)
    inside = owner[:count] == owner[window - 1 :]
    opens = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (owner[1:count] != owner[: count - 1]) | ~inside[:-1]))
    opens &= inside
    first = np.flatnonzero(opens)
    # A run ends before the next one, or with the last window of its text.
    last = np.minimum(np.append(first[1:], count) - 1, starts[owner[first] + 1] - window)
    ends = last + window
    span = mix(_slices(_prefix(words, _SECOND), first, ends, _SECOND_BACK) ^ mix((ends - first).astype(np.uint64)))
    base = starts[owner[first]]
    return owner[first], first - base, last - base, grams[anchors[first]], span


def _runs(window: int, gram: int):
    names = ["id", "mark", "anchor", "span", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [value.as_py().encode("utf-8", "surrogatepass") for value in batch.column("body")]
            for low, high in blocks(raw):
                text, first, last, anchor, span = find_runs(raw[low:high], window, gram)
                at = pa.array(text + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at),
                        batch.column("mark").take(at),
                        pa.array(anchor.view(np.int64)),
                        pa.array(span.view(np.int64)),
                        pa.array(first.astype(np.int32)),
                        pa.array(last.astype(np.int32)),
                    ],
                    names,
                )

    return run


def _cut(window: int):
    """The wanted runs of each text as packed strings, or hashed windows where a bucket holds many runs."""
    names = ["anchor", "span", "id", "words", "at", "one", "two"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: set[tuple] = set()  # rows that repeat whole are cut once by a task

        def flush() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names)

        for batch in batches:
            for row in zip(*(batch.column(name) for name in ("id", "mark", "body", "wanted")), strict=True):
                own, mark, body, runs = (value.as_py() for value in row)
                if (own, mark) in done:
                    continue
                done.add((own, mark))
                body = body.encode("utf-8", "surrogatepass")
                words = body.split()
                hashes = _words([body])[0] if any(entry["many"] for entry in runs) else None
                for entry in runs:
                    head = entry["anchor"], entry["span"], own
                    first, last = entry["first"], entry["last"]
                    if entry["many"]:
                        one, two = _window_hashes(hashes[first : last + window], window)
                        held += [(*head, None, at, a, b) for at, (a, b) in enumerate(zip(one, two, strict=True))]
                    else:
                        held.append((*head, b" ".join(words[first : last + window]), None, None, None))
                    if len(held) >= AT_ONCE:
                        yield flush()
                        held = []
        if held:
            yield flush()

    return run


def _window_hashes(words: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    count = len(words) - window + 1
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        odd = powers(np.uint64(seed | 1), window + 1)[1:]
        total = np.zeros(count, np.uint64)
        for offset in range(window):
            total += mix(words[offset : offset + count] + np.uint64(seed)) * odd[offset]
        out.append(mix(total).view(np.int64).tolist())
    return out[0], out[1]


def _sort_buckets(window: int):
    names = ["anchor", "span", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = sort_windows([row[3].split(b" ") for row in rows], [row[2] for row in rows], window)
            taken = [(rows[run][0], rows[run][1], at) for run, at in found]
            columns = zip(*taken, strict=True) if taken else ((), (), ())
            types = (pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names)

        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("anchor", "span", "id", "words")), strict=True):
                # Whole buckets only: rows arrive in the order of their anchor, copies of a run one after the other.
                if held and row[:2] == held[-1][:2]:
                    continue
                if len(held) >= AT_ONCE and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return run


def sort_windows(runs: list[list[bytes]], ids: list[int], window: int) -> Iterator[tuple[int, int]]:
    """``(run, window)`` of all windows that a run of a smaller id holds too.

    Windows of words are sorted as rows of word numbers, equal ones by id.
    """
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(word, len(numbers)) for word in run], ">u4") for run in runs]
    views = [np.lib.stride_tricks.sliding_window_view(codes, window) for codes in coded]
    counts = [len(view) for view in views]
    windows = np.ascontiguousarray(np.concatenate(views))
    run = np.repeat(np.arange(len(runs)), counts)
    at = np.concatenate([np.arange(count) for count in counts])
    own = np.array(ids, np.int64)[run]
    content = windows.view(f"V{4 * window}").ravel()
    _, group = np.unique(content, return_inverse=True)
    lowest = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, own)
    for place in np.flatnonzero(own > lowest[group]):
        yield int(run[place]), int(at[place])


def _keep(key: str):
    names = [key, "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, digests = [], [], []
            for body, parts in zip(batch.column("body"), batch.column("parts"), strict=True):
                words = body.as_py().encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words) + 1, np.int64)
                if parts.is_valid:
                    np.add.at(gone, parts.values.field("start").to_numpy(), 1)
                    np.add.at(gone, parts.values.field("end").to_numpy(), -1)
                gone = np.cumsum(gone[:-1]) > 0
                totals.append(len(words))
                removed.append(int(gone.sum()))
                left = [word for word, drop in zip(words, gone.tolist(), strict=True) if not drop] if removed[-1] else words
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            columns = [batch.column("id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
