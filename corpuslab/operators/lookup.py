"""Looking up the text windows of one corpus in another."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.order import running_total
from corpuslab.operators.skew import join_counted
from corpuslab.operators.windows import query_window_hashes, window_runs, windows_of_runs
from corpuslab.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Queries of this many bytes are searched for in one pass over the texts.
QUERY_BYTES = 4 << 20
HITS_PER_BATCH = 100_000


def matched_queries(
    df: DataFrame,
    index: DataFrame,
    length: int = 100,
    stride: int = 1,
    key: str = "doc_id",
    text: str = "text",
    index_key: str = "doc_id",
    index_text: str = "text",
) -> DataFrame:
    """Query windows of ``df`` found anywhere in ``index``: ``(key, pos)``.

    Queries start after whitespace, the index offers every position. Both sides
    are first narrowed to the anchoring grams they share; only what is left is
    compared by content.
    """
    queries = query_window_hashes(df, length, stride, key, text)
    runs = window_runs(index, length, "chars", index_key, index_text)
    offered = runs.groupBy("anchor").agg(F.count("*").alias("runs"))
    fan_in = queries.groupBy("anchor").agg(F.count("*").alias("fan_in"))
    shared = materialize(fan_in.join(offered, "anchor"))
    candidates = materialize(join_counted(queries, shared.drop("runs"), "anchor", "fan_in"))
    wanted = join_counted(runs, shared.drop("fan_in"), "anchor", "runs").select(index_key, "first", "last")
    found = windows_of_runs(index, wanted, length, "chars", index_key, index_text)
    content = ["hash1", "hash2"]
    confirmed = materialize(
        candidates.groupBy(*content)
        .agg(F.count("*").alias("fan_in"))
        .join(found.select(*content).distinct(), content, "left_semi")
    )
    return join_counted(candidates, confirmed, content, "fan_in").select(key, "pos")


def flag_against_index(df: DataFrame, index: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Add ``has_dup``: does any query window of the document occur in ``index``?"""
    found = matched_queries(df, index, key=key, **options).select(key).distinct()
    return df.join(found.withColumn("has_dup", F.lit(True)), key, "left").withColumn(
        "has_dup", F.coalesce("has_dup", F.lit(False))
    )


def _blocks_of_queries(queries: DataFrame, query: str) -> Iterator[list[str]]:
    """Distinct non-empty queries, in blocks of bounded size.

    Ranges of a written order are read one after the other, so the driver holds
    one block at a time.
    """
    size = F.octet_length(query).cast("bigint")
    usable = queries.select(query).filter(size > 0).distinct()
    placed = materialize(running_total(usable.withColumn("bytes", size), "bytes", [query]))
    total = placed.agg(F.max("running")).first()[0] or 0
    for number in range(-(-total // QUERY_BYTES)):
        here = placed.filter(F.floor((F.col("running") - 1) / QUERY_BYTES) == number)
        block = [row[query] for row in here.select(query).collect()]
        if block:
            yield block


def _automaton(queries: list[str], unit: str):
    found = ahocorasick.Automaton()
    for number, query in enumerate(queries):
        found.add_word(_coded(query, unit), number)
    found.make_automaton()
    return found


def _coded(text: str, unit: str) -> str:
    """The text with one character per unit."""
    return text if unit == "chars" else text.encode("utf-8").decode("latin-1")


def occurrence_positions(
    df: DataFrame,
    queries: DataFrame,
    unit: str = "chars",
    key: str = "doc_id",
    text: str = "text",
    query: str = "query",
) -> DataFrame:
    """Every place of every query string: ``(key, query, pos)``, overlaps included.

    Each text is read once by an automaton of all queries, whatever their number
    and lengths; queries of more than ``QUERY_BYTES`` together are taken in
    blocks, a pass each. Hits stay in the task that found them: nothing is
    shuffled, and a query that is found everywhere is no hot key. ``pos`` counts
    units from 0. Null texts hold nothing; null and empty queries are found
    nowhere.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{query}` string, pos bigint"
    found = None
    for block in _blocks_of_queries(queries, query):
        hits = df.select(key, text).mapInArrow(_positions(block, unit, [key, query, "pos"]), schema)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else df.sparkSession.createDataFrame([], schema)


def _positions(block: list[str], unit: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, unit)
        sizes = [len(_coded(query, unit)) for query in block]
        offered = pa.array(block, pa.string())
        for batch in batches:
            rows, numbers, places = [], [], []

            def flush() -> pa.RecordBatch:
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    offered.take(pa.array(numbers, pa.int64())),
                    pa.array(places, pa.int64()),
                ]
                return pa.RecordBatch.from_arrays(columns, names)

            for row in range(batch.num_rows):
                value = batch.column(1)[row].as_py()
                if not value:
                    continue
                for end, number in automaton.iter(_coded(value, unit)):
                    rows.append(row)
                    numbers.append(number)
                    places.append(end + 1 - sizes[number])
                    if len(rows) >= HITS_PER_BATCH:
                        yield flush()
                        rows, numbers, places = [], [], []
            if rows:
                yield flush()

    return run


def count_occurrences(
    df: DataFrame,
    queries: DataFrame,
    unit: str = "chars",
    key: str = "doc_id",
    text: str = "text",
    query: str = "query",
) -> DataFrame:
    """How often each query string occurs in the corpus, overlaps counted.

    Returns the distinct queries with ``occurrences`` and ``num_docs`` (rows of
    ``df``). Counts are added up in the tasks that read the texts, so a task
    sends one row per query at most. Null and empty queries are left out.
    """
    size = F.octet_length(query)
    usable = queries.select(query).filter(size > 0).distinct()
    schema = f"`{query}` string, occurrences bigint, num_docs bigint"
    found = None
    for block in _blocks_of_queries(queries, query):
        hits = df.select(text).mapInArrow(_counts(block, unit, [query, "occurrences", "num_docs"]), schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    counted = found.groupBy(query).agg(F.sum("occurrences").alias("occurrences"), F.sum("num_docs").alias("num_docs"))
    return usable.join(counted, query, "left").fillna(0, ["occurrences", "num_docs"])


def _counts(block: list[str], unit: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, unit)
        times, docs = Counter(), Counter()
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    here = Counter(number for _, number in automaton.iter(_coded(value.as_py(), unit)))
                    times.update(here)
                    docs.update(here.keys())
        met = sorted(times)
        columns = [pa.array([block[n] for n in met], pa.string())]
        columns += [pa.array([counts[n] for n in met], pa.int64()) for counts in (times, docs)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return run
