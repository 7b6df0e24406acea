"""Similarity join on word shingles by prefixes of token combinations.

Shingles are put in one global order, rare ones first. Two sets that are
similar enough cannot differ in all of a long enough prefix, so they meet on a
signature of it. A rare shingle is a signature by itself. Frequent shingles
are dealt to classes by hash, and a class gives pairs of its shingles: as a
pair may miss one shingle of every class, a prefix is extended until its rare
shingles plus, for every class, its shingles but one exceed what two similar
sets can differ in. Every candidate is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.components import components
from corpuslab.llm.shingles import mix, set_digest, shingle_sets
from corpuslab.operators.links import resolved_links
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

# Shingles in more sets than this form pairs; those in fewer stand alone.
RARE = 16
# Shingles below these are the quarter that is searched for lone ones, and the half whose sets are counted.
QUARTER, HALF = np.uint64(1 << 62), np.uint64(1 << 63)
MAP_BITS = 22


def similar_documents(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Documents with the component they reach over links of similar shingle sets.

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of ``size``-word shingles. Returns one row per row of ``docs``:
    ``key``, ``n_shingles`` and ``component_id``, the smallest key reachable
    (itself included). Equal sets are compared once. All links between
    different sets that could join two components are found and verified.

    A null or empty text has no shingle and links with nothing. Rows with one
    key are one document. A row whose key is null has a null component. Other
    columns are ignored, an empty table gives an empty one.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and at most 100")
    docs = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("body"))
    docs = docs.withColumn("place", F.expr(f"cast(xxhash64(doc) & {(1 << MAP_BITS) - 1} as int)"))
    digests = materialize(docs.mapInArrow(_digests(size), "doc bigint, n bigint, low bigint, high bigint"))
    sets = materialize(
        digests.filter("n > 0 and doc is not null")
        .groupBy("n", "low", "high")
        .agg(F.min("doc").alias("node"), F.count("*").alias("copies"))
    )
    links = _links(docs, sets, size, percent)
    # Rows that share a key are one document, so their sets count as linked.
    own = digests.filter("n > 0 and doc is not null").join(
        sets.select("low", "high", "n", "node"), ["low", "high", "n"]
    )
    repeated = own.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    reached = components(links.unionByName(repeated.select("a", "b")))
    named = materialize(
        sets.join(reached.withColumnRenamed("component", "root"), "node", "left")
        .select("n", "low", "high", "copies", F.coalesce("root", "node").alias("component"))
    )
    return join_counted(digests, named, ["n", "low", "high"], "copies", "left").select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"),
    )


def most_different(n: Column, percent: int) -> Column:
    """How many of ``n`` shingles a linked set may lack, plus one."""
    return n - F.ceil(n * F.lit(percent) / F.lit(100)) + 1


def _links(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` between different sets, enough to know all components."""
    # A set with more shingles of its own than a link allows links with nothing.
    # A quarter of all shingles, chosen by hash, suffices to see that for most sets.
    own = (
        docs.mapInArrow(_quarters(size), "code bigint, low bigint")
        .groupBy("code")
        .agg(F.min("low").alias("low"), F.max("low").alias("last"))
        .filter("low = last")
        .groupBy("low")
        .agg(F.count("*").alias("lone"))
    )
    n = F.col("n")
    could = (F.floor(n * 100 / F.lit(percent)) > n) | (F.ceil(n * percent / F.lit(100)) < n)
    open_sets = sets.filter(could).join(own, "low", "left").filter(
        F.coalesce("lone", F.lit(0)) < most_different(n, percent)
    )
    wanted = materialize(open_sets.select(F.col("node").alias("doc")).distinct())
    # Sets are made where the texts lie; a map of bits tells which may be wanted.
    whole = materialize(
        docs.mapInArrow(
            _whole_sets(size, percent, _bit_map(wanted)),
            "node bigint, n bigint, low bigint, half int, spare int, shingles array<bigint>",
        )
    )
    # Prefixes take the shingles of one half first, so the others need no count.
    halves = whole.select("node", F.explode(F.expr("slice(shingles, 1, half)")).alias("shingle"))
    counts = halves.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    shared = materialize(counts.withColumn("fan_in", F.col("df")))
    met = join_counted(halves, shared, "shingle", "fan_in").groupBy("node").agg(
        F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("shared")
    )
    heads = whole.select("node", "n", "half", F.expr("slice(shingles, half + 1, spare)").alias("rest"))
    prefixes = heads.join(met, "node", "left").select(
        "node", "n", "half", "rest",
        F.coalesce(F.col("shared.df"), F.array().cast("array<bigint>")).alias("df"),
        F.coalesce(F.col("shared.shingle"), F.array().cast("array<bigint>")).alias("shingles"),
    )
    signatures = prefixes.mapInArrow(_signatures(percent), "signature bigint, node bigint, n bigint, shared bigint")
    return resolved_links(signatures, whole, percent)


def _bit_map(wanted: DataFrame) -> np.ndarray:
    """A map of ``2 ** MAP_BITS`` bits in which every wanted number has one."""
    place = F.expr(f"cast(xxhash64(doc) & {(1 << MAP_BITS) - 1} as int)")
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[wanted.select(place.alias("bit")).distinct().toPandas()["bit"].to_numpy()] = True
    return np.packbits(bits)


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("body").to_pylist(), size))
            digests = np.array([set_digest(x) for x in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                ],
                ["doc", "n", "low", "high"],
            )

    return run


def _quarters(size: int):
    """The shingles of the quarter by 40 bits of theirs: two that share a code only hide that they are lone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, digests, held = [], [], 0
            for whole in shingle_sets(batch.column("body").to_pylist(), size):
                part = whole[: np.searchsorted(whole, QUARTER)]
                codes.append(part & np.uint64((1 << 40) - 1))
                digests.append(np.full(len(part), set_digest(whole)[0] if len(whole) else 0, np.int64))
                held += len(part)
                if held > 200_000:
                    yield _columns(("code", codes), ("low", digests))
                    codes, digests, held = [], [], 0
            if held:
                yield _columns(("code", codes), ("low", digests))

    return run


def _columns(*columns: tuple[str, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(parts).view(np.int64)) for _, parts in columns], [name for name, _ in columns]
    )


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _whole_sets(size: int, percent: int, bits: np.ndarray):
    """Wanted sets in ascending order, so the half comes first; ``spare`` others may be in a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column("place").to_numpy(zero_copy_only=False)).astype(np.int64)
            met = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            met &= batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(met))
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = list(shingle_sets(part.column("body").to_pylist(), size))
                half = [int(np.searchsorted(x, HALF)) for x in sets]
                spare = [
                    min(len(x) - q, max(0, differ(len(x), percent) + differ(len(x), percent) // 2 + 1 - q))
                    for x, q in zip(sets, half, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([set_digest(x)[0] for x in sets], pa.int64()),
                        pa.array(half, pa.int32()),
                        pa.array(spare, pa.int32()),
                        _lists(sets),
                    ],
                    ["node", "n", "low", "half", "spare", "shingles"],
                )

    return run


def differ(count: int, percent: int) -> int:
    """How many of ``count`` shingles a linked set may lack, plus one."""
    return count - -(-count * percent // 100) + 1


def prefix_signatures(
    n: int, half: int, df: np.ndarray, shingles: np.ndarray, rest: np.ndarray, percent: int
) -> np.ndarray:
    """Signatures of a set of ``n`` shingles, in the order of its prefix.

    First come the ``half`` shingles of the counted part, the lone ones before
    those with ``df > 1``, which are given in order; then the others,
    ``rest``, each of which stands alone, whether rare or not.
    """
    need = differ(n, percent) - (half - len(df))
    if need <= 0:
        return np.zeros(0, np.uint64)
    rare = int(np.searchsorted(df, RARE, side="right"))
    alone = shingles[: min(rare, need)]
    if need <= rare:
        return alone
    frequent, need, out = shingles[rare:], need - rare, [alone]
    # Classes depend on the size of the smaller set of a pair, so a set near a
    # power of two is given the classes of both sides.
    for power in range((-(-n * percent // 100)).bit_length() - 1, n.bit_length()):
        classes = max(1, differ(1 << power, percent) // 2)
        of_class = (frequent % np.uint64(classes)).astype(np.int64)
        order = np.argsort(of_class, kind="stable")
        first = np.zeros(len(frequent), bool)
        first[order] = np.concatenate(([True], np.diff(of_class[order]) != 0))[: len(order)]
        covered = np.cumsum(~first)
        length = int(np.searchsorted(covered, need)) + 1
        if not len(covered) or covered[-1] < need:
            out.append(rest[: need - int(covered[-1]) if len(covered) else need])
        taken, group = frequent[:length], of_class[:length]
        order = np.lexsort((taken, group))
        taken, group = taken[order], group[order]
        for step in range(1, length):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            low, high = taken[:-step][same], taken[step:][same]
            out.append(mix(mix(low) + high * np.uint64(0xD6E8FEB86659FD93) + np.uint64(power)))
    return np.concatenate(out)


def _signatures(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, nodes, sizes, shared, held = [], [], [], [], 0
            columns = [batch.column(name) for name in ("node", "n", "half", "df", "shingles", "rest")]
            for node, n, half, df, shingles, rest in zip(*columns, strict=True):
                found = prefix_signatures(
                    n.as_py(),
                    half.as_py(),
                    df.values.to_numpy(),
                    shingles.values.to_numpy().view(np.uint64),
                    rest.values.to_numpy().view(np.uint64),
                    percent,
                )
                out.append(found)
                nodes.append(np.full(len(found), node.as_py(), np.int64))
                sizes.append(np.full(len(found), n.as_py(), np.int64))
                shared.append(np.full(len(found), n.as_py() - half.as_py() + len(df.values), np.int64))
                held += len(found)
                if held > 200_000:
                    yield _columns(("signature", out), ("node", nodes), ("n", sizes), ("shared", shared))
                    out, nodes, sizes, shared, held = [], [], [], [], 0
            if held:
                yield _columns(("signature", out), ("node", nodes), ("n", sizes), ("shared", shared))

    return run
