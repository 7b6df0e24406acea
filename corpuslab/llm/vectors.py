"""Near-duplicate vectors by tiles compared along principal axes.

Unit vectors are turned onto the principal axes of all vectors, so that the
first coordinates carry most of a product. Linked vectors lie close together
in each of them, so vectors are put into cells of the first axes and only
neighbouring cells are compared, a tile (a bounded number of vectors of one
cell) with a tile. In a pair of tiles products are added up axis by axis; what
the axes to come can still add is at most the product of the two remaining
norms, and a pair is dropped once that cannot lift it to the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.components import components
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

GRID_AXES = 3
# Numbers held by a tile.
TILE_NUMBERS = 1 << 17
PAIRS_AT_ONCE = 1 << 15
SLACK = 1e-9


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Links and components of vectors with cosine >= ``threshold`` in one label.

    Returns per row ``key, n_links, component_id, kept``. Equal vectors of a
    label are compared once and counted as often as they occur. A vector that
    is null, empty, zero or holds a null or non-finite component, or whose
    label or key is null, links with nothing and is its own component (null
    for a null key, and not kept). Vectors of different length never link.
    Cosines that decide are taken from the given vectors in double precision.
    """
    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.col(label).cast("string").alias("label"),
    )
    good = F.coalesce(_usable(F.col("vector")), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    # 0.0 and -0.0 are one number.
    plain = F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    keyed = materialize(
        rows.withColumn("vector", F.when(good, plain)).select(
            "id", "vector", "label", F.xxhash64("vector").alias("one"), F.hash("vector").alias("two")
        )
    )
    same = ["label", "one", "two"]
    distinct = materialize(
        keyed.filter("vector is not null")
        .groupBy(*same)
        .agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    )
    axes = principal_axes(distinct)
    tiles = materialize(_tiles(distinct, axes, threshold))
    found = materialize(_compare(tiles, axes, threshold))
    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.filter("other is not null").select("node", "other"), "node", "other")
    named = (
        distinct.select(*same, "node", "copies")
        .join(counts, "node", "left")
        .join(reached, "node", "left")
        .select(
            *same,
            "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "node").alias("component"),
        )
        .withColumn("fan_in", F.col("copies"))
    )
    linked = join_counted(keyed.filter("vector is not null"), materialize(named), same, "fan_in").select(
        "id", "links", "component"
    )
    alone = keyed.filter("vector is null").select("id", F.lit(0).cast("bigint"), F.col("id"))
    return linked.union(alone).select(
        F.col("id").alias(key),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists(vector, lambda x: x != 0)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest entry is divided out first, against overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the vectors of a batch as a matrix, for every length of vector."""
    lists = batch.column(column)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, values[offsets[at][:, None] + np.arange(size)].astype(np.float64)


def principal_axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """The axes of all unit vectors, by length of vector, as columns of a matrix.

    Only sums of products come to the driver: a matrix per length of vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, rows in matrices(batch, "vector"):
                unit = units(rows)
                size = rows.shape[1]
                sums[size] = sums.get(size, 0) + unit.T @ unit
        for size, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size * size), pa.array(np.arange(size * size)), pa.array(total.ravel())],
                ["size", "place", "amount"],
            )

    sums = distinct.select("vector").mapInArrow(run, "size bigint, place bigint, amount double")
    sums = sums.groupBy("size", "place").agg(F.sum("amount").alias("amount")).toPandas()
    axes = {}
    for size, part in sums.groupby("size"):
        square = part.sort_values("place")["amount"].to_numpy().reshape(size, size)
        axes[int(size)] = np.linalg.eigh(square)[1][:, ::-1].copy()
    return axes


def _tiles(distinct: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Tiles of one label, length and cell: ``(tile, label, size, cell, nodes, copies, numbers)``."""
    # Linked unit vectors differ by at most this much in every coordinate.
    width = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + SLACK

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros((batch.num_rows, GRID_AXES), np.int64)
            first = np.zeros(batch.num_rows)
            for at, rows in matrices(batch, "vector"):
                turned = units(rows) @ axes[rows.shape[1]][:, :GRID_AXES]
                cell[at, : turned.shape[1]] = np.floor(turned / width)
                first[at] = turned[:, -1]
            columns = [batch.column(name) for name in ("node", "copies", "label", "vector")]
            columns += [pa.array(cell[:, axis]) for axis in range(GRID_AXES)] + [pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "last"])

    grid = [f"cell{axis}" for axis in range(GRID_AXES)]
    names = ["node", "copies", "label", "vector", *grid]
    schema = "node bigint, copies bigint, label string, vector array<double>, " + ", ".join(f"{c} bigint" for c in grid)
    placed = distinct.select("node", "copies", "label", "vector").mapInArrow(cells, f"{schema}, last double")
    keys = ["label", "size", *grid]
    placed = placed.withColumn("size", F.size("vector").cast("bigint"))
    placed = placed.repartitionByRange(*keys, "last", "node").sortWithinPartitions(*keys, "last", "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, current = TaskContext.get().partitionId(), 0, [], None

        def flush() -> pa.RecordBatch:
            nodes, copies, vectors = zip(*held, strict=True)
            row = [(task << 32) + made, *current, list(nodes), list(copies), np.concatenate(vectors)]
            return pa.RecordBatch.from_arrays([pa.array([value]) for value in row], out)

        out = ["tile", *keys, "nodes", "copies", "numbers"]
        for batch in batches:
            values = [batch.column(name).to_pylist() for name in (*keys, "node", "copies")]
            for row, vector in zip(zip(*values, strict=True), batch.column("vector"), strict=True):
                own = row[: len(keys)]
                if held and (own != current or len(held) * own[1] >= TILE_NUMBERS):
                    yield flush()
                    made, held = made + 1, []
                current = own
                held.append((row[-2], row[-1], vector.values.to_numpy()))
        if held:
            yield flush()

    head = ", ".join(f"{c} bigint" for c in grid)
    return placed.mapInArrow(
        cut,
        f"tile bigint, label string, size bigint, {head}, nodes array<bigint>, copies array<bigint>, numbers array<double>",
    )


def _compare(tiles: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Link counts ``(node, null, links)`` and connections ``(node, other, null)``."""
    grid = [f"cell{axis}" for axis in range(GRID_AXES)]
    head = tiles.select("tile", "label", "size", *grid)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    other = head.withColumnRenamed("tile", "second")
    for name in grid:
        other = other.withColumn("step", F.explode(near)).withColumn(name, F.col(name) + F.col("step")).drop("step")
    pairs = head.join(other, ["label", "size", *grid]).filter("tile <= second").select("tile", "second")
    left = tiles.select("tile", "nodes", "copies", "numbers", "size")
    right = tiles.select(*[F.col(name).alias(f"{name}2") for name in ("tile", "nodes", "copies", "numbers")])
    both = pairs.join(left, "tile").join(right, F.col("second") == F.col("tile2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                size = row["size"].as_py()
                sides = [
                    (
                        row[f"nodes{s}"].values.to_numpy(),
                        row[f"copies{s}"].values.to_numpy(),
                        row[f"numbers{s}"].values.to_numpy().reshape(-1, size),
                    )
                    for s in ("", "2")
                ]
                yield from compare_tiles(*sides, axes[size], threshold, row["tile"] == row["tile2"])

    return both.drop("second").mapInArrow(run, "node bigint, other bigint, links bigint")


def linked_rows(
    one: np.ndarray, two: np.ndarray, axes: np.ndarray, threshold: float, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked vectors of two tiles; ``i < j`` if they are one tile."""
    size = one.shape[1]
    # Cosines are taken of the given numbers, scaled by a power of two only.
    scaled = [rows / np.exp2(np.floor(np.log2(np.abs(rows).max(axis=1, keepdims=True)))) for rows in (one, two)]
    norms = [np.sqrt((rows * rows).sum(axis=1)) for rows in scaled]
    turned = [units(rows) @ axes for rows in (one, two)]
    stops = sorted({min(size, stop) for stop in (8, 24, size)})
    left = [{stop: np.sqrt((rows[:, stop:] ** 2).sum(axis=1)) for stop in stops} for rows in turned]
    strip = max(1, (1 << 20) // max(1, len(two)))
    for low in range(0, len(one), strip):
        high = min(len(one), low + strip)
        part = turned[0][low:high, : stops[0]] @ turned[1][:, : stops[0]].T
        bound = part + left[0][stops[0]][low:high, None] * left[1][stops[0]][None, :]
        rows, columns = np.nonzero(bound >= threshold - SLACK)
        products = part[rows, columns]
        rows = rows + low
        if same:
            keep = rows < columns
            rows, columns, products = rows[keep], columns[keep], products[keep]
        for first in range(0, len(rows), PAIRS_AT_ONCE):
            i, j, product = (x[first : first + PAIRS_AT_ONCE] for x in (rows, columns, products))
            for begin, stop in zip(stops, stops[1:], strict=False):
                product = product + np.einsum("ij,ij->i", turned[0][i, begin:stop], turned[1][j, begin:stop])
                keep = product + left[0][stop][i] * left[1][stop][j] >= threshold - SLACK
                i, j, product = i[keep], j[keep], product[keep]
            cosine = np.einsum("ij,ij->i", scaled[0][i], scaled[1][j]) / (norms[0][i] * norms[1][j])
            keep = cosine >= threshold
            if keep.any():
                yield i[keep], j[keep]


def compare_tiles(one, two, axes: np.ndarray, threshold: float, same: bool) -> Iterator[pa.RecordBatch]:
    (nodes, copies, rows), (nodes2, copies2, rows2) = one, two
    total = len(nodes) + len(nodes2)
    shift = 0 if same else len(nodes)
    links = np.zeros(total, np.int64)
    root = np.arange(total)
    for i, j in linked_rows(rows, rows2, axes, threshold, same):
        np.add.at(links, i, copies2[j])
        np.add.at(links, j + shift, copies[i])
        j = j + shift
        while True:  # smallest row reached over these links
            low = np.minimum(root[i], root[j])
            before = root.copy()
            for side in (i, j, before[i], before[j]):
                np.minimum.at(root, side, low)
            while not np.array_equal(root, root[root]):
                root = root[root]
            if np.array_equal(root, before):
                break
    all_nodes = np.concatenate((nodes, nodes2))
    counted, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(total))
    if len(counted):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((all_nodes[counted], all_nodes[joined]))),
                pa.array([None] * len(counted) + all_nodes[root[joined]].tolist(), pa.int64()),
                pa.array(links[counted].tolist() + [None] * len(joined), pa.int64()),
            ],
            ["node", "other", "links"],
        )
