"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

With A the centred vectors as rows, steps in turn take the distributed products
``u = A v`` and ``z = A'u`` and orthogonalise each new u and v against all
before it, which leaves A = U B V' with a small upper bidiagonal B. The left
vectors are as long as the table and are never stored: each is ``A w`` for a
short ``w``, so a task makes its part of all of them from its own rows. One
pass over the rows gives the inner products with all earlier left vectors and
the product with A' together; what reaches the driver is as long as a vector.
The decomposition is run to the end (a step per dimension), so that equal
deviations and small ones are all found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import materialize

# Numbers held by one row of the packed table, and what counts as no length left.
BLOCK_NUMBERS = 1 << 18
NOTHING = 1e-12
SCALE, SHIFT = 1024, 100_000
_LONG = 1 << 62


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every vector on the leading components, scaled to deviation 1.

    Entries ``c`` are fitted as ``x = floor(1024 * c) + 100000``. A row per
    vector and component up to ``components``: ``key, component, n, deviation,
    whitened, explained, identity_error``. A vector is dropped if it is null,
    empty, holds a null or non-finite entry, or one whose ``x`` is no long; if
    vectors differ in length, those of the most frequent length remain (of the
    greatest, in a tie). Repeated rows and null keys count as rows. Components
    without deviation are left out, so equal vectors alone give no row, as an
    empty table does. ``deviation`` is null where it does not fit a long. The
    largest entry of a component is positive.
    """
    numbers = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    rows = vectors.filter(F.coalesce(_usable(F.col(vector)), F.lit(False))).select(
        F.col(key).alias("id"), numbers.cast("array<bigint>").alias("x")
    )
    lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    kind = vectors.schema[key].dataType.simpleString()
    if best is None:
        return rows.sparkSession.createDataFrame([], _schema(key, kind))
    size, n = int(best["size"]), int(best["n"])
    blocks = materialize(_packed(rows.filter(F.size("x") == size), kind))
    centre = Centre(n, _sums(blocks, size))
    squares = _reduced(blocks, size, lambda x: (centre.rows(x) ** 2).sum(axis=0))
    axes, deviations = bidiagonalise(lambda w, all_w: _products(blocks, size, centre, w, all_w), size, np.sqrt(squares.sum()))
    variances = deviations**2 / n
    found = min(components, size, int((deviations > NOTHING * size * max(deviations[0], 1e-300)).sum()))
    scaled = axes[:, :found] / np.sqrt(variances[:found])
    product = _reduced(blocks, size, lambda x: _covariance(centre.rows(x) @ scaled)) / n
    means, second = product[:found], product[found:].reshape(found, found)
    error = float(np.abs(second - np.outer(means, means) - np.eye(found)).max(initial=0.0))
    explained = variances[:found] / (squares.sum() / n)
    return blocks.mapInArrow(_written(key, size, centre, scaled, explained, error), _schema(key, kind))


def _usable(vector: Column) -> Column:
    def fits(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(_LONG // SCALE))

    return (F.size(vector) > 0) & F.forall(vector, fits)


def _schema(key: str, kind: str) -> str:
    columns = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return f"`{key}` {kind}, {columns}"


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows packed to blocks ``(ids, numbers)``, so that a pass reads plain arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, amount = [], [], 0

        def flush() -> pa.RecordBatch:
            data = pa.array([np.concatenate(held).astype("<i8").tobytes()], pa.binary())
            chunk = pa.concat_arrays(ids)
            offsets = pa.array([0, len(chunk)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, chunk), data], ["ids", "numbers"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0))
            held.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
            amount += len(held[-1])
            if amount >= BLOCK_NUMBERS:
                yield flush()
                ids, held, amount = [], [], 0
        if ids:
            yield flush()

    return rows.mapInArrow(pack, f"ids array<{kind}>, numbers binary")


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for data in batch.column(batch.schema.get_field_index("numbers")):
            yield np.frombuffer(data.as_buffer(), "<i8").reshape(-1, size)


def _sums(blocks: DataFrame, size: int) -> list[int]:
    """Exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for x in _matrices(batches, size):
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + part for t, h, part in zip(total, high, low, strict=True)]
        numbers = pa.array([pa.scalar(str(t)).cast(pa.decimal128(38, 0)) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(size)), numbers], ["place", "amount"])

    sums = blocks.select("numbers").mapInArrow(run, "place bigint, amount decimal(38, 0)")
    found = sums.groupBy("place").agg(F.sum("amount").alias("amount")).collect()
    return [int(row["amount"]) for row in sorted(found)]


class Centre:
    """Takes the means off blocks of numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.means = np.array([s / n for s in sums])

    def spread(self, x: np.ndarray) -> np.ndarray | None:
        """``n * x - S`` exactly, or None if that does not fit 64 bits."""
        largest = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums))
        return None if largest >= _LONG else x * self.n - np.array(self.sums, np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        exact = self.spread(x)
        return x - self.means if exact is None else exact / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        exact = self.spread(x)
        if exact is not None and max(abs(int(exact.min())), abs(int(exact.max()))) ** 2 * x.shape[1] < _LONG:
            return (exact * exact).sum(axis=1).tolist()
        totals = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [total if total < 1 << 63 else None for total in totals]


def _reduced(blocks: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the short vector ``work`` makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, size):
            part = work(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(total)], ["place", "amount"])

    parts = blocks.select("numbers").mapInArrow(run, "place bigint, amount double")
    found = parts.groupBy("place").agg(F.sum("amount").alias("amount")).collect()
    return np.array([row["amount"] for row in sorted(found)])


def _products(
    blocks: DataFrame, size: int, centre: Centre, w: np.ndarray, earlier: np.ndarray
) -> tuple[np.ndarray, float, np.ndarray]:
    """For ``u = A w`` and the earlier left vectors ``U = A W``: ``U'u``, ``u'u`` and ``A'u``."""

    def work(x: np.ndarray) -> np.ndarray:
        rows = centre.rows(x)
        u = rows @ w
        return np.concatenate(((rows @ earlier).T @ u, [u @ u], rows.T @ u))

    total = _reduced(blocks, size, work)
    known = earlier.shape[1]
    return total[:known], float(total[known]), total[known + 1 :]


def bidiagonalise(products: Callable, size: int, norm: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values, falling.

    ``products(w, W)`` makes the passes. A step whose left vector has no length
    left adds none; one without a next right vector goes on from a random
    vector at right angles to all before it.
    """
    draw = np.random.default_rng(seed)
    right = np.zeros((size, 0))
    left = np.zeros((size, 0))  # W: left vectors are A W
    images = np.zeros((size, 0))  # A'U
    diagonal, above = np.zeros(size), np.zeros(size)
    following = draw.standard_normal(size)
    beta = 0.0
    for step in range(size):
        if beta <= NOTHING * norm:
            following, beta = draw.standard_normal(size), 0.0
        v = _orthogonal(following, right)
        w = v - beta * left[:, -1] if step else v
        for _ in range(2):
            inner, square, image = products(w, left)
            w, image = w - left @ inner, image - images @ inner
        # The second pass measured what the first had left over.
        length = np.sqrt(max(square - inner @ inner, 0.0))
        if length <= NOTHING * norm:
            w, image, length = np.zeros(size), np.zeros(size), 0.0
        else:
            w, image = w / length, image / length
        diagonal[step], above[step] = length, beta
        right, left, images = (np.column_stack(pair) for pair in ((right, v), (left, w), (images, image)))
        following = image - length * v
        for _ in range(2):
            following = following - right @ (right.T @ following)
        beta = float(np.linalg.norm(following))
    small = np.diag(diagonal) + np.diag(above[1:], 1)
    _, values, turns = np.linalg.svd(small)
    axes = right @ turns.T
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(size)])
    return axes * signs, values


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(3):
        vector = vector - basis @ (basis.T @ vector)
        vector = vector / np.linalg.norm(vector)
    return vector


def _covariance(rows: np.ndarray) -> np.ndarray:
    return np.concatenate((rows.sum(axis=0), (rows.T @ rows).ravel()))


def _written(key: str, size: int, centre: Centre, scaled: np.ndarray, explained: np.ndarray, error: float):
    found = scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in enumerate(batch.column("numbers")):
                x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, size)
                ids, values = batch.column("ids")[at].values, centre.rows(x) @ scaled
                count = len(x)
                repeated = np.repeat(np.arange(count), found)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(repeated)),
                        pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * found, centre.n)),
                        pa.array(centre.deviations(x), pa.int64()).take(pa.array(repeated)),
                        pa.array(values.ravel()),
                        pa.array(np.tile(explained, count)),
                        pa.array(np.full(count * found, error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run
