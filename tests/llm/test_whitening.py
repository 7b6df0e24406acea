"""Whitening against a dense decomposition."""

import numpy as np
import pytest

from corpuslab.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, component string, numbers int, ids int"


def whitened(spark, rows, components=8):
    table = spark.createDataFrame([(key, vector, 5, "c", 1, 2) for key, vector in rows], SCHEMA)
    return whitening.whiten(table.repartition(3), components).toPandas()


def check(got, rows, components=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in vector] for _, vector in rows], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    trace = values.sum()
    assert set(got.n) == {n} and set(got.component) == set(range(1, components + 1))
    deviation = dict(zip([key for key, _ in rows], ((n * x - sums) ** 2).sum(axis=1), strict=True))
    for row in got.itertuples():
        assert row.deviation == deviation[row.vec_id]
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[key for key, _ in rows]].to_numpy()
    want = centred @ axes[:, :components] / np.sqrt(values[:components])
    assert np.allclose(np.abs(np.sum(table * want, axis=0)), n, rtol=1e-6)
    assert np.allclose(table.T @ table / n, np.eye(components), atol=1e-9)
    by = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(by, values[:components] / trace, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_components_match_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) + rng.normal(size=12) * 50
    rows = [(i, [float(np.float32(c)) for c in line]) for i, line in enumerate(data)]
    check(whitened(spark, rows), rows)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 40)
    rng = np.random.default_rng(2)
    rows = [(i, line.tolist()) for i, line in enumerate(rng.normal(size=(200, 10)).astype(np.float32))]
    check(whitened(spark, rows, 3), rows, 3)


def test_equal_deviations_are_all_found():
    # Three singular values of 5 and two of 1: a Krylov space of one start holds each once only.
    rng = np.random.default_rng(3)
    left, right = np.linalg.qr(rng.normal(size=(60, 5)))[0], np.linalg.qr(rng.normal(size=(5, 5)))[0]
    a = left @ np.diag([5.0, 5, 5, 1, 1]) @ right.T

    def products(w, earlier):
        u = a @ w
        return (a @ earlier).T @ u, float(u @ u), a.T @ u

    axes, values = whitening.bidiagonalise(products, 5, float(np.linalg.norm(a)))
    assert np.allclose(values, [5, 5, 5, 1, 1]) and np.allclose(axes.T @ axes, np.eye(5))
    assert np.allclose(np.linalg.norm(a @ axes, axis=0), values)


@pytest.mark.parametrize("rank", [0, 1, 3])
def test_directions_without_deviation_are_left_out(spark, rank):
    rng = np.random.default_rng(4)
    data = np.round(rng.integers(-20, 20, size=(50, rank)) @ rng.integers(-3, 4, size=(rank, 6))) if rank else np.ones((50, 6))
    rows = [(i, line.tolist()) for i, line in enumerate(data.astype(float))]
    got = whitened(spark, rows)
    assert len(got) == 50 * rank
    if rank:
        check(got, rows, rank)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, line.tolist()) for i, line in enumerate(rng.normal(size=(40, 4)).astype(np.float32))]
    odd = [(100, None), (101, [1.0, None, 0.0, 2.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0])]
    odd += [(104, []), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0, 0.0])]
    got = whitened(spark, good + odd, 4)
    assert set(got.vec_id) == set(range(40))
    check(got, good, 4)
    twice = whitened(spark, good + good[:1] + [(None, good[1][1])], 2)
    assert len(twice) == 84 and twice.vec_id.isna().sum() == 2 and (twice.vec_id == 0).sum() == 4
    assert len(whitened(spark, [])) == 0 and len(whitened(spark, [(1, None)])) == 0
    assert len(whitened(spark, good[:1])) == 0


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [float(np.float32(10.0**14 * (i - 3))), float(np.float32(10.0**13 * (i % 4)))]) for i in range(8)]
    got = whitened(spark, rows, 2)
    assert len(got) == 16 and got.deviation.isna().sum() > 0
    assert got.groupby("component").whitened.apply(lambda c: (c**2).mean()).round(6).eq(1.0).all()
