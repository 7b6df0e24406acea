import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpuslab.operators import order, profile, ranges, sampling
from corpuslab.operators import skew
from corpuslab.operators.skew import join_counted, possible


def numbers(spark, n=200, seed=3):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 9), rng.randint(1, 50)) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_running_total_does_not_depend_on_partitions(spark, parts):
    data = numbers(spark)
    df = spark.createDataFrame(data, "id bigint, k int, v bigint").repartition(parts)
    got = {r["id"]: r["running"] for r in order.running_total(df, "v", ["k", "id"]).collect()}
    total, want = 0, {}
    for i, k, v in sorted(data, key=lambda row: (row[1], row[0])):
        total += v
        want[i] = total
    assert got == want


def test_quantiles_are_linear_and_exact(spark):
    data = numbers(spark)
    df = spark.createDataFrame(data, "id bigint, k int, v bigint")
    got = {r["k"]: (r["p25"], r["p50"]) for r in profile.percentiles(df, "v", [25, 50], ["k"]).collect()}
    for k in {row[1] for row in data}:
        values = [row[2] for row in data if row[1] == k]
        assert got[k] == pytest.approx(tuple(np.percentile(values, [25, 50])))
    small = spark.createDataFrame([(1,), (2,), (4,), (8,)], "v bigint")
    assert rows(profile.percentiles(small, "v", [25])) == [(1.75,)]
    assert rows(profile.rank_percentile(small, "v", [50])) == [(4,)]


def test_prefixes_nest_and_cut_exactly(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "doc_id bigint, text string")
    assert [r[0] for r in rows(sampling.head(df, 3))] == [0, 1, 2]
    assert [r[0] for r in rows(sampling.tail(df, 2))] == [8, 9]
    assert [r[0] for r in rows(sampling.all_but_tail(df, 8))] == [0, 1]
    assert sampling.tail(df, 99).count() == 10
    assert [r[0] for r in rows(sampling.split_range(df, 0.95, 1.0))] == []
    assert [r[0] for r in rows(sampling.split_range(df, 0.5, 0.8))] == [5, 6, 7]
    subsets = sampling.ratio_subsets(df, [0.0, 0.3, 1.0], ["none", "some", "all"])
    found = {r["doc_id"]: r["subsets"] for r in subsets.collect()}
    # A running size equal to the cut is already outside.
    assert found == {**{i: ["all", "some"] for i in (0, 1)}, **{i: ["all"] for i in range(2, 9)}}


def test_budgets(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "doc_id bigint, tokens bigint")
    assert sampling.take_budget(df, 35, "tokens").count() == 4
    assert sampling.take_budget(df, 1000, "tokens").count() == 10
    repeated = sampling.repeat_to_budget(df, 30, 75, "tokens")
    per_epoch = {r["epoch"]: r["count"] for r in repeated.groupBy("epoch").count().collect()}
    assert per_epoch == {0: 3, 1: 3, 2: 1}
    assert sampling.samples_for_budget(1.9e9, 478.625834583) == 3969698
    assert sampling.samples_for_budget(1.9e9, 1312.0951072) == 1448066
    assert sampling.shrunk_size(1500, 100_000) == 1000


def test_byte_offsets_and_positions(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "é"), (3, "")], "doc_id bigint, text string")
    offsets = order.byte_offsets(df, "doc_id")
    assert rows(offsets) == [(1, 6, 8), (2, 14, 16), (3, 22, 22)]
    positions = spark.createDataFrame([(6,), (7,), (8,), (15,), (22,)], "pos bigint")
    found = rows(ranges.assign_document(positions, offsets))
    assert found == [(6, 1, 0), (7, 1, 1), (8, None, None), (15, 2, 1), (22, None, None)]
    found = rows(ranges.assign_document(positions, offsets, separator_bytes=6))
    assert found == [(6, 1, 0), (7, 1, 1), (8, 1, 2), (15, 2, 1), (22, 3, 0)]


def test_merge_ranges(spark):
    data = [(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 1, 2), (2, 3, 4)]
    df = spark.createDataFrame(data, "doc_id bigint, start bigint, end bigint")
    assert rows(ranges.merge_ranges(df)) == [(1, 0, 7), (1, 9, 12), (2, 3, 4)]


def test_hot_keys_join_like_any_other(spark):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k bigint, v bigint")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    plain = left.join(right.drop("n"), "k")
    salted = join_counted(left, right, "k", "n")
    assert rows(salted.select("k", "v", "top")) == rows(plain.select("k", "v", "top"))


def test_row_index_and_relative(spark):
    df = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 8.0), ("b", 1, 0.0)], "run string, step bigint, value double")
    assert rows(profile.row_index(df, ["step"], ["run"])) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]
    got = profile.relative_to_first(df, ["run"], "step", "value")
    assert [r["relative"] for r in got.orderBy("run", "step").collect()] == [1.0, 2.0, None]


def test_possible_keys_lose_none(spark, monkeypatch):
    left = spark.createDataFrame([(i, str(i)) for i in range(3000)] + [(None, "x")], "k bigint, v string")
    wanted = spark.createDataFrame([(i * 7,) for i in range(100)] + [(None,)], "k bigint")
    met = {r["k"] for r in possible(left, wanted, "k").collect()}
    assert met >= {i * 7 for i in range(100)} and None not in met and len(met) < 200
    assert possible(left, wanted.limit(0), "k").count() == 0
    both = possible(left, left.filter("k % 100 = 0"), ["k", "v"])
    assert both.columns == ["k", "v"] and both.filter("k % 100 = 0").count() == 30
    monkeypatch.setattr(skew, "WORDS", 1)
    assert {i * 7 for i in range(100)} <= {r["k"] for r in possible(left, wanted, "k").collect()}
