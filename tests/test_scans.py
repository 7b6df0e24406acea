"""Running values and neighbours against plain loops, however the rows are spread."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpuslab.operators import curves, profile, ranges, scans, trainlogs


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    data = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([None, *range(40)])) for i in range(600)]
    rng.shuffle(data)
    return data


def by_group(data):
    groups = {}
    for group, at, value in sorted(data, key=lambda row: row[1]):
        groups.setdefault(group, []).append((at, value))
    return groups


@pytest.mark.parametrize("partitions", [1, 7, 60])
@pytest.mark.parametrize("step", ["min", "max", "last"])
@pytest.mark.parametrize("before", [False, True])
def test_running(spark, points, partitions, step, before):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(points, "g string, at bigint, v bigint")
        got = {(r.g, r.at): r.running for r in scans.running(df, "v", "at", step, ["g"], before=before).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    fold = {"min": min, "max": max, "last": lambda values: values[-1]}[step]
    want = {}
    for group, line in by_group(points).items():
        for i, (at, _) in enumerate(line):
            seen = [v for _, v in line[: i if before else i + 1] if v is not None]
            want[group, at] = fold(seen) if seen else None
    assert got == want


@pytest.mark.parametrize("partitions", [1, 60])
def test_neighbours(spark, points, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(points, "g string, at bigint, v bigint")
        got = {(r.g, r.at): (r.previous, r.following) for r in scans.neighbours(df, "v", "at", ["g"]).collect()}
        whole = {r.at: (r.previous, r.following) for r in scans.neighbours(df, "v", "at").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {}
    for group, line in by_group(points).items():
        values = [None, *(v for _, v in line), None]
        want |= {(group, at): (values[i], values[i + 2]) for i, (at, _) in enumerate(line)}
    assert got == want
    values = [None, *(v for _, _, v in sorted(points, key=lambda row: row[1])), None]
    assert whole == {i: (values[i], values[i + 2]) for i in range(len(points))}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, at bigint, v bigint")
    assert scans.running(df, "v", "at", "min", ["g"]).count() == 0
    assert scans.neighbours(df, "v", "at", ["g"]).count() == 0
    positions = spark.createDataFrame([(3,)], "pos bigint")
    offsets = spark.createDataFrame([], "doc_id bigint, start bigint, end bigint")
    assert rows(ranges.assign_document(positions, offsets)) == [(3, None, None)]


def test_positions_in_one_spot(spark):
    spans = [(i, i * 10, i * 10 + i % 3 * 4) for i in range(50)]
    places = [(241, n) for n in range(300)] + [(p, -1) for p in range(520)] + [(None, 0)]
    offsets = spark.createDataFrame(spans, "doc_id bigint, start bigint, end bigint")
    got = ranges.assign_document(spark.createDataFrame(places, "pos bigint, n bigint"), offsets)
    want = []
    for pos, n in places:
        held = [(d, pos - s) for d, s, e in spans if pos is not None and s <= pos < e]
        want.append((pos, n, *(held[0] if held else (None, None))))
    key = lambda row: tuple(-1 if value is None else value for value in row)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_turning_points(spark):
    line = [1, 3, 2, 2, 5, 4, None, 6, 1, 2]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(line)], "run string, step bigint, value bigint")
    got = curves.turning_points(df, ["run"], "step", "value")
    assert rows(got.select("step", "kind")) == [(1, "peak"), (4, "peak"), (8, "valley")]


def test_last_of_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1)], "k string, at bigint")
    assert rows(profile.last_of_groups(df, ["k"], "at", 3)) == [("a", 197), ("a", 198), ("a", 199), ("b", 1)]


def test_run_summary(spark):
    schema = "run string, iteration bigint, line bigint, lm_loss double, samples_per_second double, tflops double"
    calm = [("calm", i, i, 5.0 - i / 10, 1.0, 2.0) for i in range(1, 20)]
    # Starts anew at iteration 6; what was logged before for 6 to 9 no longer counts.
    again = [("again", i, i, 3.0, 1.0, 2.0) for i in range(1, 10)] + [("again", i, i + 20, 2.0, 3.0, 2.0) for i in range(6, 12)]
    burst = [("burst", i, i, 2.0 if i < 15 else 9.0, 1.0, 2.0) for i in range(1, 17)]
    broken = [("broken", 1, 1, 2.0, 1.0, 2.0), ("broken", 2, 2, float("nan"), 1.0, 2.0)]
    silent = [("silent", 1, 1, None, 1.0, 2.0)]
    df = spark.createDataFrame(calm + again + burst + broken + silent, schema)
    got = {r.run: r for r in trainlogs.run_summary(df, ["line"], tail=5, limit=1.5).collect()}
    assert {run: r.restarts for run, r in got.items()} == {"calm": 0, "again": 1, "burst": 0, "broken": 0, "silent": 0}
    assert {run: r.blown_up for run, r in got.items()} == {
        "calm": False, "again": False, "burst": True, "broken": True, "silent": None
    }
    assert got["again"].iterations == 11 and got["again"].last_loss == 2.0 and got["again"].last_iteration == 11
    assert got["again"].samples_per_second == pytest.approx((5 * 1 + 6 * 3) / 11)
    assert got["calm"].best_loss == pytest.approx(3.1) and got["calm"].tail_spread == pytest.approx(0.4)
    assert df.filter(F.lit(False)).count() == trainlogs.run_summary(df.limit(0), ["line"]).count() == 0
