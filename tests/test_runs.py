import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpuslab.functions import laws
from corpuslab.operators import curves, runs, scores, sweeps, trainlogs
from corpuslab.sources import corpus, evaluations, logs


def test_published_predictions(spark):
    df = spark.createDataFrame(
        [(6.34e9, 242e9, 25e9), (8.67e9, 178e9, 25e9)], "params double, tokens double, unique_tokens double"
    )
    got = [r["predicted"] for r in sweeps.predict(df).collect()]
    assert got == pytest.approx([2.2256440889984477, 2.2269634075087867], rel=1e-12)
    plain = df.select(laws.predicted_loss(F.col("params"), F.col("tokens"), F.col("unique_tokens")).alias("x"))
    assert [r["x"] for r in plain.collect()] == pytest.approx(got, rel=1e-14)


def test_published_allocation(spark):
    df = spark.createDataFrame([(1e22, 25e9)] * 2, "compute double, unique_budget double")
    got = sweeps.optimal_allocation(df).collect()
    assert len(got) == 2
    for r in got:
        assert r["tokens"] == pytest.approx(237336955477.55075, rel=1e-9)
        assert r["params"] == pytest.approx(7022364735.879969, rel=1e-9)
        assert r["epochs"] == pytest.approx(9.49347821910203, rel=1e-9)


def test_allocation_makes_no_row_of_a_candidate(spark):
    """The best of all candidates, as plain SQL functions find it, without a row for each."""
    data = [(1e22, 25e9), (1e22, 25e9), (3e20, 4e12), (7e23, 1e8), (None, 1e9), (1e21, None)]
    df = spark.createDataFrame(data, "compute double, unique_budget double")
    for law in (laws.C4_LAW, laws.MASSIVE_TEXT_LAW):
        found = sweeps.optimal_allocation(df, law, 1.001, 3.0, 20, with_start=True)
        start = sweeps.optimal_nd(df.distinct().dropna(), law)
        sizes = [1.001 + i * 1.999 / 19 for i in range(20)]
        factors = [1 / size for size in reversed(sizes)] + [1.0] + sizes  # of equal losses the last counts
        tried = start.withColumn("f", F.explode(F.array(*map(F.lit, factors))))
        d, n = F.col("opt_tokens") * F.col("f"), F.col("opt_params") / F.col("f")
        tried = tried.withColumn("x", laws.predicted_loss(n, d, F.least("unique_budget", d), law))
        want = {r[0]: r[1:] for r in tried.groupBy("compute").agg(F.min("x"), F.min_by(d, "x")).collect()}
        got = [(r.compute, r.loss, r.tokens) for r in found.collect()]
        assert len(got) == 4 and {r[0] for r in got} == set(want)
        assert all(r[1:] == pytest.approx(want[r[0]], rel=1e-12) for r in got)
    plans, kept = [], sweeps.materialize
    sweeps.materialize = lambda made: plans.append(made._jdf.queryExecution().optimizedPlan().toString()) or kept(made)
    try:
        sweeps.optimal_allocation(df).collect()
    finally:
        sweeps.materialize = kept
    assert plans and not any("explode" in plan for plan in plans)


def test_inverses_of_the_optimal_line(spark):
    law = laws.C4_LAW
    c = F.lit(1e21)
    row = spark.range(1).select(
        laws.compute_for_tokens(laws.optimal_tokens(c, law), law).alias("d"),
        laws.compute_for_params(laws.optimal_params(c, law), law).alias("n"),
        (laws.params_for_tokens(laws.optimal_tokens(c, law), law) / laws.optimal_params(c, law)).alias("line"),
    ).first()
    assert tuple(row) == pytest.approx((1e21, 1e21, 1.0), rel=1e-9)


def test_goodness_is_one_minus_residual_share(spark):
    data = [("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 4.0, 3.0)]
    df = spark.createDataFrame(data, "law string, loss double, predicted double")
    y, f = np.array([1, 2, 4.0]), np.array([1.5, 2, 3])
    want = 1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert sweeps.goodness(df).first()["r2"] == pytest.approx(want)


def test_grid_fit_finds_the_constants_behind_the_data(spark):
    points = [(1e8 * 3**i, 1e9 * 2**j, 1e9) for i in range(4) for j in range(5)]
    df = spark.createDataFrame(points, "params double, tokens double, unique_tokens double")
    exact = sweeps.predict(df, "constrained", laws.C4_LAW.with_stars(12.0, 6.0), "loss")
    axes = {"d_star": [0.5, 5.0, 10.0, 15.0, 20.0], "n_star": [0.5, 5.0, 10.0, 15.0, 20.0]}
    best = sweeps.grid_fit(exact, axes, rounds=5).first()
    # The objective is flat along a valley, so values are compared, not constants.
    coarse = sweeps.objective(exact, sweeps.parameter_grid(axes)).agg(F.min("objective")).first()[0]
    assert best["objective"] < coarse / 5
    assert best["d_star"] == pytest.approx(12.0, abs=2.0)
    assert best["n_star"] == pytest.approx(6.0, abs=1.0)
    grid = sweeps.parameter_grid({"alpha": [0.1, 0.2], "beta": [9.0]}, tie=True)
    assert [(g[4], g[5]) for g in grid] == [(0.1, 0.1), (0.2, 0.2)]


def test_shape_formulas(spark):
    row = spark.range(1).select(
        sweeps.architecture_params(F.lit(128.0), F.lit(3.0), F.lit(512.0)).alias("p"),
        sweeps.architecture_flops(F.lit(2048.0), F.lit(128.0), F.lit(4.0), F.lit(3.0), F.lit(512.0)).alias("f"),
    ).first()
    layer = 4 * 128**2 + 4 * 128 + 2 * 512 * 128 + 512 + 128 + 2 * 128
    assert row["p"] == 3 * layer + 128 * 32000 + 32000 + 2048 * 128
    s, h = 2048, 128
    per_layer = 6 * s * h * h + 2 * s * s * h + 3 * 4 * s * s + 2 * s * s * h + 2 * s * h * h + 4 * s * h * 512
    assert row["f"] == 3 * (2 * 2 * s * 32000 * h + 3 * per_layer)


@pytest.mark.parametrize(
    "name,params,tokens,unique",
    [
        ("2b855b1b25", 2.81e9, 55e9, 1.25e9),
        ("8b7178b25b", 8.67e9, 178e9, 25e9),
        ("146m14b400m", 1.465e8, 14e9, 0.4e9),
        ("4b284b84bc4v2seed1", 4.2465e9, 84e9, 84e9),
        ("2b855b4bop2", 2.81e9, 55e9, 4e9),
        ("146m5b9100m", 1.465e8, 5.9e9, 0.1e9),
    ],
)
def test_run_names(spark, name, params, tokens, unique):
    df = spark.createDataFrame([(name, 2.5)], "name string, loss double")
    row = runs.parse_runs(df).first()
    assert (row["params"], row["tokens"], row["unique_tokens"]) == pytest.approx((params, tokens, unique))


def test_run_checks_and_twins(spark):
    data = [("146m5b9100m", 3.9), ("146m5b9100mdedup", 3.7), ("2b855b1b25", 0.0)]
    df = spark.createDataFrame(data, "name string, loss double")
    assert [r["name"] for r in runs.valid_runs(df).collect()] == ["146m5b9100m"]
    assert [tuple(r) for r in runs.pair_twins(df).collect()] == [("146m5b9100m", 3.9, 3.7)]
    bad = spark.createDataFrame([("x", 1.0, 2.0)], "name string, tokens double, unique_tokens double")
    with pytest.raises(Exception, match="more unique"):
        runs.check_runs(bad).collect()


def test_smoothing_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(curves, "CHUNK", 4)
    values = [float((7 * i) % 11) for i in range(23)]
    data = [("r", i, v) for i, v in enumerate(values)] + [("one", 5, 3.0)]
    df = spark.createDataFrame(data, "run string, step bigint, value double")
    got = {(r["run"], r["step"]): r["smoothed"] for r in curves.ema(df, ["run"], "step", "value", 0.85).collect()}
    last = values[0]
    for i, v in enumerate(values):
        last = last * 0.85 + (1 - 0.85) * v
        assert got[("r", i)] == pytest.approx(last, rel=1e-12)
    assert got[("one", 5)] == pytest.approx(3.0)


def test_score_rules(spark):
    data = [
        ("a/x", 0, "p1", "acc", 0.2), ("a/x", 0, "p2", "acc", 0.6), ("a/x", 2, "p1", "acc", 0.8),
        ("a/x", 0, "p1", "acc_norm", 0.9), ("b", 1, "p", "rouge2_fmeasure", 0.3), ("b", 1, "p", "acc", 0.9),
        ("c", 0, "t", "evaluation.accuracy", 0.5),
    ]
    merged = spark.createDataFrame(data, "dataset string, fewshots int, prompt string, metric string, value double")
    table = {tuple(r)[:4]: r["value"] for r in scores.score_table(scores.pick_metrics(merged)).collect()}
    assert table[("x", 0, "median", "accuracy")] == pytest.approx(0.4)
    assert table[("x", 2, "average", "multiple")] == pytest.approx(0.6)
    assert table[("b", 1, "median", "rouge2_fmeasure")] == pytest.approx(0.3)
    assert ("x", 0, "p1", "acc_norm") not in table and table[("c", 0, "t", "accuracy")] == 0.5


def test_models_without_facts_stay_in_the_series(spark):
    table = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 5.0)], "model string, score double")
    facts = spark.createDataFrame([("a", "repeat", 84e9)], "model string, strategy string, tokens double")
    got = {tuple(row) for row in scores.strategy_series(table, facts).collect()}
    assert got == {("repeat", 100.0, 1.0, 0.0, 1), (None, None, 4.0, 1.0, 2)}


def test_repeated_scores_fail_and_seeds_use_population_deviation(spark):
    twice = spark.createDataFrame([("m", 0, "t", 0.1), ("m", 0, "t", 0.2)], "model string, shot int, task string, score double")
    with pytest.raises(Exception, match="repeated score"):
        scores.unique_scores(twice).collect()
    data = [("m", "t", 1.0), ("mseed1", "t", 3.0)]
    family = scores.seed_family(spark.createDataFrame(data, "model string, task string, score double"))
    assert rows(scores.over_seeds(family)) == [("m", "t", 2.0, 1.0, 2)]


def test_result_files(spark, tmp_path):
    deep = tmp_path / "model" / "deep"
    deep.mkdir(parents=True)
    first = {"config": {"num_fewshot": 2}, "results": [{"task_name": "wmt", "prompt_name": "p en-fr", "acc": 0.5, "note": "x"}]}
    (deep / "slim.json").write_text(json.dumps(first, indent=1))
    (deep / "agg.json").write_text(json.dumps(first))
    second = {"dataset_name": "d", "dataset_config_name": "c", "template_name": "t", "evaluation": {"accuracy": 0.25}}
    (tmp_path / "other.json").write_text(json.dumps(second, indent=1))
    got = rows(evaluations.read_eval_json(spark, str(tmp_path)))
    assert got == [("d_c", 0, "t", "evaluation.accuracy", 0.25), ("wmt_en-fr", 2, "p en-fr", "acc", 0.5)]


def test_corpus_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é ➝", "{}"), (2, "x" * 20, "{}")], corpus.CORPUS_SCHEMA)
    corpus.write_jsonl(corpus.cap_length(df, 10), str(tmp_path / "j"))
    raw = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert raw.strip() == '{"text":"é ➝"}'
    assert corpus.read_corpus(spark, str(tmp_path / "j")).first()["text"] == "é ➝"
    corpus.write_table(df, str(tmp_path / "p"))
    assert corpus.read_corpus(spark, str(tmp_path / "p"), "parquet").count() == 2
    detail = spark.createDataFrame([("d", 0, "p", "acc", 0.5)], "dataset string, fewshots int, prompt string, metric string, value double")
    corpus.write_scores(detail, str(tmp_path / "s"))
    assert tuple(corpus.read_scores(spark, str(tmp_path / "s")).first())[:5] == ("d", 0, "p", "acc", 0.5)
    (tmp_path / "run1_training.csv").write_text(",run,tag,step,value\n0,.,t,5,2.5\n")
    assert rows(corpus.read_curves(spark, str(tmp_path / "run1_training.csv"))) == [("run1", "t", 5, 2.5)]


def test_log_lines(spark, tmp_path):
    line = (
        "0:  iteration     1400/  148693 | consumed samples:       179200 | consumed tokens:    367001600 | "
        "elapsed time per iteration (s): 29.52 | learning rate: 1.449E-04 | global batch size:   128 | "
        "loss scale: 1.0 | grad norm: 2.698 | num zeros: 0.0 | number of skipped iterations:   0 | "
        "number of nan iterations:   0 | samples per second: 4.336 | TFLOPs: 31.35 |"
    )
    text = [line, "0:   adam_beta1 ...................................... 0.9", "x: Segmentation fault", "3: Segmentation fault"]
    text += ["0: Launching on nid7 (3/4), master nid7 port 9999"] + ["1: Grad overflow on iteration: 132"] * 3
    (tmp_path / "a.out").write_text("\n".join(text))
    lines = logs.read_logs(spark, str(tmp_path / "a.out"))
    row = trainlogs.iteration_records(lines).first()
    assert (row["run"], row["iteration"], row["tokens"], row["lm_loss"], row["tflops"]) == ("a", 1400, 367001600, None, 31.35)
    assert rows(trainlogs.run_arguments(lines)) == [("a", "adam_beta1", "0.9")]
    assert rows(trainlogs.overflow_events(lines)) == [("a", 132)]
    assert rows(trainlogs.error_nodes(lines, lines)) == [("nid7", 3, "3: Segmentation fault")]
    assert [r["value"] for r in trainlogs.unranked_errors(lines).collect()] == ["x: Segmentation fault"]


def test_ranks_of_several_runs(spark):
    schema = "run string, value string"
    launches = [("a", "0: Launching on n1 (0/2), x"), ("a", "0: Launching on n2 (1/2), x"), ("b", "0: Launching on n3 (1/4), x")]
    errors = [("a", "1: Segmentation fault"), ("b", "1: Segmentation fault"), ("b", "2: Segmentation fault")]
    found = trainlogs.error_nodes(spark.createDataFrame(errors, schema), spark.createDataFrame(launches, schema))
    assert sorted(found.select("rank", "node").collect(), key=str) == [(1, "n2"), (1, "n3"), (2, None)]
    uneven = spark.createDataFrame(launches[:1] + [("a", "0: Launching on n2 (1/3), x")], schema)
    with pytest.raises(Exception, match="number of ranks"):
        trainlogs.node_ranks(uneven).collect()
    twice = spark.createDataFrame(launches[:1] * 2, schema)
    with pytest.raises(Exception, match="several nodes for rank"):
        trainlogs.node_ranks(twice.drop("run")).collect()


def test_unknown_runs_are_kept(spark):
    df = spark.createDataFrame([("2b855b1b25", 2.5), ("zz9", 2.0)], "name string, loss double")
    parsed = runs.check_runs(runs.parse_runs(df))
    assert parsed.count() == 2
    assert [r["name"] for r in runs.unknown_runs(parsed).collect()] == ["zz9"]


def test_best_shapes_are_kept_without_sorting_all(spark, monkeypatch):
    """Every shape of every budget is scored; only the number of the best one is held, ties and copies included."""
    shapes = [("small", 512, 2048, 64, 8, 8), ("wide", 1024, 4096, 64, 16, 4), ("deep", 512, 2048, 64, 8, 24), ("again", 512, 2048, 64, 8, 24)]
    data = [(1, 1e18, 1e8), (2, 1e18, 1e8), (3, 1e20, 1e9), (4, 1e21, 5e7)]
    plans, kept = [], sweeps.materialize

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(sweeps, "materialize", watched)
    found = sweeps.plan_runs(spark.createDataFrame(data, "id bigint, compute double, unique_budget double"), shapes)
    got = {r["id"]: r for r in found.collect()}
    assert not any("SortAggregate" in plan for plan in plans)
    assert sorted(got) == [1, 2, 3, 4]
    sized = spark.createDataFrame([(name, float(h), float(f), float(n)) for name, h, f, _, _, n in shapes], "shape string, h double, f double, n double")
    sized = sized.withColumn("params", sweeps.architecture_params(F.col("h"), F.col("n"), F.col("f"))).crossJoin(
        spark.createDataFrame(data, "id bigint, compute double, u double")
    )
    tokens = F.col("compute") / 6 / F.col("params")
    loss = laws.predicted_loss(F.col("params"), tokens, F.least("u", tokens)).alias("loss")
    for key in got:
        tried = sorted((r["loss"], r["shape"]) for r in sized.filter(F.col("id") == key).select("shape", loss).collect())
        assert got[key]["loss"] == pytest.approx(tried[0][0], rel=1e-12)
        assert got[key]["shape"] in {shape for value, shape in tried if value == pytest.approx(tried[0][0], rel=1e-12)}
