"""From raw evaluation results to tables of normalised scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.order import exact_quantiles

# Score of random guessing per task.
TASK_BASELINES = {
    "anli_r1": 1 / 3,
    "anli_r2": 1 / 3,
    "anli_r3": 1 / 3,
    "arc_challenge": 1 / 4,
    "arc_easy": 1 / 4,
    "boolq": 1 / 2,
    "cb": 1 / 3,
    "copa": 1 / 2,
    "hellaswag": 1 / 4,
    "piqa": 1 / 2,
    "rte": 1 / 2,
    "sciq": 1 / 4,
    "storycloze_2016": 1 / 4,
    "winogrande": 1 / 2,
    "babi": 0.0,
}

# Language pairs that make separate tasks, first match wins.
LANGUAGE_PAIRS = ("en-fr", "fr-en", "hi-en", "en-hi")

SHOTS = 6
TASKS = 19
LONG = ["dataset", "fewshots", "prompt", "metric", "value"]


def flatten_harness(raw: DataFrame) -> DataFrame:
    """Results of the first kind: one row per task, shots, prompt and metric.

    ``raw`` has ``config.num_fewshot``, ``results`` (array of maps of variants)
    and ``file``. Only fields that are numbers in the file are kept; a text that
    looks like one and a truth value are none.
    """
    prompt = F.try_variant_get(F.col("entry")["prompt_name"], "$", "string")
    task = F.try_variant_get(F.col("entry")["task_name"], "$", "string")
    pair = F.lit("")
    for language_pair in reversed(LANGUAGE_PAIRS):
        pair = F.when(prompt.contains(language_pair), F.lit("_" + language_pair)).otherwise(pair)
    entries = raw.select(
        "file", F.col("config.num_fewshot").cast("int").alias("fewshots"), F.explode("results").alias("entry")
    )
    return (
        entries.select(
            "file",
            F.concat(task, pair).alias("dataset"),
            "fewshots",
            prompt.alias("prompt"),
            F.explode("entry").alias("metric", "raw_value"),
        )
        .filter(F.schema_of_variant("raw_value").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"))
        .withColumn("value", F.try_variant_get("raw_value", "$", "double"))
        .select("file", *LONG)
    )


def flatten_template(raw: DataFrame) -> DataFrame:
    """Results of the second kind: one evaluation map per dataset and template."""
    return raw.select(
        "file",
        F.concat_ws("_", F.coalesce("dataset_name", F.lit("None")), F.coalesce("dataset_config_name", F.lit("None"))).alias("dataset"),
        F.lit(0).alias("fewshots"),
        F.col("template_name").alias("prompt"),
        F.explode("evaluation").alias("metric", "value"),
    ).select("file", "dataset", "fewshots", "prompt", F.concat(F.lit("evaluation."), "metric").alias("metric"), F.col("value").cast("double").alias("value"))


def merge_results(*flat: DataFrame) -> DataFrame:
    """All flattened results; the last file wins for each metric."""
    stacked = flat[0]
    for frame in flat[1:]:
        stacked = stacked.unionByName(frame)
    return stacked.groupBy("dataset", "fewshots", "prompt", "metric").agg(
        F.max_by("value", "file").alias("value")
    )


def pick_metrics(merged: DataFrame) -> DataFrame:
    """The reported metric of every prompt.

    All evaluation metrics where there is an evaluation; otherwise the ROUGE-2
    score; otherwise the accuracy.
    """
    by_prompt = merged.groupBy("dataset", "fewshots", "prompt").agg(
        F.bool_or(F.col("metric").startswith("evaluation.")).alias("evaluated"),
        F.bool_or(F.col("metric") == "rouge2_fmeasure").alias("generated"),
    )
    wanted = (
        F.when(F.col("evaluated"), F.col("metric").startswith("evaluation."))
        .when(F.col("generated"), F.col("metric") == "rouge2_fmeasure")
        .otherwise(F.col("metric") == "acc")
    )
    return (
        merged.join(by_prompt, ["dataset", "fewshots", "prompt"])
        .filter(wanted)
        .withColumn("metric", F.regexp_replace("metric", r"^evaluation\.", ""))
        .withColumn("dataset", F.element_at(F.split("dataset", "/", -1), -1))
        .select(*LONG)
    )


def score_table(detail: DataFrame) -> DataFrame:
    """Detail rows plus a median row per dataset and shots and an average row.

    The median is over the accuracies, or the ROUGE scores where there are no
    accuracies. The average of the medians is labelled with the highest number
    of shots.
    """
    kind = F.when(F.col("metric").isin("acc", "accuracy"), "accuracy").when(
        F.col("metric").isin("bleu", "rouge2_fmeasure"), F.col("metric")
    )
    kinds = detail.select("dataset", "fewshots", kind.alias("kind"), "value").filter("kind is not null")
    # The kinds in the order of their names: accuracy, bleu, rouge2_fmeasure.
    medians = (
        exact_quantiles(kinds, "value", {"median": 0.5}, ["dataset", "fewshots", "kind"])
        .groupBy("dataset", "fewshots")
        .agg(F.min(F.struct("kind", "median")).alias("first"))
        .select(
            "dataset",
            "fewshots",
            F.lit("median").alias("prompt"),
            F.col("first.kind").alias("metric"),
            F.col("first.median").alias("value"),
        )
    )
    labels = detail.groupBy("dataset").agg(F.max("fewshots").alias("fewshots"))
    averages = (
        medians.groupBy("dataset")
        .agg(F.avg("value").alias("value"))
        .join(labels, "dataset")
        .select("dataset", "fewshots", F.lit("average").alias("prompt"), F.lit("multiple").alias("metric"), "value")
    )
    return detail.select(*LONG).unionByName(medians).unionByName(averages)


def ordered_scores(scores: DataFrame) -> DataFrame:
    return scores.orderBy("dataset", "fewshots", "prompt", "metric")


def without_summaries(scores: DataFrame) -> DataFrame:
    """Drop the rows that summarise others."""
    return scores.filter(~F.col("prompt").isin("median", "average"))


def baselines(spark) -> DataFrame:
    return spark.createDataFrame(list(TASK_BASELINES.items()), "task string, baseline double")


def attach_baseline(scores: DataFrame, base: DataFrame) -> DataFrame:
    """Add the baseline of each task; a task without one is an error."""
    unknown = F.concat(F.lit("no baseline for task: "), F.coalesce("task", F.lit("null")))
    known = F.when(F.col("baseline").isNotNull(), F.col("baseline")).otherwise(F.raise_error(unknown).cast("double"))
    return scores.join(F.broadcast(base), "task", "left").withColumn("baseline", known)


def normalized_score(value: Column, baseline: Column) -> Column:
    """Rescale so that random guessing is 0 and perfect is 1."""
    return (value - baseline) / (F.lit(1.0) - baseline)


def normalize_scores(rank: DataFrame, generation: DataFrame, base: DataFrame) -> DataFrame:
    """Long table ``(model, shot, task, score)`` of ranked and generated tasks.

    Ranked tasks are rescaled by their baseline, generation scores have none.
    A repeated (model, shot, task) raises an error instead of being overwritten.
    """
    ranked = attach_baseline(rank.filter(F.col("metric") == "acc"), base).select(
        "model", "shot", "task", normalized_score(F.col("value"), F.col("baseline")).alias("score")
    )
    generated = without_summaries(generation).select(
        "model", F.col("fewshots").alias("shot"), F.col("dataset").alias("task"), F.col("value").alias("score")
    )
    return unique_scores(ranked.unionByName(generated))


def unique_scores(scores: DataFrame) -> DataFrame:
    repeated = F.concat(F.lit("repeated score: "), F.concat_ws(", ", "model", F.col("shot").cast("string"), "task"))
    return (
        scores.groupBy("model", "shot", "task")
        .agg(F.count("*").alias("copies"), F.first("score").alias("score"))
        .withColumn("score", F.when(F.col("copies") == 1, F.col("score")).otherwise(F.raise_error(repeated).cast("double")))
        .drop("copies")
    )


def fill_missing(scores: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Add a default score for the named tasks where a model and shot lack them."""
    if not defaults:
        return scores
    entries = [F.struct(F.lit(task).alias("task"), F.lit(float(value)).alias("score")) for task, value in defaults.items()]
    wanted = (
        scores.select("model", "shot")
        .distinct()
        .select("model", "shot", F.inline(F.array(*entries)))
    )
    missing = wanted.join(scores, ["model", "shot", "task"], "left_anti")
    return scores.unionByName(missing)


def mean_over_shots(scores: DataFrame, shots: int = SHOTS) -> DataFrame:
    """Mean over shots for the tasks that have all of them."""
    return (
        scores.groupBy("model", "task")
        .agg(F.avg("score").alias("score"), F.count_distinct("shot").alias("shots"))
        .filter(F.col("shots") == shots)
        .drop("shots")
    )


def seed_family(scores: DataFrame, model: str = "model") -> DataFrame:
    """Split a model name into ``base`` and ``seed`` (0 when it names none)."""
    seed = F.regexp_extract(model, r"seed(\d+)$", 1)
    return scores.withColumn("base", F.regexp_replace(model, r"seed\d+$", "")).withColumn(
        "seed", F.coalesce(seed.try_cast("int"), F.lit(0))
    )


def over_seeds(scores: DataFrame, keys: Sequence[str] = ("base", "task"), column: str = "score") -> DataFrame:
    """Mean and population standard deviation over a model and its seeds."""
    return scores.groupBy(*keys).agg(
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("std"),
        F.count("*").alias("seeds"),
    )


def score_rows(scores: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """``(base, task, mean, std)`` in percent, with an ``Average`` row per base.

    The average row takes the mean over all shots and tasks of each seed first,
    then mean and deviation over the seeds; ``drop`` leaves tasks out of it.
    """
    per_task = over_seeds(seed_family(mean_over_shots(scores)))
    overall = (
        scores.filter(~F.col("task").isin(*drop)) if drop else scores
    ).groupBy("model").agg(F.avg("score").alias("score")).withColumn("task", F.lit("Average"))
    both = per_task.unionByName(over_seeds(seed_family(overall)))
    return both.select(
        "base",
        "task",
        F.round(F.col("mean") * 100, 1).alias("mean"),
        F.round(F.col("std") * 100, 1).alias("std"),
    )


def score_matrix(
    scores: DataFrame, models: Sequence[str], drop: Sequence[str] = ()
) -> DataFrame:
    """Wide table task x model of ``mean ± std`` texts; one group, no extra pass."""
    cell = F.concat_ws(" ± ", F.col("mean").cast("string"), F.col("std").cast("string"))
    return (
        score_rows(scores, drop)
        .withColumn("cell", cell)
        .groupBy("task")
        .pivot("base", list(models))
        .agg(F.first("cell"))
    )


def check_complete(scores: DataFrame, tasks: int = TASKS) -> DataFrame:
    """(model, shot) pairs that do not have all tasks; empty when complete."""
    return (
        scores.groupBy("model", "shot")
        .agg(F.count_distinct("task").alias("tasks"))
        .filter(F.col("tasks") != tasks)
    )


def strategy_series(scores: DataFrame, facts: DataFrame, reference_budget: float = 84e9) -> DataFrame:
    """Score against data budget for each strategy.

    ``facts`` is ``(model, strategy, tokens)``; the budget is given in percent
    of the reference budget. Models without facts keep a null strategy and a
    null budget.
    """
    named = scores.join(facts, "model", "left")
    per_model = named.groupBy("strategy", "tokens", "model").agg(F.avg("score").alias("score"))
    return (
        per_model.withColumn("budget_pct", F.col("tokens") / F.lit(reference_budget) * 100)
        .groupBy("strategy", "budget_pct")
        .agg(
            F.avg("score").alias("mean"),
            F.stddev_pop("score").alias("std"),
            F.count("*").alias("models"),
        )
    )
