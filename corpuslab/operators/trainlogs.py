"""Records out of the text logs of training runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.profile import last_of_groups
from corpuslab.operators.scans import neighbours
from corpuslab.session import materialize

# Fields of an iteration line, their column and type.
ITERATION_FIELDS = {
    "consumed samples": ("samples", "bigint"),
    "consumed tokens": ("tokens", "bigint"),
    "elapsed time per iteration (s)": ("seconds", "double"),
    "learning rate": ("learning_rate", "double"),
    "global batch size": ("batch_size", "bigint"),
    "lm loss": ("lm_loss", "double"),
    "loss scale": ("loss_scale", "double"),
    "grad norm": ("grad_norm", "double"),
    "number of skipped iterations": ("skipped", "bigint"),
    "number of nan iterations": ("nan", "bigint"),
    "samples per second": ("samples_per_second", "double"),
    "TFLOPs": ("tflops", "double"),
}

# What marks a line as a node failure.
ERROR_STRINGS = (
    "Segmentation fault",
    "Failed to initialize RSMI device mutex",
    "ERROR:torch.distributed.elastic.multiprocessing.api:failed",
)


def iteration_records(lines: DataFrame) -> DataFrame:
    """One typed row per iteration line, with its place in the log if it has one; fields a line lacks are null."""
    order = [name for name in ("at", "line") if name in lines.columns]
    body = F.regexp_extract("value", r"(iteration\s+\d+/.*)$", 1)
    fields = F.str_to_map(body, F.lit(r"\s*\|\s*"), F.lit(r":\s+"))
    columns = [
        F.trim(F.try_element_at(F.col("fields"), F.lit(label))).try_cast(kind).alias(name)
        for label, (name, kind) in ITERATION_FIELDS.items()
    ]
    return (
        lines.filter(F.col("value").rlike(r"iteration\s+\d+/\s*\d+ \|"))
        .withColumn("fields", fields)
        .select(
            "run",
            F.regexp_extract("value", r"iteration\s+(\d+)/", 1).cast("bigint").alias("iteration"),
            F.regexp_extract("value", r"iteration\s+\d+/\s*(\d+)", 1).cast("bigint").alias("planned"),
            *columns,
            *order,
        )
    )


def validation_records(lines: DataFrame) -> DataFrame:
    """``(run, iteration, lm_loss, ppl)`` of validation lines."""
    pattern = r"valid loss at iteration (\d+) \| lm loss value: (\S+) \| lm loss PPL: (\S+)"
    return lines.filter(F.col("value").rlike(pattern)).select(
        "run",
        F.regexp_extract("value", pattern, 1).cast("bigint").alias("iteration"),
        F.regexp_extract("value", pattern, 2).try_cast("double").alias("lm_loss"),
        F.regexp_extract("value", pattern, 3).try_cast("double").alias("ppl"),
    )


def overflow_events(lines: DataFrame) -> DataFrame:
    """Gradient overflows ``(run, iteration)``, once however many ranks print it."""
    pattern = r"Grad overflow on iteration: (\d+)"
    return (
        lines.filter(F.col("value").rlike(pattern))
        .select("run", F.regexp_extract("value", pattern, 1).cast("bigint").alias("iteration"))
        .distinct()
    )


def run_arguments(lines: DataFrame) -> DataFrame:
    """The argument dump at the head of a log: ``(run, argument, setting)``."""
    pattern = r"^(?:\d+:)?\s+(\w+) \.{3,} (.*)$"
    return (
        lines.filter(F.col("value").rlike(pattern))
        .select(
            "run",
            F.regexp_extract("value", pattern, 1).alias("argument"),
            F.trim(F.regexp_extract("value", pattern, 2)).alias("setting"),
        )
        .distinct()
    )


def diff_arguments(arguments: DataFrame) -> DataFrame:
    """Arguments that are not the same in all runs, with their settings.

    An argument some run lacks counts as different. The settings are returned
    as rows, so that no list grows with the number of runs.
    """
    runs = arguments.agg(F.count_distinct("run")).scalar()
    spread = (
        arguments.groupBy("argument")
        .agg(
            F.count_distinct("run").alias("present"),
            F.min("setting").alias("low"),
            F.max("setting").alias("high"),
        )
        .filter((F.col("low") != F.col("high")) | (F.col("present") < runs))
    )
    return arguments.join(spread.select("argument"), "argument", "left_semi").groupBy(
        "argument", "setting"
    ).agg(F.count("*").alias("runs"))


def has_error() -> Column:
    """Does the line contain one of the error marks?"""
    found = F.lit(False)
    for mark in ERROR_STRINGS:
        found = found | F.col("value").contains(mark)
    return found


def error_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(has_error())


def node_ranks(lines: DataFrame) -> DataFrame:
    """``(rank, node, ranks)`` from launch lines, per ``run`` where there is one.

    A repeated rank is an error, and so are launch lines of one run that do not
    agree on the number of ranks.
    """
    job = ["run"] if "run" in lines.columns else []
    pattern = r"Launching on (\S+) \((\d+)/(\d+)\)"
    repeated = F.concat(F.lit("several nodes for rank "), F.col("rank").cast("string"))
    launches = (
        lines.filter(F.col("value").rlike(pattern))
        .select(
            *job,
            F.regexp_extract("value", pattern, 2).cast("int").alias("rank"),
            F.regexp_extract("value", pattern, 1).alias("node"),
            F.regexp_extract("value", pattern, 3).cast("int").alias("ranks"),
        )
        .groupBy(*job, "rank")
        .agg(
            F.count("*").alias("copies"),
            F.min("node").alias("node"),
            F.min("ranks").alias("ranks"),
            F.max("ranks").alias("most"),
        )
    )
    agreed = launches.groupBy(*job).agg(F.min("ranks").alias("low"), F.max("most").alias("high"))
    kept = [*job, "rank", "node", "ranks", "copies"]
    if job:
        launches = launches.select(*kept).join(agreed, "run")
    else:
        low, high = agreed.select("low").scalar(), agreed.select("high").scalar()
        launches = launches.select(*kept).withColumns({"low": low, "high": high})
    node = (
        F.when(F.col("copies") > 1, F.raise_error(repeated).cast("string"))
        .when(F.col("low") != F.col("high"), F.raise_error(F.lit("launch lines differ in the number of ranks")).cast("string"))
        .otherwise(F.col("node"))
    )
    return launches.select(*job, "rank", node.alias("node"), "ranks")


def _ranked(errors: DataFrame) -> DataFrame:
    return errors.withColumn("rank", F.get(F.split("value", ":", -1), F.lit(0)).try_cast("int"))


def error_nodes(errors: DataFrame, output: DataFrame) -> DataFrame:
    """Failing nodes with the lines that say so.

    Ranks are looked up in their own run if both tables name it. A rank without
    a launch line keeps its row, with no node.
    """
    ranked = _ranked(error_lines(errors)).filter(F.col("rank").isNotNull())
    keys = ["run", "rank"] if "run" in errors.columns and "run" in output.columns else ["rank"]
    return ranked.join(node_ranks(output), keys, "left").select("node", "rank", F.col("value").alias("line"))


def unranked_errors(errors: DataFrame) -> DataFrame:
    """Error lines whose rank cannot be read."""
    return _ranked(error_lines(errors)).filter(F.col("rank").isNull()).drop("rank")


def throughput(records: DataFrame) -> DataFrame:
    """Last iteration, last known and best loss and mean speed of every run."""
    return records.groupBy("run").agg(
        F.max("iteration").alias("last_iteration"),
        F.max_by("lm_loss", F.when(F.col("lm_loss").isNotNull(), F.col("iteration"))).alias("last_loss"),
        F.min("lm_loss").alias("best_loss"),
        F.avg("samples_per_second").alias("samples_per_second"),
        F.avg("tflops").alias("tflops"),
    )


def run_summary(records: DataFrame, order: Sequence[str], tail: int = 10, limit: float = 1.0) -> DataFrame:
    """One row per run, restarts taken into account.

    ``order`` is the place of a record in its run's log. Where iteration numbers
    do not rise the run was started anew (``restarts``), and of the records of
    one iteration the last counts. ``tail_spread`` is the distance between the
    highest and the lowest of the last ``tail`` losses. ``blown_up`` says that
    it, or how far the last loss lies above the best, exceeds ``limit``, or that
    the last loss is no number; null if no loss is known.
    """
    places = [name for name in order]
    followed = neighbours(records.select("run", "iteration", *places), "iteration", places, ["run"])
    starts = followed.groupBy("run").agg(F.count_if(F.col("iteration") <= F.col("previous")).alias("restarts"))
    known = ("lm_loss", "samples_per_second", "tflops")
    last = F.max_by(F.struct(*known), F.struct(*places)).alias("last")
    kept = materialize(records.groupBy("run", "iteration").agg(last).select("run", "iteration", "last.*"))
    losses = kept.filter("lm_loss is not null")
    whole = kept.groupBy("run").agg(
        F.count("*").alias("iterations"),
        F.max("iteration").alias("last_iteration"),
        F.min("lm_loss").alias("best_loss"),
        F.avg("samples_per_second").alias("samples_per_second"),
        F.avg("tflops").alias("tflops"),
    )
    ends = last_of_groups(losses, ["run"], "iteration", tail).groupBy("run").agg(
        F.max_by("lm_loss", "iteration").alias("last_loss"), (F.max("lm_loss") - F.min("lm_loss")).alias("tail_spread")
    )
    above = F.col("last_loss") - F.col("best_loss")
    blown = (F.col("tail_spread") > limit) | (above > limit) | F.isnan("last_loss")
    flagged = F.when(F.col("last_loss").isNotNull(), blown)
    return whole.join(starts, "run").join(ends, "run", "left").withColumn("blown_up", flagged)


def relative_throughput(summary: DataFrame, base_run: str) -> DataFrame:
    """Speed of each run in percent of a base run, fastest first."""
    base = summary.filter(F.col("run") == base_run).agg(F.max("samples_per_second")).scalar()
    return summary.withColumn(
        "percent_of_base", F.lit(100.0) * F.col("samples_per_second") / base
    ).orderBy(F.desc("percent_of_base"), "run")
