"""Evaluation results scattered over a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.scores import flatten_harness, flatten_template, merge_results
from corpuslab.sources.names import source_name

# Variants keep apart what is a number in the file and what is a text that looks like one.
HARNESS_SCHEMA = "config struct<num_fewshot: int>, results array<map<string, variant>>"
TEMPLATE_SCHEMA = (
    "dataset_name string, dataset_config_name string, template_name string, evaluation map<string, double>"
)


def _read(spark: SparkSession, folder: str, schema: str, named_by: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("file_name", source_name(named_by))
    )


def read_eval_json(spark: SparkSession, folder: str, named_by: str = "file") -> DataFrame:
    """All result files below ``folder`` as one long table.

    The name of the file (or of its folder, ``named_by="folder"``) decides: ``slim*`` holds many results of the first kind,
    ``agg*`` is skipped, anything else is one result of the second kind. A
    merged file from an earlier pass is not read again.
    """
    first = _read(spark, folder, HARNESS_SCHEMA, named_by).filter(F.col("file_name").startswith("slim"))
    second = _read(spark, folder, TEMPLATE_SCHEMA, named_by).filter(
        ~F.col("file_name").startswith("slim")
        & ~F.col("file_name").startswith("agg")
        & (F.col("file_name") != "merged.json")
    )
    return merge_results(flatten_harness(first), flatten_template(second))


def read_babi(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Exact-match scores ``(file, task, score)`` of the bAbI result files."""
    schema = "results struct<babi: struct<em: double>>"
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(paths)
        .select(F.col("_metadata.file_path").alias("file"), F.lit("babi").alias("task"), F.col("results.babi.em").alias("score"))
    )
