"""Reading and writing corpora and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.sources.names import source_name

CORPUS_SCHEMA = "doc_id bigint, text string, meta string"


def read_corpus(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "json", schema: str | None = None
) -> DataFrame:
    """A corpus from JSON lines or Parquet; paths may be patterns or lists.

    JSON is read with a declared schema, never by a pass that infers one.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "json":
        return spark.read.schema(schema or CORPUS_SCHEMA).json(paths)
    if fmt == "parquet":
        return spark.read.parquet(*paths)
    raise ValueError("fmt is 'json' or 'parquet'")


def cap_length(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Drop texts of more than ``n`` characters on ingest."""
    return df.filter(F.length(text) <= n)


def write_jsonl(df: DataFrame, path: str, keep: Sequence[str] = ("text",)) -> None:
    """JSON lines with the named columns only; characters are not escaped."""
    df.select(*keep).write.json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_scores(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Score tables ``dataset, fewshots, prompt, metric, value`` with their file."""
    schema = "dataset string, fewshots int, prompt string, metric string, value double"
    return spark.read.schema(schema).option("header", True).csv(path).withColumn(
        "file", F.col("_metadata.file_path")
    )


def read_curves(spark: SparkSession, path: str | Sequence[str], named_by: str = "file") -> DataFrame:
    """Loss curves; the run is the name of the file, or of its folder."""
    schema = "row int, run_name string, tag string, step bigint, value double"
    name = source_name(named_by)
    run = F.regexp_extract(name, r"^(.*?)(_training)?\.csv$", 1) if named_by == "file" else name
    return (
        spark.read.schema(schema)
        .option("header", True)
        .csv(path)
        .select(run.alias("run"), "tag", "step", "value")
    )
