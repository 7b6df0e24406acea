"""Weighted mixtures of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.order import RUNNING, VALUE, running_total
from corpuslab.session import materialize


def mixture_spec(lines: DataFrame, column: str = "value") -> DataFrame:
    """Read one-line specifications: ``(split, source, weight, low, high)``.

    A line holds one or more quoted parts ``"name: weight low:high path, ..."``.
    """
    part = F.explode(F.regexp_extract_all(column, F.lit(r'"([^"]+)"'), F.lit(1))).alias("part")
    named = lines.select(part).select(
        F.regexp_extract("part", r"^\s*([^:\s]+)\s*:", 1).alias("split"),
        F.explode(
            F.split(F.regexp_replace("part", r"^\s*[^:\s]+\s*:", ""), ",")
        ).alias("item"),
    )
    item = r"^\s*([0-9.]+)\s+([0-9.]+):([0-9.]+)\s+(\S+)\s*$"
    return named.select(
        "split",
        F.regexp_extract("item", item, 4).alias("source"),
        F.regexp_extract("item", item, 1).try_cast("double").alias("weight"),
        F.regexp_extract("item", item, 2).try_cast("double").alias("low"),
        F.regexp_extract("item", item, 3).try_cast("double").alias("high"),
    )


def attach_weight(df: DataFrame, spec: DataFrame, source: str = "source") -> DataFrame:
    """Rows of the sources named in the specification, with their weight."""
    return df.join(spec.select(source, "weight"), source)


def mix(
    df: DataFrame,
    weights: dict[str, float],
    total: float,
    tokens: Column | str,
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """A mixture of sources filling a total budget, with ``epoch`` from 0.

    Source s gets ``weight * total`` tokens. A source smaller than its share is
    repeated: whole epochs, then the prefix that still fits.
    """
    return mixture_series(df, {"": weights}, total, tokens, source, key).drop("mix_id")


def mixture_series(
    df: DataFrame,
    mixtures: dict[str, dict[str, float]],
    total: float,
    tokens: Column | str,
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """Several mixtures at once, told apart by ``mix_id``.

    Running totals are taken once in the global order of (source, key), so no
    source has to fit into one task; every mixture is a cut of them. The list
    of mixtures is written by the caller and stays small.
    """
    spark = df.sparkSession
    amount = F.col(tokens) if isinstance(tokens, str) else tokens
    rows = [
        (mix_id, name, float(weight))
        for mix_id, weights in mixtures.items()
        for name, weight in weights.items()
        if weight > 0
    ]
    shares = spark.createDataFrame(rows, f"mix_id string, {source} string, weight double")
    named = sorted({row[1] for row in rows})
    used = df.filter(F.col(source).isin(*named))
    totals = materialize(running_total(used, amount, [source, key]))
    sizes = totals.groupBy(source).agg(
        F.min(F.col(RUNNING) - F.col(VALUE)).alias("base"), F.sum(VALUE).alias("size")
    )
    plan = (
        shares.join(F.broadcast(sizes), source)
        .withColumn("budget", F.col("weight") * F.lit(float(total)))
        .withColumn("full", F.floor(F.col("budget") / F.col("size")))
        .withColumn("left_over", F.col("budget") - F.col("full") * F.col("size"))
        .select("mix_id", source, "base", "full", "left_over")
    )
    fits = F.col(RUNNING) - F.col("base") <= F.col("left_over")
    epochs = F.col("full") + fits.cast("int")
    taken = (
        totals.join(F.broadcast(plan), source)
        .withColumn("epochs", epochs)
        .filter("epochs > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)))
        .select("mix_id", key, "epoch")
    )
    return used.join(taken, key)


def tenths_series(first: str, second: str) -> dict[str, dict[str, float]]:
    """The nine mixtures of two sources from 10 % to 90 % of the first."""
    return {
        f"{first}_{share}0": {first: share / 10, second: (10 - share) / 10} for share in range(1, 10)
    }


def concat(frames: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Stack tables under a source tag; columns missing in one become null."""
    stacked = None
    for name, frame in frames.items():
        tagged = frame.withColumn(tag, F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return stacked


def union_sets(df: DataFrame, key: str, column: str) -> DataFrame:
    """Union of the id sets of each key, as distinct ``(key, member)`` rows."""
    return df.select(key, F.explode(column).alias("member")).distinct()
