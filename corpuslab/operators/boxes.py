"""Five-number summaries per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.order import exact_quantiles
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize


def box_stats(df: DataFrame, column: str, by: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, and the outermost values within ``reach`` box heights of the box."""
    by = list(by)
    known = df.filter(F.col(column).isNotNull())
    sizes = known.groupBy(*by).agg(F.count("*").alias("n"))
    quartiles = materialize(
        exact_quantiles(known, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by).join(sizes, by)
    )
    height = F.col("q3") - F.col("q1")
    value = F.col(column)
    inside = (value >= F.col("q1") - reach * height) & (value <= F.col("q3") + reach * height)
    whiskers = (
        join_counted(known, quartiles, by, "n")
        .groupBy(*by)
        .agg(
            F.min(F.when(inside, value)).alias("low"),
            F.max(F.when(inside, value)).alias("high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return quartiles.join(whiskers, by)
