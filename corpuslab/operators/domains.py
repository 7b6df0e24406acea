"""Which web domains a corpus covers, and which it misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import domain_of
from corpuslab.operators.profile import with_share

# Fixed value: the ratio reported for a domain the other corpus does not have.
ABSENT = 13131313.0


def domain_counts(df: DataFrame, url: str = "url") -> DataFrame:
    """``(domain, count, ratio)``, ratio in percent of all pages with a domain."""
    counts = (
        df.select(domain_of(url).alias("domain"))
        .filter(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(F.count("*").alias("count"))
    )
    return with_share(counts)


def left_compare(
    left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")
) -> DataFrame:
    """Left join of two tables with equal columns; what is missing becomes 0."""
    values = [name for name in left.columns if name != key]
    renamed_left = left.select(key, *[F.col(name).alias(name + suffixes[0]) for name in values])
    renamed_right = right.select(key, *[F.col(name).alias(name + suffixes[1]) for name in values])
    return renamed_left.join(renamed_right, key, "left").fillna(0)


def domain_overlap(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest domains of ``a`` with their figures in ``b``."""
    largest = a.orderBy(F.desc("count"), "domain").limit(n)
    return left_compare(largest, b, "domain")


def blindspots(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """How much larger the share of each top domain of ``a`` is than in ``b``."""
    ratio = F.when(F.col("ratio_b") == 0, F.lit(ABSENT)).otherwise(
        F.try_divide(F.col("ratio_a"), F.col("ratio_b"))
    )
    return (
        domain_overlap(a, b, n)
        .withColumn("ratio", ratio)
        .orderBy(F.desc("ratio"), F.desc("count_a"), "domain")
    )
