"""Counts, shares, histograms and simple filters for looking at a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.order import exact_quantiles, rank_quantiles, row_ranks
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize


def percentiles(
    df: DataFrame, column: str, percents: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated percentiles, as columns ``p25``, ``p50``, ..."""
    return exact_quantiles(df, column, {f"p{percent:g}": percent / 100 for percent in percents}, by)


def rank_percentile(
    df: DataFrame, column: str, percents: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """The sorted value at index ``floor(n * p)``, as columns ``p25``, ..."""
    return rank_quantiles(df, column, {f"p{percent:g}": percent / 100 for percent in percents}, by)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, most frequent first."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys)


def with_share(counts: DataFrame, count: str = "count", name: str = "ratio") -> DataFrame:
    """Percent of the total, from a scalar aggregate instead of a global window."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(name, F.lit(100.0) * F.col(count) / total)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values: where duplicate ids show up."""
    return (
        df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(k)
    )


def top_k(df: DataFrame, column: str, k: int, tie: str = "doc_id") -> DataFrame:
    """The ``k`` rows with the highest value, ties by key."""
    return df.orderBy(F.desc(column), tie).limit(k)


def sort_by(df: DataFrame, *columns: str) -> DataFrame:
    """Descending sort by several columns."""
    return df.orderBy(*[F.desc(column) for column in columns])


def histogram(
    df: DataFrame,
    column: str,
    bins: int,
    low: float,
    high: float,
    by: Sequence[str] = (),
    clip: float | None = None,
) -> DataFrame:
    """Equal bins over ``[low, high]``, the last closed on the right.

    Values outside are left out, unless ``clip`` moves high ones down to it
    first. Returns ``(by, bin, left, right, count)`` for the non-empty bins.
    """
    value = F.col(column).cast("double")
    if clip is not None:
        value = F.least(value, F.lit(float(clip)))
    width = (high - low) / bins
    number = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    return (
        df.select(*by, value.alias("value"), number.cast("bigint").alias("bin"))
        .filter((F.col("value") >= low) & (F.col("value") <= high))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("count"))
        .withColumn("left", F.lit(float(low)) + F.col("bin") * F.lit(width))
        .withColumn("right", F.lit(float(low)) + (F.col("bin") + 1) * F.lit(width))
    )


def in_ratio(df: DataFrame, condition: Column, by: Sequence[str] = ()) -> DataFrame:
    """Percent of rows for which ``condition`` holds."""
    return df.groupBy(*by).agg((F.lit(100.0) * F.avg(condition.cast("int"))).alias("in_ratio"))


def length_stats(
    df: DataFrame, by: str = "source", text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Shortest, longest and mean text per source, and which text is longest.

    Only the length and the key go through the shuffle, not the text.
    """
    length = F.length(text).cast("bigint")
    return (
        df.select(by, key, length.alias("length"))
        .groupBy(by)
        .agg(
            F.count("*").alias("docs"),
            F.min("length").alias("min_length"),
            F.max("length").alias("max_length"),
            F.avg("length").alias("mean_length"),
            F.max_by(key, F.struct("length", F.negative(key))).alias("longest"),
        )
    )


def total_bytes(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.sum(F.octet_length(text).cast("bigint")).alias("total_bytes"))


def split_by_cutoff(df: DataFrame, column: str, cut: float) -> DataFrame:
    """Add ``is_in``: strictly below the cut-off."""
    return df.withColumn("is_in", F.col(column) < F.lit(cut))


def filter_length(
    df: DataFrame, low: int | None = None, high: int | None = None, text: str = "text"
) -> DataFrame:
    """Texts of at least ``low`` and at most ``high`` characters."""
    length = F.length(text)
    if low is not None:
        df = df.filter(length >= low)
    if high is not None:
        df = df.filter(length <= high)
    return df


def row_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """0-based position of each row in its group; ``order`` must be unique in it.

    Positions come from one global order shifted by the start of the group, so
    a large group is not sorted in one task.
    """
    by, order = list(by), list(order)
    ranks = row_ranks(df, [*by, *order])
    if not by:
        return ranks.select(*order, (F.col("rank") - 1).alias("row_index"))
    first = materialize(
        ranks.groupBy(*by).agg(F.min("rank").alias("first_rank"), F.count("*").alias("fan_in"))
    )
    return join_counted(ranks, first, by, "fan_in").select(
        *by, *order, (F.col("rank") - F.col("first_rank")).alias("row_index")
    )


def first_in_group(
    df: DataFrame, keys: Sequence[str], order: str, column: str, name: str = "first_value"
) -> DataFrame:
    """The value at the smallest ``order`` of each group, on every row.

    An aggregate joined back: no group is sorted, and a large one is spread.
    """
    first = materialize(
        df.groupBy(*keys).agg(F.min_by(column, order).alias(name), F.count("*").alias("fan_in"))
    )
    return join_counted(df, first, list(keys), "fan_in")


def relative_to_first(
    df: DataFrame, keys: Sequence[str], order: str, column: str, name: str = "relative"
) -> DataFrame:
    """Each value divided by the first of its group."""
    return (
        first_in_group(df, keys, order, column, "first_value")
        .withColumn(name, F.try_divide(F.col(column), F.col("first_value")))
        .drop("first_value")
    )


def top_of_group(df: DataFrame, keys: Sequence[str], payload: Sequence[str], column: str, highest: bool = False) -> DataFrame:
    """Lowest (or highest) value per group with other columns of that row."""
    pick = F.max_by if highest else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(column, *payload), F.struct(column, *payload)).alias("best"))
        .select(*keys, "best.*")
    )


def last_of_groups(df: DataFrame, keys: Sequence[str], order: str, count: int, shares: int = 64) -> DataFrame:
    """The ``count`` rows of the highest ``order`` of each group.

    Taken of each share of a group first, so that no task ranks a whole group;
    ``order`` is unique within it.
    """
    share = F.pmod(F.xxhash64(*keys, order), F.lit(shares))
    some = Window.partitionBy(*keys, "__share").orderBy(F.desc(order))
    few = df.withColumn("__share", share).withColumn("__at", F.row_number().over(some)).filter(F.col("__at") <= count)
    ranked = few.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    return ranked.filter(F.col("__at") <= count).drop("__share", "__at")
