"""Global order without a global sort on one node.

Spark tables have no row order. Whatever depends on "the first rows" takes an
explicit ``order_by`` whose columns together are unique. Only the key columns
and one number are range-partitioned; running totals are taken inside each
range and shifted by the totals of the ranges before it. Wide rows (texts)
never move: a prefix of a table is a comparison with one cut-off key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

RUNNING = "running"
VALUE = "amount"
_PART = "range_no"


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def running_total(
    df: DataFrame,
    value: Column | str,
    order_by: str | Sequence[str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running total of ``value`` over the whole table.

    Returns the order columns, ``carry``, ``amount`` and ``running``. The rows
    are written once with the number of the range they fell in, because the
    borders Spark samples may differ from one run of a plan to the next.
    """
    keys = _columns(order_by)
    amount = F.col(value) if isinstance(value, str) else value
    ranged = materialize(
        df.select(*keys, *carry, amount.alias(VALUE))
        .repartitionByRange(*keys)
        .withColumn(_PART, F.spark_partition_id())
    )
    # One row per range: at most spark.sql.shuffle.partitions rows.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(_PART)
        .agg(F.sum(VALUE).alias("range_total"))
        .withColumn("offset", F.coalesce(F.sum("range_total").over(before), F.lit(0)))
        .select(_PART, "offset")
    )
    inside = Window.partitionBy(_PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("inside", F.sum(VALUE).over(inside))
        .join(F.broadcast(offsets), _PART)
        .select(*keys, *carry, VALUE, (F.col("inside") + F.col("offset")).alias(RUNNING))
    )


def row_ranks(df: DataFrame, order_by: str | Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row: the order columns, ``carry`` and ``rank``."""
    ranked = running_total(df, F.lit(1).cast("bigint"), order_by, carry)
    return ranked.withColumnRenamed(RUNNING, "rank").drop(VALUE)


def attach_by_key(df: DataFrame, extra: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Append computed columns by key (rows have no position to align on)."""
    return df.join(extra, _columns(keys))


def key_of(order_by: str | Sequence[str]) -> Column:
    """The order columns as one comparable value."""
    return F.struct(*_columns(order_by))


def last_key(totals: DataFrame, order_by: str | Sequence[str], condition: Column) -> DataFrame:
    """One row ``cut``: the greatest key among the rows where ``condition`` holds."""
    return totals.filter(condition).agg(F.max(key_of(order_by)).alias("cut"))


def up_to(df: DataFrame, order_by: str | Sequence[str], cut: DataFrame) -> DataFrame:
    """Rows whose key is not beyond the one-row table ``cut``.

    The cut-off is a scalar subquery, so it is a constant when the scan of
    ``df`` starts and no row of ``df`` is shuffled. For a single order column
    the comparison is on the plain column and reaches the Parquet filter.
    """
    keys = _columns(order_by)
    if len(keys) == 1:
        return df.filter(F.col(keys[0]) <= cut.select(F.col("cut")[keys[0]]).scalar())
    return df.filter(key_of(keys) <= cut.scalar())


def beyond(df: DataFrame, order_by: str | Sequence[str], cut: DataFrame) -> DataFrame:
    """Rows after the cut-off; all rows when there is no cut-off."""
    keys = _columns(order_by)
    if len(keys) == 1:
        bound = cut.select(F.col("cut")[keys[0]]).scalar()
        return df.filter(F.coalesce(F.col(keys[0]) > bound, F.lit(True)))
    return df.filter(F.coalesce(key_of(keys) > cut.scalar(), F.lit(True)))


def byte_offsets(
    df: DataFrame, order_by: str | Sequence[str], text: str = "text", separator_bytes: int = 6
) -> DataFrame:
    """Where each document would lie in one flat byte file.

    Every document is preceded by a separator (two marker bytes and a 32-bit
    number in the usual layout). Returns the order columns, ``start`` and
    ``end`` of the text proper.
    """
    size = F.octet_length(text).cast("bigint") + F.lit(separator_bytes)
    totals = running_total(df, size, order_by)
    return totals.select(
        *_columns(order_by),
        (F.col(RUNNING) - F.col(VALUE) + separator_bytes).alias("start"),
        F.col(RUNNING).alias("end"),
    )


def exact_quantiles(
    df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated quantiles, one output column per point.

    Equal values are counted first, the counts are summed along the global
    order, and each quantile is read off the two values its rank falls on. No
    task ever holds all values of a group, unlike the built-in ``percentile``.
    """
    by = list(by)
    spread = _value_ranks(df, value, by)
    aggregates = []
    for name, point in points.items():
        target = F.lit(point) * (F.col("size") - 1)
        for suffix, index in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            held = (F.col("first_index") <= index) & (index <= F.col("last_index"))
            aggregates.append(F.max(F.when(held, F.col(value))).alias(f"{name}_{suffix}"))
    picked = spread.groupBy(*by).agg(F.max("size").alias("size"), *aggregates)
    columns = []
    for name, point in points.items():
        target = F.lit(point) * (F.col("size") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        columns.append((low + (high - low) * (target - F.floor(target))).cast("double").alias(name))
    return picked.select(*by, *columns)


def rank_quantiles(
    df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """The sorted value at index ``floor(n * p)``, without interpolation."""
    by = list(by)
    spread = _value_ranks(df, value, by)
    aggregates = []
    for name, point in points.items():
        index = F.least(F.floor(F.lit(point) * F.col("size")), F.col("size") - 1)
        held = (F.col("first_index") <= index) & (index <= F.col("last_index"))
        aggregates.append(F.max(F.when(held, F.col(value))).alias(name))
    return spread.groupBy(*by).agg(*aggregates)


def _value_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values with the 0-based index range they fill in their group."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("copies"))
    totals = materialize(running_total(counted, "copies", [*by, value]))
    bounds = totals.groupBy(*by).agg(
        F.min(F.col(RUNNING) - F.col(VALUE)).alias("base"),
        F.sum(VALUE).alias("size"),
        F.count("*").alias("fan_in"),
    )
    if by:
        totals = join_counted(totals, materialize(bounds), by, "fan_in")
    else:
        totals = totals.withColumn("base", F.lit(0)).withColumn("size", bounds.select("size").scalar())
    return totals.withColumn("first_index", F.col(RUNNING) - F.col(VALUE) - F.col("base")).withColumn(
        "last_index", F.col(RUNNING) - F.col("base") - 1
    )
