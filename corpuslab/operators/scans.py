"""Running values and neighbours along an order, without a window per group.

Rows are range-partitioned by group and order, so a group of any size is spread
over as many ranges as it fills. Each range is folded alone; what a range takes
over from the ranges before it is one value for its first group. A step must be
associative: ``min``, ``max`` or ``last`` (the last value that is not null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.session import materialize

_PART, _VALUE = "__range", "__value"
_STEPS = {
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda column: F.last(column, True), lambda before, own: F.coalesce(own, before)),
}


def _ranged(df: DataFrame, value: Column | str, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their value and the number of their range, written once."""
    rows = df.withColumn(_VALUE, F.col(value) if isinstance(value, str) else value)
    return materialize(rows.repartitionByRange(*by, *order).withColumn(_PART, F.spark_partition_id()))


def _matches(by: list[str]) -> Column:
    """Equal groups, the one side under the names ``_renamed`` gives; null is a group too."""
    condition = F.lit(True)
    for i, name in enumerate(by):
        condition = condition & F.col(name).eqNullSafe(F.col(f"__by{i}"))
    return condition


def _renamed(by: list[str]) -> list[Column]:
    return [F.col(name).alias(f"__by{i}") for i, name in enumerate(by)]


def _of_first_groups(parts: DataFrame, by: list[str]) -> DataFrame:
    """Of rows per range and group, those of groups that some range begins with: about two per border."""
    if not by:
        return parts
    heads = parts.groupBy(_PART).agg(F.min(F.struct(*by)).alias("head")).select("head.*").distinct()
    return parts.join(F.broadcast(heads.select(*_renamed(by))), _matches(by), "left_semi")


def _attach(ranged: DataFrame, carried: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``carried`` has about a row for each range, so it is sent to all tasks."""
    renamed = carried.select(F.col(_PART).alias("__at"), *_renamed(by), *columns)
    joined = ranged.join(F.broadcast(renamed), (F.col(_PART) == F.col("__at")) & _matches(by), "left")
    return joined.drop("__at", *[f"__by{i}" for i in range(len(by))])


def running(
    df: DataFrame,
    value: Column | str,
    order_by: str | Sequence[str],
    step: str,
    by: Sequence[str] = (),
    name: str = "running",
    before: bool = False,
) -> DataFrame:
    """Add ``name``: the ``step`` of all values of the group up to each row.

    With ``before`` the row's own value is left out. Nulls are passed over;
    where there is no value yet the result is null. ``order_by`` is unique
    within a group.
    """
    by, order = list(by), [order_by] if isinstance(order_by, str) else list(order_by)
    aggregate, combine = _STEPS[step]
    ranged = _ranged(df, value, by, order)
    latest = F.max_by(_VALUE, F.when(F.col(_VALUE).isNotNull(), F.struct(*order)))
    whole = latest if step == "last" else aggregate(_VALUE)
    parts = materialize(_of_first_groups(ranged.groupBy(_PART, *by).agg(whole.alias("__whole")), by))
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("__carried", aggregate("__whole").over(earlier)).filter("__carried is not null")
    inside = Window.partitionBy(_PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    folded = _attach(ranged.withColumn("__own", aggregate(_VALUE).over(inside)), carried, by, ["__carried"])
    return folded.withColumn(name, combine(F.col("__carried"), F.col("__own"))).drop("__carried", "__own", _VALUE, _PART)


def neighbours(
    df: DataFrame,
    value: Column | str,
    order_by: str | Sequence[str],
    by: Sequence[str] = (),
    names: tuple[str, str] = ("previous", "following"),
) -> DataFrame:
    """Add the values of the rows next to each row of its group, null at the ends.

    Ranges exchange one border value to each side.
    """
    by, order = list(by), [order_by] if isinstance(order_by, str) else list(order_by)
    ranged = _ranged(df, F.struct((F.col(value) if isinstance(value, str) else value).alias("v")), by, order)
    ends = ranged.groupBy(_PART, *by).agg(
        F.min_by(_VALUE, F.struct(*order)).alias("__first"), F.max_by(_VALUE, F.struct(*order)).alias("__last")
    )
    along = Window.partitionBy(*by).orderBy(_PART)
    borders = materialize(_of_first_groups(ends, by)).select(
        _PART, *by, F.lag("__last").over(along).alias("__from_before"), F.lead("__first").over(along).alias("__from_after")
    )
    inside = Window.partitionBy(_PART, *by).orderBy(*order)
    looked = ranged.withColumn("__lag", F.lag(_VALUE).over(inside)).withColumn("__lead", F.lead(_VALUE).over(inside))
    both = _attach(looked, borders, by, ["__from_before", "__from_after"])
    return both.select(
        *df.columns,
        F.coalesce("__lag", "__from_before")["v"].alias(names[0]),
        F.coalesce("__lead", "__from_after")["v"].alias(names[1]),
    )
