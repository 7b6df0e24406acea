"""Half-open ranges ``[start, end)`` inside documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.scans import running


def merge_ranges(df: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Merge overlapping and touching ranges of each key.

    One shuffle by key; both windows and the final grouping reuse it.
    """
    keys = list(keys)
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    return (
        df.select(*keys, "start", "end")
        .withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(upto))
        .groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def assign_document(
    positions: DataFrame,
    offsets: DataFrame,
    key: str = "doc_id",
    separator_bytes: int = 0,
) -> DataFrame:
    """Find the document each global byte position lies in.

    ``positions`` has ``pos``; ``offsets`` has ``(key, start, end)`` as made by
    ``byte_offsets``. An as-of join: both sides are ranged by position together
    and every position takes the last start before it, which a range hands on
    to the next. However many positions lie in one spot, they are spread like
    all others. With ``separator_bytes`` a position in the separator after a
    document belongs to that document. A position in no document keeps its row,
    with nulls.
    """
    given = F.struct(*[F.col(f"`{name}`") for name in positions.columns])
    document = F.struct(F.col(key).alias("key"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    nothing = positions.select(given.alias("given")).schema["given"].dataType
    starts = offsets.select(
        F.col("start").cast("bigint").alias("at"), F.lit(0).alias("kind"), F.col("end").cast("bigint").alias("until"),
        document.alias("document"), F.lit(None).cast(nothing).alias("given"),
    )
    asked = positions.select(
        F.col("pos").cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("until"),
        F.lit(None).cast(starts.schema["document"].dataType).alias("document"), given.alias("given"),
    )
    # Of documents with one start, the empty ones come before the one that holds the position.
    placed = running(starts.unionByName(asked), "document", ["at", "kind", "until"], "last", name="holder")
    reach = F.col("holder.end") + F.lit(separator_bytes)
    inside = (F.col("at") < reach) & (F.col("holder.end") + F.lit(separator_bytes) > F.col("holder.start"))
    return placed.filter("kind = 1").select(
        *[F.col(f"given.`{name}`") for name in positions.columns],
        F.when(inside, F.col("holder.key")).alias(key),
        F.when(inside, F.col("at") - F.col("holder.start")).alias("pos_in_doc"),
    )
