"""Packing token lists into blocks of fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.order import attach_by_key, row_ranks


def pack_sequences(
    df: DataFrame,
    block: int,
    batch: int = 1000,
    tokens: str = "input_ids",
    order_by: str | Sequence[str] = "doc_id",
) -> DataFrame:
    """Concatenate token lists within batches of rows and cut them into blocks.

    Returns ``(batch_no, block_no, input_ids, labels)``; the remainder of a
    batch that fills no block is dropped. Lists are cut at block borders inside
    their row, so a task only ever gathers the pieces of single blocks.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    sized = df.select(*keys, F.size(tokens).cast("bigint").alias("length"))
    before = (
        Window.partitionBy("batch_no").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    )
    # A batch has a fixed number of rows, and the window sees list sizes only.
    offsets = (
        row_ranks(sized, keys, ["length"])
        .withColumn("batch_no", F.floor((F.col("rank") - 1) / F.lit(batch)))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .filter("length > 0")
        .select(*keys, "batch_no", "offset")
    )
    placed = attach_by_key(df.select(*keys, tokens), offsets, keys)
    first = F.floor(F.col("offset") / block)
    last = F.floor((F.col("offset") + F.size(tokens) - 1) / block)
    start = F.greatest(F.col("block_no") * block - F.col("offset"), F.lit(0))
    end = F.least((F.col("block_no") + 1) * block - F.col("offset"), F.size(tokens).cast("bigint"))
    pieces = (
        placed.withColumn("block_no", F.explode(F.sequence(first, last)))
        .withColumn("start", start)
        .select(
            "batch_no",
            "block_no",
            (F.col("offset") + F.col("start")).alias("at"),
            F.slice(tokens, (F.col("start") + 1).cast("int"), (end - F.col("start")).cast("int")).alias("piece"),
        )
    )
    whole = F.flatten(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda part: part["piece"])
    )
    return (
        pieces.groupBy("batch_no", "block_no")
        .agg(whole.alias("input_ids"))
        .filter(F.size("input_ids") == block)
        .withColumn("labels", F.col("input_ids"))
    )
