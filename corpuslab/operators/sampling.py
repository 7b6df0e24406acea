"""Samples, subsets and budgets.

Every prefix is cut by key: the cut-off is found on the key and one number per
row, then applied to the wide table as a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.hashing import stable_hash, unit_interval
from corpuslab.operators.order import (
    RUNNING,
    beyond,
    key_of,
    last_key,
    row_ranks,
    running_total,
    up_to,
)

Order = str | Sequence[str]


def head(df: DataFrame, n: int, order_by: Order = "doc_id") -> DataFrame:
    """The first ``n`` rows, so that smaller heads lie inside larger ones."""
    return up_to(df, order_by, last_key(row_ranks(df, order_by), order_by, F.col("rank") <= n))


def tail(df: DataFrame, n: int, order_by: Order = "doc_id") -> DataFrame:
    """The last ``n`` rows; ``all_but_tail`` gives the rest."""
    return beyond(df, order_by, _tail_cut(df, n, order_by))


def all_but_tail(df: DataFrame, n: int, order_by: Order = "doc_id") -> DataFrame:
    return up_to(df, order_by, _tail_cut(df, n, order_by))


def _tail_cut(df: DataFrame, n: int, order_by: Order) -> DataFrame:
    size = df.agg(F.count("*")).scalar()
    return last_key(row_ranks(df, order_by), order_by, F.col("rank") <= size - n)


def split_range(df: DataFrame, low: float, high: float, order_by: Order = "doc_id") -> DataFrame:
    """Rows whose 0-based index i satisfies ``low * n <= i < high * n``."""
    ranks = row_ranks(df, order_by)
    size = df.agg(F.count("*")).scalar()
    index = F.col("rank") - 1
    before = last_key(ranks, order_by, index < size * F.lit(low))
    until = last_key(ranks, order_by, index < size * F.lit(high))
    return beyond(up_to(df, order_by, until), order_by, before)


def with_shuffle_key(df: DataFrame, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Add ``shuffle_key``; ordering by ``(shuffle_key, key)`` is a seeded shuffle."""
    return df.withColumn("shuffle_key", stable_hash(key, seed=seed))


def bernoulli(df: DataFrame, rate: float, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Keep each row with probability ``rate``, decided by its key alone."""
    return df.filter(unit_interval(key, seed=seed) < F.lit(rate))


def shrunk_size(size: int, wanted: int) -> int:
    """The wanted sample size, divided by ten until the table is large enough."""
    while wanted > size:
        wanted //= 10
    return wanted


def small_sample(
    df: DataFrame, wanted: int, order_by: Order = "doc_id", seed: int | None = None
) -> DataFrame:
    """A small sample under the shrinking rule.

    A prefix by default; with a seed, the prefix of a seeded shuffle.
    """
    size = shrunk_size(df.count(), wanted)
    if seed is None:
        return head(df, size, order_by)
    key = order_by if isinstance(order_by, str) else order_by[-1]
    shuffled = with_shuffle_key(df, seed, key)
    return head(shuffled, size, ["shuffle_key", key]).drop("shuffle_key")


def tokens_per_sample(df: DataFrame, tokens: Column | str) -> DataFrame:
    """One row ``mean_tokens``: all tokens divided by all samples."""
    amount = F.col(tokens) if isinstance(tokens, str) else tokens
    return df.agg((F.sum(amount).cast("double") / F.count("*")).alias("mean_tokens"))


def take_budget(
    df: DataFrame, budget: float, tokens: Column | str, order_by: Order = "doc_id"
) -> DataFrame:
    """As many first rows as a token budget needs at the mean tokens per row."""
    mean = tokens_per_sample(df, tokens).scalar()
    wanted = F.ceil(F.lit(float(budget)) / mean)
    ranks = row_ranks(df, order_by)
    return up_to(df, order_by, last_key(ranks, order_by, F.col("rank") <= wanted))


def samples_for_budget(budget: float, mean_tokens: float) -> int:
    """Samples needed for a token budget, rounded up."""
    return int(-(-budget // mean_tokens))


def ratio_subsets(
    df: DataFrame,
    ratios: Sequence[float],
    names: Sequence[str] | None = None,
    order_by: Order = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Nested subsets by share of bytes, as a column ``subsets`` of names.

    A row is in the subset of ratio r when the running size including it stays
    below r times the total. Rows in no subset are left out. All cut-offs come
    from one pass over the running sizes.
    """
    names = list(names) if names else [f"{ratio}_subsample" for ratio in ratios]
    ordered = sorted(zip(ratios, names), reverse=True)
    totals = running_total(df, F.octet_length(text).cast("bigint"), order_by)
    total = df.agg(F.sum(F.octet_length(text).cast("bigint"))).scalar()
    cuts = totals.agg(
        *[
            F.max(F.when(F.col(RUNNING) < total * F.lit(float(ratio)), key_of(order_by))).alias(f"cut_{i}")
            for i, (ratio, _) in enumerate(ordered)
        ]
    )
    # One scalar subquery for all cut-offs: the table itself is not shuffled.
    cut = cuts.select(F.struct(*cuts.columns)).scalar()
    inside = F.array(
        *[
            F.when(key_of(order_by) <= cut[f"cut_{i}"], F.lit(name)).otherwise(F.lit(""))
            for i, (_, name) in enumerate(ordered)
        ]
    )
    return df.withColumn("subsets", F.array_remove(inside, "")).filter(F.size("subsets") > 0)


def repeat_to_budget(
    df: DataFrame,
    unique: float,
    total: float,
    tokens: Column | str,
    order_by: Order = "doc_id",
    key: str = "doc_id",
    seed: int = 0,
) -> DataFrame:
    """A unique budget repeated up to a total budget, with ``epoch`` from 0.

    Every full epoch holds all unique rows. The last, fractional one holds the
    prefix of that epoch's seeded shuffle that fits into what is left.
    """
    amount = F.col(tokens) if isinstance(tokens, str) else tokens
    base = take_budget(df, unique, amount, order_by)
    sizes = base.agg(F.sum(amount).alias("unique_tokens")).withColumn(
        "full", F.floor(F.lit(float(total)) / F.col("unique_tokens"))
    ).withColumn("left_over", F.lit(float(total)) - F.col("full") * F.col("unique_tokens"))
    full, left_over = sizes.select("full").scalar(), sizes.select("left_over").scalar()
    whole = base.withColumn(
        "epoch", F.explode(F.when(full > 0, F.sequence(F.lit(0).cast("bigint"), full - 1)).otherwise(F.expr("cast(array() as array<bigint>)")))
    )
    shuffled = with_shuffle_key(base, seed, key)
    shuffle_order = ["shuffle_key", key]
    totals = running_total(shuffled, amount, shuffle_order)
    cut = last_key(totals, shuffle_order, F.col(RUNNING) <= left_over)
    partial = up_to(shuffled, shuffle_order, cut).drop("shuffle_key").withColumn("epoch", full)
    return whole.unionByName(partial)
