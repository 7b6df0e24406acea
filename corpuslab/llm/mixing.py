"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are shares of all tokens by weight, capped at a number of passes over
a source. Sources are dealt to shards of bounded size. Blocks of equally many
tokens are given to shards by the highest quotients ``votes / (2 * seats + 1)``
with the shard's part of the target as votes. In a shard the documents stand
in a seeded order, and its quota is the run of blocks from a seeded block on,
round and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.order import RUNNING, row_ranks, running_total
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def cycle_weights(sources: DataFrame, source: str, weights: tuple[float, ...]) -> DataFrame:
    """Give sources, by code point and null last, the weights in turn."""
    keyed = sources.select(F.col(source).isNull().alias("none"), source)
    ranks = row_ranks(keyed, ["none", source])
    cycle = F.array(*(F.lit(float(weight)) for weight in weights))
    place = F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1
    return ranks.select(source, F.element_at(cycle, place.cast("int")).alias("weight"))


def capped_targets(sources: DataFrame, share: float, passes: float) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)``.

    ``share`` of all sizes goes to the sources by weight, but no source gets
    more than ``passes`` times its size; what it cannot take is dealt to the
    others by weight again until nobody is above. That ends at one level of
    tokens per weight, found by one running total over the sources in the order
    of the level at which they are full. Weights are positive.
    """
    full = sources.withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    full = full.withColumn("level", F.col("cap") / F.col("weight"))
    keys = ["level", "none", "source"]
    full = materialize(full.withColumn("none", F.col("source").isNull()))
    caps = running_total(full, "cap", keys, ["weight", "cap", "source_size"])
    both = materialize(
        running_total(caps.withColumnRenamed(RUNNING, "caps").drop("amount"), "weight", keys, ["caps", "cap", "source_size"])
    )
    totals = full.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))
    wanted = totals.select(F.col("size") * F.lit(float(share))).scalar()
    weights = totals.select("weight").scalar()
    # A source is full when the level it is full at still leaves enough for the rest.
    demand = F.col("caps") + F.col("level") * (weights - F.col(RUNNING))
    filled = both.filter(demand <= wanted).agg(
        F.coalesce(F.max("caps"), F.lit(0.0)).alias("caps"), F.coalesce(F.max(RUNNING), F.lit(0.0)).alias("weight")
    )
    rest = weights - filled.select("weight").scalar()
    level = F.when(rest > 0, (wanted - filled.select("caps").scalar()) / F.when(rest > 0, rest))
    open_target = F.least(F.col("cap"), F.col("amount") * level)
    target = F.when(demand <= wanted, F.col("cap")).otherwise(open_target)
    return both.select("source", "source_size", target.alias("target"))


def highest_quotients(parties: DataFrame, keys: list[str], votes: str, seats: DataFrame) -> DataFrame:
    """Sainte-Laguë: add ``quota`` to ``parties``; ``seats`` is a one-row table.

    The divisor that gives out just the seats is closed in on by trying 64
    divisors at a time, each in one aggregation over the parties. What ties at
    that divisor is given by the order of ``keys``.
    """
    wanted = seats.first()[0] or 0
    top = parties.agg(F.max(votes)).first()[0] or 0.0
    rounded = lambda divisor: F.floor(F.col(votes) / divisor + 0.5)
    if wanted <= 0 or top <= 0:
        return parties.withColumn("quota", F.lit(0).cast("bigint"))
    # At `low` at least all seats are given out, at `high` none.
    low, high = top / (2.0 * wanted + 1), top * 2.0000001
    for _ in range(12):
        tries = [low + (high - low) * step / 64 for step in range(1, 64)]
        given = parties.agg(*(F.sum(rounded(F.lit(divisor))) for divisor in tries)).first()
        enough = [divisor for divisor, count in zip(tries, given, strict=True) if count >= wanted]
        short = [divisor for divisor, count in zip(tries, given, strict=True) if count < wanted]
        low, high = max(enough, default=low), min(short, default=high)
    sure, up_to = rounded(F.lit(high)), rounded(F.lit(low))
    out = parties.withColumn("sure", sure.cast("bigint")).withColumn("extra", (up_to - sure).cast("bigint"))
    out = materialize(out)
    left = wanted - out.agg(F.sum("sure")).first()[0]
    ties = running_total(out.filter("extra > 0"), "extra", keys)
    given = F.greatest(F.lit(0), F.least(F.col("amount"), F.lit(left) - F.col(RUNNING) + F.col("amount")))
    same = [F.col(f"p.{key}").eqNullSafe(F.col(f"t.{key}")) for key in keys]
    joined = out.alias("p").join(ties.withColumn("given", given).alias("t"), same, "left")
    return joined.select(
        *[F.col(f"p.{name}") for name in parties.columns],
        (F.col("p.sure") + F.coalesce("t.given", F.lit(0))).cast("bigint").alias("quota"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    passes: float = 2.0,
    block: int = 32,
    shard_tokens: int = 1 << 22,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How many tokens (words) of every document the mix takes, repeats counted.

    Returns ``key, size, source, source_size, target, taken`` for each row of
    ``docs``. Sources by code point, null last, get ``weights`` in turn. A
    source of more than ``shard_tokens`` tokens is dealt to several shards by a
    hash of the key, so no window holds more than about that many tokens.
    A null or empty text has size 0 and nothing taken; a null source is a
    source; rows that agree in key and size share their place in the order, one
    after the other. Without any word all targets are 0. Reruns agree.
    """
    sizes = materialize(docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    sources = materialize(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("fan_in"))
    )
    weighted = cycle_weights(sources, "source", weights).withColumnRenamed("source", "name")
    weighted = sources.join(weighted, F.col("source").eqNullSafe(F.col("name"))).drop("name", "fan_in")
    targets = materialize(capped_targets(weighted, share, passes))

    label = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    shards = F.greatest(F.ceil(F.col("source_size") / F.lit(shard_tokens)), F.lit(1)).cast("bigint")
    known = materialize(
        targets.alias("t")
        .join(sources.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
        .select("t.source", "t.source_size", "t.target", "s.fan_in")
        .select(label.alias("label"), "source_size", "target", shards.alias("shards"), "fan_in")
    )
    placed = join_counted(sizes.withColumn("label", label), known, "label", "fan_in").withColumn(
        "shard", F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("shards"))
    )
    order = Window.partitionBy("label", "shard").orderBy(F.xxhash64(F.lit(seed), "doc"), "doc", "size")
    placed = materialize(
        placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    parties = materialize(
        placed.groupBy("label", "shard")
        .agg(
            F.sum("size").alias("shard_size"),
            F.first("target").alias("target"),
            F.first("source_size").alias("source_size"),
            F.count("*").alias("fan_in"),
        )
        .withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(0.0))
    )
    seats = parties.agg(F.floor(F.sum("votes") / F.lit(block) + 0.5).cast("bigint"))
    quotas = highest_quotients(parties, ["label", "shard"], "votes", seats)
    # The seeded start is on a block; a shard without tokens has no block.
    n_blocks = F.greatest(F.ceil(F.col("shard_size") / F.lit(block)), F.lit(1)).cast("bigint")
    start = F.pmod(F.xxhash64("label", "shard", F.lit(seed)), n_blocks) * F.lit(block)
    taken = F.least(F.col("quota") * F.lit(block), F.floor(F.col("shard_size") * F.lit(float(passes))).cast("bigint"))
    size = F.greatest("shard_size", F.lit(1))
    plans = materialize(
        quotas.select(
            "label", "shard", "shard_size", start.alias("first"),
            F.floor(taken / size).cast("bigint").alias("rounds"), (taken % size).alias("rest"), "fan_in",
        )
    )
    begin = F.col("end") - F.col("size")

    def within(low: Column, high: Column) -> Column:
        return F.greatest(F.least("end", high) - F.greatest(begin, low), F.lit(0))

    stop = F.col("first") + F.col("rest")
    run = within(F.col("first"), F.least(stop, F.col("shard_size"))) + F.when(
        stop > F.col("shard_size"), within(F.lit(0), stop - F.col("shard_size"))
    ).otherwise(0)
    return join_counted(placed, plans, ["label", "shard"], "fan_in").select(
        F.col("doc").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("rounds") + run).cast("bigint").alias("taken"),
    )
