"""Facts about training runs, read off their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameter counts behind the short names.
PARAMS = {
    "7m": 7.098752e6,
    "14m": 1.41e7,
    "20m": 19.703712e6,
    "25m": 35.5e6,
    "44m": 4.4e7,
    "83m": 8.27e7,
    "146m": 1.465e8,
    "196m": 201.236224e6,
    "220m": 2.205e8,
    "221m": 2.205e8,
    "280m": 2.81e8,
    "421m": 4.212e8,
    "574m": 573.7e6,
    "619m": 6.187e8,
    "1b1": 1.0963e9,
    "1b5": 1.5173e9,
    "2b2": 2.160013824e9,
    "2b8": 2.81e9,
    "3b8": 3.581186048e9,
    "3b9": 3.89971072e9,
    "4b2": 4.2465e9,
    "8b7": 8.67e9,
}

# Token counts, in billions, of the names that are not numbers.
TOKENS = {"100m": 0.1, "200m": 0.2, "400m": 0.4, "800m": 0.8}

# Marks that say how a run was made, not how large it is.
MARKS = ("op2", "seed1", "seed2", "seed3", "seed4", "opt1", "opt", "c4", "v2")


def _stripped(name: Column) -> Column:
    for mark in MARKS:
        name = F.replace(name, F.lit(mark), F.lit(""))
    return name


def _billions(part: Column) -> Column:
    """``1b25`` is 1.25 and ``4b`` is 4 (billions); ``m`` names come from a list."""
    number = F.regexp_replace(F.replace(part, F.lit("b"), F.lit(".")), r"^\.+|\.+$", "")
    listed = number.try_cast("double")
    for name, value in TOKENS.items():
        listed = F.when(part == name, F.lit(value)).otherwise(listed)
    return listed


def _unique_part(name: Column) -> Column:
    """The part of the name that gives the unique tokens.

    The last four characters when the name ends in a unit letter or has none
    among its last two, else the last three; shortened until one ``b`` and one
    ``m`` at most are left.
    """
    one, two = F.right(name, F.lit(1)), F.substring(F.right(name, F.lit(2)), 1, 1)
    units = ["b", "m"]
    part = F.right(name, F.when(~one.isin(*units) & two.isin(*units), 3).otherwise(4))
    longest = r"[^bm]*(?:b[^bm]*(?:m[^bm]*)?|m[^bm]*(?:b[^bm]*)?)?$"
    return F.regexp_extract(part, longest, 0)


def valid_runs(runs: DataFrame) -> DataFrame:
    """Finished runs (loss not 0) that are not marked as deduplicated."""
    return runs.filter((F.col("loss") != 0) & ~F.col("name").endswith("dedup"))


def _params_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARAMS.items()), "short string, params double")


def parse_runs(runs: DataFrame) -> DataFrame:
    """Add ``params, tokens, unique_tokens, seed, corpus, bare`` from ``name``.

    A bare name is ``{params}{tokens}{unique}``. The parameter part is the
    shortest known prefix of two or more characters; it is found by an
    equi-join on the few possible prefixes of the distinct names. A run whose
    name starts with no known part is kept with nulls; ``unknown_runs`` lists
    those.
    """
    spark = runs.sparkSession
    names = runs.select("name").distinct().withColumn("bare", _stripped(F.col("name")))
    prefixes = names.withColumn("size", F.explode(F.array(*[F.lit(n) for n in (2, 3, 4)]))).withColumn(
        "short", F.col("bare").substr(F.lit(1), F.col("size"))
    )
    found = (
        prefixes.join(F.broadcast(_params_table(spark)), "short")
        .groupBy("name", "bare")
        .agg(F.min(F.struct("size", "params")).alias("hit"))
        .withColumn("unique_part", _unique_part(F.col("bare")))
    )
    middle = F.col("bare").substr(
        F.col("hit.size") + 1, F.length("bare") - F.length("unique_part") - F.col("hit.size")
    )
    facts = found.select(
        "name",
        "bare",
        F.col("hit.params").alias("params"),
        (_billions(middle) * 1e9).alias("tokens"),
        (_billions(F.col("unique_part")) * 1e9).alias("unique_tokens"),
        F.coalesce(F.regexp_extract("name", r"seed(\d)", 1).try_cast("int"), F.lit(0)).alias("seed"),
        F.when(F.col("name").contains("c4"), "c4").otherwise("oscar").alias("corpus"),
    )
    return runs.join(facts, "name", "left")


def unknown_runs(parsed: DataFrame) -> DataFrame:
    """Parsed runs whose parameters are not known, to be rejected or looked into."""
    return parsed.filter(F.col("params").isNull())


def check_runs(runs: DataFrame) -> DataFrame:
    """The runs, or an error for one with more unique than total tokens."""
    message = F.concat(F.lit("more unique than total tokens: "), F.col("name"))
    return runs.withColumn(
        "unique_tokens",
        F.when(F.col("unique_tokens") > F.col("tokens"), F.raise_error(message).cast("double")).otherwise(
            F.col("unique_tokens")
        ),
    )


def pair_twins(runs: DataFrame, suffix: str = "dedup") -> DataFrame:
    """Runs next to their twin whose name has ``suffix`` at the end."""
    twins = runs.filter(F.col("name").endswith(suffix)).select(
        F.regexp_replace("name", f"{suffix}$", "").alias("name"), F.col("loss").alias("twin_loss")
    )
    return runs.join(twins, "name")


def twin_runs(runs: DataFrame, suffix: str = "dedup") -> DataFrame:
    """Loss of each run and its twin by epochs, and the twin's gain."""
    return (
        pair_twins(runs, suffix)
        .withColumn("epochs", F.try_divide(F.col("tokens"), F.col("unique_tokens")))
        .withColumn("gain", F.col("loss") - F.col("twin_loss"))
    )
