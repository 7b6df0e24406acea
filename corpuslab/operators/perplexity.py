"""Perplexity of documents under an n-gram model counted in Spark.

The model is a table of bigram counts of a reference slice. A word's
probability mixes its share after the word before it with its smoothed share
overall. Scoring works on distinct word pairs: each pair of a chunk of texts
gets its counts and its logarithm once.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import normalized
from corpuslab.operators import tallies
from corpuslab.operators.order import exact_quantiles
from corpuslab.operators.passages import segment
from corpuslab.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEGIN, END = "<s>", "</s>"


def lm_tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Normalised words of every document: ``(key, words)``."""
    words = F.filter(F.split(normalized(text), " ", -1), lambda word: word != "")
    return df.select(key, words.alias("words"))


def _framed(words: str) -> Column:
    return F.concat(F.array(F.lit(BEGIN)), F.col(words), F.array(F.lit(END)))


def word_pairs(tokens: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Neighbouring words, with marks at both ends: ``(key, before, word)``."""
    return (
        tokens.select(*key, _framed("words").alias("framed"))
        .select(
            *key,
            F.explode(
                F.arrays_zip(
                    F.slice("framed", F.lit(1), F.size("framed") - 1).alias("before"),
                    F.slice("framed", F.lit(2), F.size("framed") - 1).alias("word"),
                )
            ).alias("pair"),
        )
        .select(*key, "pair.before", "pair.word")
    )


def train_ngram(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bigram counts ``(before, word, n)`` of a reference slice.

    Words have no spaces, so a pair travels as one string, which takes less.
    """
    pairs = word_pairs(lm_tokens(df, key, text), [key]).select(F.concat_ws(" ", "before", "word").alias("pair"))
    words = F.split("pair", " ", -1)
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).select(words[0].alias("before"), words[1].alias("word"), "n")


def pair_log10(
    n: np.ndarray, n_before: np.ndarray, n_word: np.ndarray, size: float, share: float = 0.75
) -> np.ndarray:
    """``log10`` of the probability of word pairs with the given counts in the model, not a number for 0.

    ``share`` weighs the bigram estimate, the rest goes to the unigram estimate
    with one added to every count, so that unknown words get a value too.
    ``size`` is the sum of those counts and one more.
    """
    bigram = np.divide(n, n_before, out=np.zeros(len(n)), where=n_before != 0)
    probability = share * bigram + (1.0 - share) * ((n_word + 1) / size)
    return np.log10(probability, out=np.full(len(n), np.nan), where=probability > 0)


def score_tokens(
    tokens: DataFrame, model: DataFrame, key: Sequence[str] = ("doc_id",), share: float = 0.75
) -> DataFrame:
    """``round(10 ** (-sum(log10 p) / (words + 1)), 1)`` per key.

    Words travel as 64-bit numbers and stay packed by texts; only what texts
    want to know of the model and its counts are sent (see ``tallies``). The
    model is read twice, so pass a written table.
    """
    key = list(key)
    coded = model.select(*(F.xxhash64(side).alias(side) for side in ("before", "word")), "n")
    sizes = coded.agg(F.sum("n").alias("total"), F.count_distinct("word").alias("vocabulary")).first()
    # A model without counts tells nothing: every value is null.
    size = float("nan") if sizes["total"] is None else float(sizes["total"] + sizes["vocabulary"] + 1)
    codes = F.transform(_framed("words"), lambda word: F.xxhash64(word))
    found = tallies.sums_of_pairs(
        tokens.select(*key, codes.alias("codes")),
        coded,
        key,
        lambda n, n_before, n_word: pair_log10(n, n_before, n_word, size, share),
    )
    mean = -F.try_divide(F.sum("total"), F.sum("valued"))
    return found.groupBy(*key).agg(F.round(F.pow(F.lit(10.0), mean), 1).alias("perplexity"))


def perplexity(
    df: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.75
) -> DataFrame:
    """Perplexity of every document: ``(key, perplexity)``."""
    return score_tokens(lm_tokens(df, key, text), model, [key], share)


def passage_perplexity_range(
    df: DataFrame,
    model: DataFrame,
    passage: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    share: float = 0.75,
) -> DataFrame:
    """Lowest and highest perplexity (whole numbers) over a document's passages."""
    parts = segment(df, passage, 0, key, text)
    words = F.filter(F.split(normalized("passage"), " ", -1), lambda word: word != "")
    scored = score_tokens(parts.select(key, "seg", words.alias("words")), model, [key, "seg"], share)
    whole = F.col("perplexity").cast("bigint")
    return scored.groupBy(key).agg(
        F.min(whole).alias("min_perplexity"), F.max(whole).alias("max_perplexity")
    )


def below_percentile(df: DataFrame, column: str, percent: float) -> DataFrame:
    """Rows strictly below the interpolated percentile."""
    bounds = exact_quantiles(df, column, {"high": percent / 100})
    return df.filter(F.col(column) < bounds.scalar())


def between_percentiles(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows strictly between two interpolated percentiles."""
    bounds = materialize(exact_quantiles(df, column, {"low": low / 100, "high": high / 100}))
    return df.filter(
        (F.col(column) > bounds.select("low").scalar())
        & (F.col(column) < bounds.select("high").scalar())
    )


def threshold_table(df: DataFrame, column: str, percents: Sequence[float], accuracy: int = 1000) -> DataFrame:
    """What each cut-off percentile would keep: ``percent, threshold, sketched, below, above, n, rank_error``.

    ``threshold`` is exact and interpolated. ``sketched`` is read from a
    mergeable sketch made in one pass, whose rank is off by ``1 / accuracy`` of
    the rows and one row at most; ``rank_error`` is by how much it is. All rows are counted
    against all thresholds in a single scan.
    """
    names = [f"p{i}" for i in range(len(percents))]
    exact = materialize(exact_quantiles(df, column, {name: p / 100 for name, p in zip(names, percents, strict=True)}))
    points = F.array(*[F.lit(p / 100) for p in percents])
    sketch = materialize(df.agg(F.percentile_approx(column, points, accuracy).alias("found")))
    value = F.col(column)
    counts = [F.count(value).alias("n")]
    for i, name in enumerate(names):
        bound, near = exact.select(name).scalar(), sketch.select(F.col("found")[i]).scalar()
        counts += [
            F.count_if(value < bound).alias(f"below_{i}"),
            F.count_if(value > bound).alias(f"above_{i}"),
            F.count_if(value < near).alias(f"under_{i}"),
            F.count_if(value <= near).alias(f"upto_{i}"),
        ]
    counted = materialize(df.agg(*counts))
    size = F.col("n").cast("double")
    rows = [
        F.struct(
            F.lit(float(percent)).alias("percent"),
            exact.select(name).scalar().alias("threshold"),
            sketch.select(F.col("found")[i]).scalar().cast("double").alias("sketched"),
            F.col(f"below_{i}").alias("below"),
            F.col(f"above_{i}").alias("above"),
            # Equal values fill a span of ranks; the distance is to the nearest of them.
            F.col("n"),
            F.greatest(
                F.col(f"under_{i}") / size - percent / 100, F.lit(percent / 100) - F.col(f"upto_{i}") / size, F.lit(0.0)
            ).alias("rank_error"),
        )
        for i, (name, percent) in enumerate(zip(names, percents, strict=True))
    ]
    return counted.select(F.inline(F.array(*rows)))


def length_envelope(
    df: DataFrame, center: float = 590.0, spread: float = 10000.0, length: str = "text_length"
) -> DataFrame:
    """Bounds ``center ± spread / cbrt(length)`` and whether the score is inside."""
    width = F.try_divide(F.lit(spread), F.cbrt(F.col(length).cast("double")))
    return (
        df.withColumn("lower", F.lit(center) - width)
        .withColumn("upper", F.lit(center) + width)
        .withColumn(
            "is_in", (F.col("perplexity") > F.col("lower")) & (F.col("perplexity") < F.col("upper"))
        )
    )


def in_out_by_length(df: DataFrame, cut: float, width: int = 1000, length: str = "text_length") -> DataFrame:
    """Documents below and from ``cut`` upward per length bin."""
    return (
        df.groupBy(F.floor(F.col(length) / width).alias("length_bin"))
        .agg(
            F.count_if(F.col("perplexity") < cut).alias("inside"),
            F.count_if(F.col("perplexity") >= cut).alias("outside"),
        )
    )
