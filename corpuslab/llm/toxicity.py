"""Toxic passages as maximum-scoring segments of token log-odds.

Term frequencies of toxic and of clean training texts are smoothed with a
Dirichlet prior that follows the whole training corpus. Words that are
significantly more frequent in toxic texts are terms. A toxic passage is
modelled as background mixed with terms, so that a term scores the log-odds of
the two and any other word a small negative number. All maximal segments of a
text are found in one scan. Scores are log-likelihood ratios, so the number of
segments as good by chance in n words is ``K * n * exp(-score)``, where K is
counted in the clean training texts. The segments of a text are summed up by the
extreme-value statistic of their sum, which a logistic curve turns into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import materialize

WORD = re.compile(r"\w+")
# Segments of at least this score are counted to estimate K.
COUNTED_FROM = 1.0
# Ends of the statistic of a text.
LOWEST, HIGHEST = -10.0, 60.0
SEGMENTS = "array<struct<first: bigint, last: bigint, score: double>>"


@dataclass(frozen=True)
class Model:
    """Scores of the terms, of any other word, and the calibration."""

    terms: dict[str, float]
    other: float
    k: float = 1.0
    slope: float = 1.0
    offset: float = 0.0


def word_counts(texts: DataFrame) -> DataFrame:
    """Clean and toxic texts ``(body, toxic)`` that hold a word: ``(word, clean, toxic)``.

    Texts are counted, not occurrences, since words come in bursts; the empty
    word counts all texts. Tasks add up before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({"", *WORD.findall((text.as_py() or "").lower())})
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield rows(counts)
                counts = (Counter(), Counter())
        yield rows(counts)

    def rows(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = list(counts[0] | counts[1])
        columns = [pa.array(words, pa.string())]
        columns += [pa.array([side[word] for word in words], pa.int64()) for side in counts]
        return pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])

    counted = texts.mapInArrow(run, "word string, clean bigint, toxic bigint")
    return counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_terms(
    counts: DataFrame, prior: float = 0.1, least_z: float = 4.0, least_odds: float = 2.0, share: float = 0.2, max_terms: int = 50_000
) -> Model:
    """Terms and their scores from word counts of all training texts.

    ``prior`` is the weight of the corpus-wide word frequencies as a part of
    the training texts, ``least_z`` the significance of a term, ``least_odds``
    its least log-odds (longer texts hold more of every word), ``share`` the
    part of a toxic passage that is terms. The model holds the ``max_terms``
    most significant terms, which bounds what is sent to the tasks.
    """
    counts = materialize(counts)
    other = math.log(1 - share)
    texts = counts.filter("word = ''").first()
    if texts is None or not texts.clean or not texts.toxic:
        return Model({}, other)
    clean, toxic = texts.clean, texts.toxic
    counts = counts.filter("word <> ''")
    words_of_text = (counts.agg(F.sum("clean")).first()[0] or 0) / clean
    weight = prior * (clean + toxic)
    alpha = F.lit(prior) * (F.col("clean") + F.col("toxic"))

    def rate(count: Column, total: int) -> Column:
        return (count + alpha) / F.lit(total + weight)

    def odds(count: Column, total: int) -> Column:
        return F.log((count + alpha) / (F.lit(total + weight + 1) - count - alpha))

    delta = odds(F.col("toxic"), toxic) - odds(F.col("clean"), clean)
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    found = (
        counts.select(
            "word", (delta / spread).alias("z"), delta.alias("odds"), rate(F.col("toxic"), toxic).alias("f1"), rate(F.col("clean"), clean).alias("f0")
        )
        .filter((F.col("z") >= least_z) & (F.col("odds") >= least_odds))
        .orderBy(F.desc("z"), "word")
        .limit(max_terms)
        .collect()
    )
    excess = sum(row.f1 - row.f0 for row in found)
    # Rates are per text; words of a passage and of the background are compared per word.
    terms = {
        row.word: math.log(1 - share + share * (row.f1 - row.f0) / excess / (row.f0 / max(words_of_text, 1.0)))
        for row in found
    }
    return Model({word: score for word, score in terms.items() if score > 0}, other)


def maximal_segments(at: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments in linear time.

    Only the places ``at`` of positive ``scores`` are given; every word between
    them scores ``other < 0``. Returns first place, last place and total.
    """
    # A candidate: first, last, total before it, total with it, the candidate
    # to its left whose total before it is smaller (-1: none).
    found: list[list] = []
    total, after = 0.0, 0
    for place, score in zip(at, scores, strict=True):
        total += other * (place - after)
        candidate = [place, place, total, total + score, -1]
        total, after = total + score, place + 1
        while True:
            left = len(found) - 1
            while left >= 0 and found[left][2] >= candidate[2]:
                left = found[left][4]
            if left < 0 or found[left][3] >= candidate[3]:
                candidate[4] = left
                found.append(candidate)
                break
            candidate = [found[left][0], candidate[1], found[left][2], candidate[3], -1]
            del found[left:]
    return [(first, last, high - low) for first, last, low, high, _ in found]


def segment_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``n_words`` and ``segments`` (in words) and leave out the text."""
    kept = [name for name in docs.columns if name != text]
    schema = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = model.terms
        for batch in batches:
            sizes, segments = [], []
            for value in batch.column(text):
                words = WORD.findall((value.as_py() or "").lower())
                at = [place for place, word in enumerate(words) if word in terms]
                sizes.append(len(words))
                found = maximal_segments(at, [terms[words[place]] for place in at], model.other)
                segments.append([{"first": a, "last": b, "score": s} for a, b, s in found])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(segments, kind)], [*kept, "n_words", "segments"]
            )

    return docs.mapInArrow(run, f"{schema}{', ' * bool(kept)}n_words bigint, segments {SEGMENTS}")


def sum_statistic(k: float) -> Column:
    """The best of ``sum of the r best scores - r * ln(K n + 1) + ln r!`` over r.

    It is kept between two fixed ends; the lower one is that of texts without segments.
    """
    room = F.log(F.lit(k) * F.greatest("n_words", F.lit(1)) + 1)
    scores = F.sort_array(F.transform("segments", lambda s: s["score"]), asc=False)
    start = F.struct(
        F.lit(0.0).alias("sum"), F.lit(0.0).alias("r"), F.lit(0.0).alias("log"), F.lit(LOWEST).alias("best")
    )

    def add(state: Column, score: Column) -> Column:
        r = state["r"] + 1
        total, log = state["sum"] + score - room, state["log"] + F.log(r)
        return F.struct(
            total.alias("sum"), r.alias("r"), log.alias("log"), F.greatest(state["best"], total + log).alias("best")
        )

    return F.least(F.aggregate(scores, start, add, lambda state: state["best"]), F.lit(HIGHEST))


def fit_logistic(points: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Slope (not negative) and offset of P(1 | x) for ``(x, clean, toxic)`` counts, slightly regularised."""
    data = np.array(points, float).reshape(-1, 3)
    clean, toxic = data[:, 1], data[:, 2]
    scale = max(float(np.abs(data[:, 0]).max(initial=0.0)), 1.0) / 8
    x = data[:, 0] / scale
    ridge = np.array([0.05, 0.001])

    def loss(at: np.ndarray) -> float:
        z = at[0] * x + at[1]
        return float((clean * np.logaddexp(0, z) + toxic * np.logaddexp(0, -z)).sum() + (ridge * at * at).sum() / 2)

    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w = (clean + toxic) * p * (1 - p)
        residual = toxic - (clean + toxic) * p
        gradient = np.array([(residual * x).sum(), residual.sum()]) - ridge * at
        hessian = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        while loss(at + step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at + step
        if np.abs(step).max() <= 1e-9:
            break
    return max(float(at[0]) / scale, 0.0), float(at[1])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 4,
    held: int = 2,
    threshold: float = 0.3,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Toxicity of all texts, learnt from the labelled ones outside the held-out fold.

    Returns ``key, held_out, score, predicted, n_words, segments`` per row of
    ``docs``; ``segments`` are the significant passages: first and last word,
    score and the number of passages as good expected by chance. A row is held
    out if ``crc32(key as text) % folds = held``; a null key is not held out.
    Only the text decides a score. Null, empty and word-free texts have no
    passage and score as any text without one. Repeated labels of a key
    count once, toxic if any says so; null labels do not count. Without any
    labelled text of both kinds every text scores about the share of toxic ones
    (0 without labels).
    """
    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
    held_out = F.coalesce(fold == held, F.lit(False))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body"), held_out.alias("held_out"))
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull())
    marks = marks.groupBy(F.col(key).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    training = rows.filter(~F.col("held_out")).join(marks.hint("merge"), "id").select("body", "toxic")
    model = fit_terms(word_counts(training))
    scanned = materialize(segment_texts(rows, model, "body"))
    model = calibrate(scanned.filter(~F.col("held_out")).join(marks, "id"), model)

    statistic = sum_statistic(model.k)
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * statistic + F.lit(model.offset))))
    chance = lambda s: F.lit(model.k) * F.col("n_words") * F.exp(-s["score"])
    significant = F.filter(
        F.transform(
            "segments", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["score"].alias("score"), chance(s).alias("chance"))
        ),
        lambda s: s["chance"] <= 1,
    )
    return scanned.select(F.col("id").alias(key), "held_out", score.alias("score"), "n_words", significant.alias("segments")).select(
        key, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "segments"
    )


def calibrate(marked: DataFrame, model: Model) -> Model:
    """Estimate K on clean texts and the curve on all marked texts (columns of a scan and ``toxic``)."""
    good = F.size(F.filter("segments", lambda s: s["score"] >= COUNTED_FROM))
    clean = marked.filter("toxic = 0").agg(F.sum(good).alias("segments"), F.sum("n_words").alias("words")).first()
    k = max((clean.segments or 0) + 1, 1) * math.exp(COUNTED_FROM) / max((clean.words or 0) + 1, 1)
    # Counts of texts by statistic, in steps of 1/8.
    step = F.round(sum_statistic(k) * 8) / 8
    bins = marked.groupBy(step.alias("x")).agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).collect()
    slope, offset = fit_logistic([tuple(row) for row in bins]) if bins else (0.0, -30.0)
    return Model(model.terms, model.other, k, slope, offset)
