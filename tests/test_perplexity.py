"""Perplexity held against a plain version, and what it writes on the way."""

import math
from collections import Counter
from pathlib import Path

import pytest

from corpuslab.operators import perplexity, tallies
from corpuslab.session import shared_folder

# doc_id, text: repeated and null keys, null, empty and long texts, words that are marks.
TEXTS = [
    (1, "the cat sat on the mat"),
    (2, "the dog sat on the cat"),
    (3, None),
    (4, ""),
    (5, "x"),
    (6, "new words nobody wrote"),
    (6, "the cat sat"),
    (None, "the mat"),
    (None, "on the mat <s> the </s> cat"),
    (7, "the cat " * 40 + "sat"),
]


def pairs_of(text):
    words = [perplexity.BEGIN, *(word for word in text.split(" ") if word), perplexity.END]
    return list(zip(words[:-1], words[1:], strict=True))


def plain(texts, model, share=0.75):
    before, word = Counter(), Counter()
    for (a, b), n in model.items():
        before[a] += n
        word[b] += n
    size = sum(model.values()) + len(word) + 1
    logs = {}
    for key, text in texts:
        for a, b in pairs_of(text) if text is not None else []:
            p = share * (model[a, b] / before[a] if before[a] else 0.0) + (1 - share) * (word[b] + 1) / size
            logs.setdefault(key, []).append(math.log10(p) if p > 0 else None)
    means = {key: [x for x in found if x is not None] for key, found in logs.items()}
    return {key: round(10 ** (-sum(x) / len(x)), 1) if x else None for key, x in means.items()}


@pytest.mark.parametrize("at_once", [3, 50, tallies.PAIRS_AT_ONCE])
@pytest.mark.parametrize("share", [0.75, 1.0])
def test_perplexity_is_that_of_a_plain_version(spark, monkeypatch, at_once, share):
    monkeypatch.setattr(tallies, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(tallies, "ROWS_AT_ONCE", at_once)
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)
    model = perplexity.train_ngram(df.filter("doc_id in (1, 2, 3, 4, 7)"))
    counted = Counter(pair for key, text in TEXTS if key in (1, 2, 4, 7) for pair in pairs_of(text))
    assert {(r["before"], r["word"]): r["n"] for r in model.collect()} == counted
    got = [tuple(row) for row in perplexity.perplexity(df, model, share=share).collect()]
    want = plain(TEXTS, counted, share)
    assert len(got) == len(want)
    assert dict(got) == pytest.approx(want)


def test_passages_keep_their_key_and_number(spark, monkeypatch):
    monkeypatch.setattr(tallies, "PAIRS_AT_ONCE", 5)
    df = spark.createDataFrame([("a", "the cat sat on the mat"), ("b", "a dog"), ("c", None)], "name string, text string")
    model = perplexity.train_ngram(df, "name")
    counted = Counter(pair for text in ("the cat sat on the mat", "a dog") for pair in pairs_of(text))
    parts = {"a": ["the cat ", "sat on ", "the mat"], "b": ["a dog"]}
    scores = {key: list(plain(list(enumerate(texts)), counted).values()) for key, texts in parts.items()}
    got = {row[0]: tuple(row)[1:] for row in perplexity.passage_perplexity_range(df, model, 2, "name").collect()}
    assert got == {key: (int(min(found)), int(max(found))) for key, found in scores.items()}


def test_a_model_without_counts_gives_nulls(spark):
    df = spark.createDataFrame(TEXTS[:2], "doc_id bigint, text string")
    got = perplexity.perplexity(df, perplexity.train_ngram(df.filter("false"))).collect()
    assert sorted(tuple(row) for row in got) == [(1, None), (2, None)]


def test_no_row_per_word_is_written(spark):
    texts = [(doc, " ".join(f"w{(doc * 31 + i * i) % 997}" for i in range(300))) for doc in range(40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    model = perplexity.materialize(perplexity.train_ngram(df.filter("doc_id < 4")))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    known = set(folder.iterdir())
    assert perplexity.perplexity(df, model).count() == 40
    written = sum(spark.read.parquet(str(path)).count() for path in set(folder.iterdir()) - known)
    # Before, every pair of neighbours was written as a row.
    assert written < 40
