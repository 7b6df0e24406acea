"""The pipeline's stages against what their decisions say, and on odd rows."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslab.llm import mixing, ngram_join, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted int, fan_in int, copies int, times int"


def table(spark, rows):
    return spark.createDataFrame([(*row, len(row[1] or ""), 1, 2, 3, 4) for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_toxic_documents_go(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    kept = pipeline.reject_toxic(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(key for key, mark in scored.items() if mark == 0)
    assert tuple(kept.columns) == pipeline.COLUMNS
    odd = table(spark, [(1, "fine", "en", "a"), (1, "fine", "en", "a"), (None, None, None, None)])
    assert pipeline.reject_toxic(spark, odd, FOLDER).count() == 3


def test_one_document_of_each_group_stays(spark, docs):
    joined = ngram_join.similar_documents(docs, 5, 80).collect()
    kept = [r.doc_id for r in pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
    assert sorted(kept) == sorted({r.component_id for r in joined}) and len(kept) < docs.count()
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(4, line, "en", "a"), (2, line + " end", "en", "a"), (7, "short", "en", "a"), (7, "not so short", "en", "a")]
    rows += [(None, line, "en", "a"), (9, None, None, None)]
    got = pipeline.drop_near_copies(spark, table(spark, rows), FOLDER).collect()
    want = [(2, line + " end"), (7, "not so short"), (9, None), (None, line)]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_mix_follows_what_is_taken(spark, docs):
    taken = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    times = Counter(r.doc_id for r in pipeline.mix(spark, docs, FOLDER).collect())
    for key, row in taken.items():
        assert times[key] == (int(row.taken / row.size + 0.5) if row.size else 1)
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(1, words(10), "en", "a"), (2, words(100_000), "en", "b"), (3, words(10), "en", "c"), (4, "", "en", "c"), (None, "x", "en", "a")]
    got = Counter(r.doc_id for r in pipeline.mix(spark, table(spark, rows), FOLDER).collect())
    assert set(got) == {1, 2, 3, 4, None} and got[4] == got[None] == 1


def test_all_stages(spark):
    pieces = pipeline.run(spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in pipeline.STAGES:
        if name == "packing":
            break
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert tuple(docs.columns) == pipeline.COLUMNS
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = Counter()
    for row in docs.collect():
        sizes[row.doc_id] += len(tokenizer.encode(row.text or "", add_special_tokens=False).ids) + 1
    assert pieces.groupby("doc_id").length.sum().to_dict() == dict(sizes)
    filled = pieces.groupby("sequence_id").length.sum()
    assert filled.max() <= 1024 and np.isfinite(pieces.ids_crc32).all()


def test_stages_on_no_rows(spark, docs):
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0


def test_texts_with_the_usual_decision_are_not_shuffled(spark):
    """Both ways of a decision, repeated and missing ids, without a shuffle of the texts that stay as they are."""
    rows = [(key, f"text {key}", "en", "a") for key in range(1, 50)] + [(7, "other", "en", "b"), (None, "x", None, None)]
    docs = table(spark, rows).repartition(3)
    marks = spark.createDataFrame([(key, int(key in (3, 7))) for key, *_ in rows], "doc_id bigint, predicted int")
    plain, others = pipeline._split(docs, marks, "predicted = 0")
    assert sorted(r.text for r in others.collect()) == ["other", "text 3", "text 7"]
    assert sorted(r.text for r in plain.collect()) == sorted(text for key, text, *_ in rows if key not in (3, 7))
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "__word" in plan and "LeftOuter" in plan
