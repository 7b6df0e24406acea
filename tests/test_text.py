import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import domains, mixtures, packing, passages, perplexity, profile


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("a\nb", "ab"),
        ("\x00\x1f\x7f\x9f", ""),
        ("  a　b ", "a b"),
        ("x—y…", "x - y..."),
        ("12 ٣", "00 0"),
        ("“q” ’s", "\"q\" 's"),
        ("", ""),
    ],
)
def test_normalisation(spark, given, want):
    assert one(spark, given, tx.normalized("text")) == want


def test_normalisation_switches(spark):
    # The full-width one is a digit first; alone, the punctuation map turns it into a quote.
    assert one(spark, "１", tx.normalized("text")) == "0"
    assert one(spark, "１", tx.normalized("text", digits=False)) == '"'
    assert one(spark, "Ab\n", tx.normalized("text", control=False, strip=False, lower=True)) == "ab "


def test_domains(spark):
    urls = ["http://a.b/c", "http://a.b:80/", "a.b", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r["domain"] for r in tx.with_domain(df).collect()] == ["a.b", "a.b:80", None, None, None]


def test_blindspots_mark_absent_domains(spark):
    a = spark.createDataFrame([("http://x/",)] * 3 + [("http://y/",)], "url string")
    b = spark.createDataFrame([("http://x/",)], "url string")
    found = domains.blindspots(domains.domain_counts(a), domains.domain_counts(b), 10).collect()
    assert [(r["domain"], r["ratio"]) for r in found] == [("y", 13131313.0), ("x", 0.75)]


def test_metadata(spark):
    printed = spark.createDataFrame([("{'perplexity_score': 512.7, 'x': 1}",), ("{}",)], "meta string")
    assert [r["perplexity"] for r in tx.with_meta_perplexity(printed, as_int=True).collect()] == [512, None]
    typed = spark.createDataFrame(
        [((3.5, ("http://a/",)),)],
        "meta struct<perplexity_score: double, warc_headers: struct<`warc-target-uri`: string>>",
    )
    assert tx.with_meta_perplexity(typed).first()["perplexity"] == 3.5
    assert tx.with_url(typed, "oscar").first()["url"] == "http://a/"
    assert tx.with_url(typed, "roots_en").first()["url"] is None


def test_clip_histogram_and_shares(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 5.0, 10.0, 12.0, -1.0)], "v double")
    assert rows(df.select(tx.clipped("v", 10, 20))) == [(-1.0,), (0.0,), (5.0,), (20.0,), (20.0,)]
    assert rows(profile.histogram(df, "v", 2, 0, 10).select("bin", "count")) == [(0, 1), (1, 2)]
    assert rows(profile.histogram(df, "v", 2, 0, 10, clip=10).select("bin", "count")) == [(0, 1), (1, 3)]
    assert profile.in_ratio(df, F.col("v") < 5).first()[0] == 40.0


def cut(text, passage, overlap):
    breaks = [-1] + [i for i, c in enumerate(text) if c in " \t\n\r\x0b\x0c"]
    out = []
    for i in range(0, len(breaks), passage - overlap):
        if i + passage >= len(breaks):
            return out + [text[breaks[i] + 1 :]]
        out.append(text[breaks[i] + 1 : breaks[i + passage] + 1])
    return out


@pytest.mark.parametrize("passage,overlap", [(2, 0), (3, 1), (5, 4)])
def test_segments(spark, passage, overlap):
    texts = ["", "abc", "a é  c d\te f ", "one two three four", " x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in passages.segment(df, passage, overlap).orderBy("doc_id", "seg").collect():
        got.setdefault(r["doc_id"], []).append(r["passage"])
    assert got == {i: cut(t, passage, overlap) for i, t in enumerate(texts)}
    short = passages.choose_passage(df, max_length=3, passage=passage)
    for r in short.collect():
        assert r["passage"] in (cut(r["text"], passage, 0) if len(r["text"]) > 3 else [r["text"]])


def test_perplexity_formula(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id bigint, text string")
    model = perplexity.train_ngram(df.filter("doc_id = 1"))
    got = dict(rows(perplexity.perplexity(df, model)))
    unigram = lambda n: 0.25 * (n + 1) / (3 + 3 + 1)
    first = [0.75 + unigram(1)] * 3
    second = [0.75 + unigram(1), unigram(0), unigram(1)]
    for doc, parts in ((1, first), (2, second)):
        assert got[doc] == round(10 ** (-sum(map(math.log10, parts)) / 3), 1)


def test_percentile_filters_are_strict(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "perplexity double")
    assert rows(perplexity.below_percentile(df, "perplexity", 50)) == [(1.0,), (2.0,)]
    assert rows(perplexity.between_percentiles(df, "perplexity", 25, 75)) == [(3.0,)]


def test_packing(spark):
    lists = [[1, 2, 3], [], [4], [5, 6, 7, 8, 9], [10, 11], [12]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id bigint, input_ids array<int>")
    for parts in (1, 5):
        packed = packing.pack_sequences(df.repartition(parts), 2, batch=4)
        got = [r["input_ids"] for r in packed.orderBy("batch_no", "block_no").collect()]
        assert got == [[1, 2], [3, 4], [5, 6], [7, 8], [10, 11]]


def test_mixtures(spark):
    lines = ['"train: 0.1 0:1 /a/b, 0.9 0:1 /c"', '"valid: 1.0 0:1 /v" "valid_x: 1.0 0.95:1  /x"']
    spec = mixtures.mixture_spec(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert rows(spec) == [
        ("train", "/a/b", 0.1, 0.0, 1.0), ("train", "/c", 0.9, 0.0, 1.0),
        ("valid", "/v", 1.0, 0.0, 1.0), ("valid_x", "/x", 1.0, 0.95, 1.0),
    ]
    docs = spark.createDataFrame(
        [(i, "a" if i < 4 else "b", 10) for i in range(10)], "doc_id bigint, source string, tokens bigint"
    )
    got = mixtures.mix(docs, {"a": 0.9, "b": 0.1, "c": 0.0}, 100, "tokens")
    counts = {(r["source"], r["epoch"]): r["count"] for r in got.groupBy("source", "epoch").count().collect()}
    assert counts == {("a", 0): 4, ("a", 1): 4, ("a", 2): 1, ("b", 0): 1}
    both = mixtures.concat({"x": docs, "y": docs.drop("tokens")})
    assert both.filter("dataset = 'y'").filter("tokens is null").count() == 10
