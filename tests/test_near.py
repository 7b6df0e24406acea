"""Near-duplicate clusters against all pairs, positions of strings against plain search."""

import random
import re

import numpy as np
import pytest
from conftest import rows

from corpuslab.functions import minhash
from corpuslab.operators import duplicates as dup
from corpuslab.operators import lookup, near

DOCS = "doc_id bigint, text string"


def shingles(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def clusters(docs, percent=80):
    sets = {key: shingles(text) for key, text in docs if key is not None}
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(sets)
    for i, one in enumerate(keys):
        for two in keys[i + 1 :]:
            shared = len(sets[one] & sets[two])
            if shared and 100 * shared >= percent * len(sets[one] | sets[two]):
                low, high = sorted((find(one), find(two)))
                root[high] = low
    return {key: find(key) for key in keys}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    block = [word() for _ in range(60)]
    out = []
    for line in base:
        out += [line, line, [w.upper() for w in line], [*line, word()], [word(), *line[1:]], line[: len(line) * 9 // 10]]
    # Pages of one block and a part of their own: alike in many bands, but not near.
    out += [[*block, *(word() for _ in range(40))] for _ in range(40)]
    texts = [" ".join(line) for line in out] + ["", None, " \t\n", "one", "ONE", "one two"]
    return list(enumerate(texts))


def test_clusters_match_all_pairs(spark, docs):
    want = clusters(docs)
    got = near.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: r.cluster_id for r in got} == want
    sizes = {key: list(want.values()).count(label) for key, label in want.items()}
    assert {r.doc_id: r.cluster_size for r in got} == sizes
    assert {r.doc_id: r.near_dup for r in got} == {key: size > 1 for key, size in sizes.items()}
    assert {r.doc_id: r.n_shingles for r in got} == {key: len(shingles(text)) for key, text in docs}


def test_repeated_rows_null_keys_and_empty_tables(spark):
    line = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, line + " end"), (3, None)], DOCS)
    got = sorted((r.doc_id or 0, r.cluster_id, r.cluster_size) for r in near.near_duplicates(df).collect())
    assert got == [(0, None, 1), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 1)]
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimates_the_similarity():
    one = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64))
    two = np.concatenate((one[:2400], one[:600] + np.uint64(1)))
    alike = np.mean(minhash.sketch(one, 2000, 5) == minhash.sketch(two, 2000, 5))
    assert abs(alike - 2400 / 3600) < 0.05


def test_near_only_with_clusters(spark, docs):
    df = spark.createDataFrame(docs, DOCS)
    marked = dup.annotate_duplicates(df, 50).select("doc_id", "dup_ratio").join(near.near_duplicates(df), "doc_id")
    found = dup.near_only(marked).collect()
    assert all(r.cluster_size > 1 and r.dup_ratio == 0 for r in found)


@pytest.mark.parametrize("unit", ["chars", "bytes"])
@pytest.mark.parametrize("limit", [1 << 20, 5])
def test_positions_match_plain_search(spark, monkeypatch, unit, limit):
    monkeypatch.setattr(lookup, "QUERY_BYTES", limit)
    monkeypatch.setattr(lookup, "HITS_PER_BATCH", 7)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab😀é ") for _ in range(80)) for _ in range(8)] + ["", None, "aaaa"]
    queries = ["a", "aa", "aab", "é", "😀 ", texts[0], "zz", "", None, "aa"]
    code = (lambda t: t) if unit == "chars" else (lambda t: t.encode())
    want = []
    for doc, text in enumerate(texts):
        for query in {q for q in queries if q}:
            held, sought = code(text or ""), code(query)
            want += [(doc, query, i) for i in range(len(held)) if held.startswith(sought, i)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    assert rows(lookup.occurrence_positions(df, asked, unit)) == sorted(want)
    counted = {(r["query"], r.occurrences, r.num_docs) for r in lookup.count_occurrences(df, asked, unit).collect()}
    assert counted == {
        (q, sum(w[1] == q for w in want), len({w[0] for w in want if w[1] == q})) for q in queries if q
    }
    assert lookup.occurrence_positions(df, asked.limit(0), unit).count() == 0
