"""Repeated passages against plain search for every window."""

import hashlib
import random

import numpy as np
import pytest

from corpuslab.llm import superkmers

SCHEMA = "doc_id bigint, text string, id bigint, mark string, body string, words int, parts int, anchor int"


def plain(docs, window):
    split = [(key, (text or "").encode().split()) for key, text in docs]
    first = {}
    for key, words in split:
        if key is not None:
            for at in range(len(words) - window + 1):
                seen = tuple(words[at : at + window])
                first[seen] = min(key, first.get(seen, key))
    out = []
    for key, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if key is not None and first[tuple(words[at : at + window])] < key:
                gone |= set(range(at, at + window))
        kept = b" ".join(word for at, word in enumerate(words) if at not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, docs, window):
    table = spark.createDataFrame([(key, text, 1, "m", "b", 2, 3, 4) for key, text in docs], SCHEMA)
    return sorted(map(tuple, superkmers.remove_repeats(table, window).collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "é", "日本", "Long" * 9, *(f"w{i}" for i in range(40))])
    shared = [[word() for _ in range(rng.randint(20, 60))] for _ in range(6)]
    docs = []
    for key in range(150):
        line = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            cut = rng.randint(0, 10)
            line += part[cut : len(part) - rng.randint(0, 5)] + [word() for _ in range(rng.randint(0, 4))]
        docs.append((key, rng.choice([" ", "\n", " \t"]).join(line)))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (3, docs[3][1]), (3, docs[5][1]), (None, docs[3][1]), (None, None)]
    docs += [(300, None), (301, ""), (302, " \n\t"), (303, "same " * 400), (304, "same " * 300 + "end"), (305, "x" * 20_000)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("bucket", [4096, 2])
@pytest.mark.parametrize("window", [1, 5, 16])
def test_removed_words_match_plain_search(spark, monkeypatch, docs, window, bucket):
    monkeypatch.setattr(superkmers, "BUCKET", bucket)
    monkeypatch.setattr(superkmers, "AT_ONCE", 64)
    want = plain(docs, window)
    assert found(spark, docs, window) == want
    assert sum(row[2] for row in want) > 1000


def test_one_passage_in_ever_other_surroundings(spark):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(20)]
    docs = [(key, " ".join([f"a{rng.random()}", *passage, f"b{rng.random()}"])) for key in range(300)]
    want = plain(docs, 10)
    assert found(spark, docs, 10) == want and sum(row[2] > 0 for row in want) == 299


def test_empty_table(spark):
    assert found(spark, [], 5) == []


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 9, size)).encode() for size in (0, 3, 4, 5, 60, 2000)]
    text, first, last, _, _ = superkmers.find_runs(texts, 4, 2)
    for at, raw in enumerate(texts):
        covered = [w for t, a, b in zip(text, first, last, strict=True) if t == at for w in range(a, b + 1)]
        assert covered == list(range(max(0, len(raw.split()) - 3)))
    assert (last - first < 3).all()
