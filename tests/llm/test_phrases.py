"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuslab.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, n bigint, gram string, size int"


def plain(docs, minimum, top, longest=5):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        able = {g: a for g, a in counts.items() if len(g) > 1 and a >= minimum}
        kept = []
        for g, a in able.items():
            if any(
                100 * b >= 100 * a and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
                for h, b in able.items()
            ):
                continue
            n = total[lang]
            score, k = min((1000 * a * n // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            kept.append((score, a, " ".join(g), counts[g[:k]], counts[g[k:]], n))
        kept.sort(key=lambda row: (-row[0], -row[1], row[2].encode()))
        out += [(lang, i + 1, p, a, left, r, n, s) for i, (s, a, p, left, r, n) in enumerate(kept[:top])]
    return sorted(out)


def mined(spark, docs, **options):
    rows = [(i, text, lang, 7, "clash", 3) for i, (lang, text) in enumerate(docs)]
    return sorted(map(tuple, phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA), **options).collect()))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    words = ["a", "B", "é", "the", "of", "x\x01y", "日本", "zz", "q-q", *(f"w{i}" for i in range(30))]
    gaps, stops = [" ", "  ", "\t", " \t "], [". ", ",", "\n", ";; ", "! "]
    passage = " ".join(f"p{i}" for i in range(40))
    docs = []
    for at in range(120):
        line = ""
        for _ in range(rng.randint(0, 60)):
            line += rng.choice(words[:9] if rng.random() < 0.7 else words) + (rng.choice(stops) if rng.random() < 0.1 else rng.choice(gaps))
        if at % 4 == 0:
            line += rng.choice(["", "the ", "B "]) + passage + rng.choice(["", " end", ". of"])
        docs.append((rng.choice(["en", "en", "en", "de", None, "und"]), line))
    return [*docs, ("en", None), (None, ""), ("fr", " .. \t"), docs[0], docs[0]]


@pytest.mark.parametrize("minimum,top", [(1, 10_000), (3, 40), (12, 5)])
def test_phrases_match_plain_counting(spark, docs, minimum, top):
    want = plain(docs, minimum, top)
    assert mined(spark, docs, minimum=minimum, top=top) == want
    assert len(want) >= 10


@pytest.mark.parametrize("longest", [2, 3, 7])
def test_other_lengths(spark, docs, longest):
    assert mined(spark, docs, minimum=4, top=200, longest=longest) == plain(docs, 4, 200, longest)


def test_small_maps_and_blocks_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "MAP_BITS", 4)
    monkeypatch.setattr(phrases, "BLOCK", 300)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert mined(spark, docs, minimum=3, top=100) == plain(docs, 3, 100)


def test_one_word_over_and_over_and_empty_tables(spark):
    docs = [("en", "na " * 50), ("en", "na na, na na na"), ("en", "x" * 5000 + " y")]
    assert mined(spark, docs, minimum=2) == plain(docs, 2, 2000)
    assert mined(spark, [], minimum=2) == []
    assert mined(spark, [("en", None)], minimum=2) == []


def test_long_texts(spark):
    rng = np.random.default_rng(2)
    text = " ".join(f"w{i}" for i in rng.integers(0, 40, 30_000))
    assert mined(spark, [("en", text)], minimum=8, top=300) == plain([("en", text)], 8, 300)


def test_unary_paths(spark):
    schema = "lang string, gram string, size int, n bigint"
    edges = [("en", f"{a} {b}", 2, n) for a, b, n in [("a", "b", 5), ("b", "c", 5), ("c", "d", 3), ("c", "e", 2), ("e", "f", 2)]]
    nodes = [("en", w, 1, n) for w, n in [("a", 5), ("b", 5), ("c", 5), ("d", 3), ("e", 2), ("f", 2), ("g", 9)]]
    got = phrases.compact(spark.createDataFrame(edges, schema), spark.createDataFrame(nodes, schema)).collect()
    assert sorted((r.passage, r.n) for r in got) == [("a b c", 5), ("d", 3), ("e f", 2), ("g", 9)]
