"""The operators against plain versions of what they compute, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslab.llm import (
    class_model,
    edit_counts,
    licences,
    mixing,
    ngram_join,
    packing,
    queries,
    spots,
    surrogates,
    toxicity,
    vectors,
)

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id bigint, text string, source string, lang string, label int, n bigint, low bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {row.doc_id: row.text or "" for row in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names used inside."""
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    data = [
        (1, None, "a", None, 1, 5, 6),
        (2, "", None, "en", None, 5, 6),
        (3, long, "a", "en", 1, 5, 6),
        (4, long, "b", "en", 1, 5, 6),
        (5, "the cat sat on the mat with a hat and a bat", "b", "en", 1, 5, 6),
        (5, "the cat sat on the mat with a hat and a bat", "b", "en", 1, 5, 6),
        (None, "x y z all rights reserved", "b", "en", 1, 5, 6),
        (6, "x", "b", "en", 1, 5, 6),
        (7, "  \t\n ", "b", "en", 1, 5, 6),
        (8, "日本語 😀 <|endoftext|> naïve «test»", None, "ja", 1, 5, 6),
    ]
    return spark.createDataFrame(data, SCHEMA)


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", text.translate(LOW))
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def linked(sets, percent):
    root = {node: node for node in sets}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    nodes = sorted(sets)
    for at, one in enumerate(nodes):
        for two in nodes[at + 1 :]:
            common = len(sets[one] & sets[two])
            if common and 100 * common >= percent * (len(sets[one]) + len(sets[two]) - common):
                a, b = sorted((find(one), find(two)))
                root[b] = a
    return {node: find(node) for node in nodes}


def test_ngram_join_finds_all_components(docs, texts):
    sets = {key: shingles(text, 4) for key, text in texts.items()}
    want = linked(sets, 85)
    got = {row.doc_id: (row.n_shingles, row.component_id) for row in ngram_join.similar_documents(docs, 4, 85).collect()}
    assert got == {key: (len(sets[key]), want[key]) for key in sets}


def test_ngram_join_with_frequent_shingles(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    data = []
    for key in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        data.append((key, " ".join(words)))
    sets = {key: shingles(text, 4) for key, text in data}
    want = linked(sets, 85)
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {row.doc_id: row.component_id for row in ngram_join.similar_documents(table, 4, 85).collect()}
    assert got == want


def test_ngram_join_odd_rows(odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(odd, 4, 85).collect()]
    assert len(got) == 10
    assert {(1, 0, 1), (2, 0, 2), (6, 1, 6), (7, 0, 7), (None, 3, None)} <= set(got)
    assert got.count((5, 9, 5)) == 2
    assert {row[2] for row in got if row[0] in (3, 4)} == {3}


def test_edit_counts_follow_full_encoding():
    counter = edit_counts.Counter(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    rng = random.Random(3)
    parts = ["a", "<|endoftext|>", " ", "  ", "\n", "'", "re", "12", "!", "é", "日本", "word ", " the", "😀", "don't", "  \n "]
    for size in (0, 1, 5, 40, 400, 2000) * 10:
        text = "".join(rng.choices(parts, k=size))
        tree = edit_counts.Tree.build(*counter.leaves(text))
        for _ in range(4):
            start, deleted = rng.randint(0, len(text)), rng.choice([0, 1, 5, 100])
            inserted = "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 200])))
            text, tree, _ = edit_counts.apply_edit(counter, tree, text, start, deleted, inserted)
            assert tree.tokens[1] == len(TOKENIZER.encode(text, add_special_tokens=False).ids)
            assert tree.chars[1] == len(text)


def test_edit_count_query(spark, texts):
    for row in queries.op1_edit_counts(spark, FOLDER).filter("doc_id % 20 = 0").collect():
        text = texts[row.doc_id]
        assert row.tokens_before == len(TOKENIZER.encode(text, add_special_tokens=False).ids)
        edited = text
        for start, deleted, inserted in (
            (len(text) // 3, 0, " [redacted] "),
            (len(text) // 2, 12, ""),
            (0, 3, text[:40]),
            (len(text), 0, "\n\nRevised."),
        ):
            edited = edited[:start] + inserted + edited[start + deleted :]
        assert row.tokens_after == len(TOKENIZER.encode(edited, add_special_tokens=False).ids)


def test_edit_counts_odd_rows(odd):
    counted = edit_counts.count_tokens(odd).withColumn("edits", F.expr("array(struct(1L as start, null as deleted, 'zz' as inserted), null)"))
    got = edit_counts.recount(counted).collect()
    assert len(got) == 10
    assert all(row.n_tokens == len(TOKENIZER.encode(row.text, add_special_tokens=False).ids) for row in got)


def test_surrogates(spark, odd):
    data = [
        (1, "Write to Anna.Bell@mail.com or anna.bell@mail.com, +1 (279) 555-0216."),
        (2, "+1 (279) 555-0216 met Mrs Anna Bell; Mrs Bell and Mr. John Doe. г-жа Анна Белова"),
        (3, 'card 4532 0151 1283 0366, token = "11acdfb36bb72224148e6160f674b4be45601bff", 10.1.2.3, DE89370400440532013000'),
        (4, "nothing to see here, version 1.2.3.4.5 and 2024-01-02"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_personal_data(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    text = {key: row.text for key, row in got.items()}
    for secret in ("Anna", "bell@", "555-0216", "Bell", "John", "Doe", "Белова", "0366", "11acdf", "10.1.2.3", "DE89370400440532013000"):
        assert secret not in "".join(text.values())
    assert text[4] == data[3][1] and got[4].n_entities == 0
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[1])[0]
    assert phone in text[2]
    names = re.search(r"Mrs (\w+) (\w+); Mrs (\w+) and Mr. (\w+) (\w+)", text[2]).groups()
    assert names[1] == names[2] != names[4] and names[0] != names[3]
    assert re.search("г-жа [А-Яа-я]+на [А-Яа-я]+ова", text[2])
    digits = [int(c) for c in re.sub(r"\D", "", re.search(r"card ([\d ]+),", text[3])[1])]
    assert sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits))) % 10 == 0
    iban = re.search(r"DE\d{20}", text[3])[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    kept = surrogates.replace_personal_data(odd)
    assert kept.count() == 10 and kept.filter("n_entities > 0").count() == 0


def test_surrogates_are_distinct(spark):
    data = [(i, f"10.0.{i // 250}.{i % 250}") for i in range(2000)]
    got = surrogates.replace_personal_data(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    new = {row.text for row in got}
    assert len(new) == 2000 and not new & {text for _, text in data}


def replaced(spark, texts, schema="doc_id bigint, text string"):
    table = spark.createDataFrame(list(enumerate(texts)), schema)
    return {r.doc_id: r.text for r in surrogates.replace_personal_data(table).collect()}


def test_secrets_of_any_script_are_replaced(spark):
    secrets = ["********", "päßwörter-ÄÖÜ", "пароль-Пароль", "秘密の言葉です山田", "κωδικός123", "....----", "12345678", "•••••••••", "𝔭𝔞𝔰𝔰𝔴𝔬𝔯𝔡"]
    got = replaced(spark, [f'password = "{secret}" end' for secret in secrets])
    for key, secret in enumerate(secrets):
        new = re.fullmatch('password = "([^"]+)" end', got[key])[1]
        assert new != secret and secret not in got[key]
    assert all("а" <= c.lower() <= "я" or c in surrogates.SYMBOLS for c in re.search('"(.*)"', got[2])[1])
    assert len(set(got.values())) == len(secrets)


def test_draws_end_when_a_form_is_full(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYMBOLS", "!?")
    monkeypatch.setattr(surrogates, "DRAWS", 3)
    # 256 values of eight signs of two kinds, all of them in use.
    full = ["".join("!?"[n >> bit & 1] for bit in range(8)) for n in range(256)]
    got = replaced(spark, [f'token="{secret}"' for secret in full])
    assert len(set(got.values())) == 256 and not set(got.values()) & {f'token="{secret}"' for secret in full}


def test_names_follow_their_words(spark):
    texts = [
        "Mrs Anna Bell came. Mrs Bell left; Mr Bell and Mr John Bell stayed.",
        "Mrs Anna Doe; Mr. John Doe; Frau Anna Bell",
        "г-жа Анна Белова, г-н Иван Белов, г-жа Белова",
    ]
    got = replaced(spark, texts)
    first = re.fullmatch(r"Mrs (\w+) (\w+) came. Mrs (\w+) left; Mr (\w+) and Mr (\w+) (\w+) stayed.", got[0]).groups()
    second = re.fullmatch(r"Mrs (\w+) (\w+); Mr. (\w+) (\w+); Frau (\w+) (\w+)", got[1]).groups()
    third = re.fullmatch(r"г-жа (\w+) (\w+), г-н (\w+) (\w+), г-жа (\w+)", got[2]).groups()
    bell, doe = first[1], second[1]
    assert {first[2], first[3], first[5], second[5]} == {bell} and second[3] == doe != bell
    assert first[0] == second[0] == second[4] and first[4] == second[2] != first[0]
    assert third[1] == third[4] and third[1].endswith("ова") and third[3].endswith("ов") and third[0] != third[2]
    many = [f"Mr {''.join(chr(97 + (i // 26**k) % 26) for k in range(4)).capitalize()}" for i in range(9000)]
    names = replaced(spark, many)
    assert len(set(names.values())) == 9000 and not set(names.values()) & set(many)


def test_mentions_keep_their_form(spark):
    texts = ["+1 (279) 555-0216", "+1 279 555 0216", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "4532 0151 1283 0366", "4532015112830366"]
    got = replaced(spark, texts)
    digits = {key: re.sub("[^0-9A-Z]", "", text) for key, text in got.items()}
    assert digits[0] == digits[1] and digits[2] == digits[3] and digits[4] == digits[5]
    assert all(re.sub(r"\d", "0", got[key]) == re.sub(r"\d", "0", text) and got[key] != text for key, text in enumerate(texts))


def test_columns_of_the_caller_stay(spark):
    rows = [(1, "mail bob@x.org", "a", "b", "c", "d"), (2, "nothing", "e", "f", "g", "h"), (2, None, "e", "f", "g", "h")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, one string, Two string, found string, entity string")
    got = surrogates.replace_personal_data(table).collect()
    assert sorted(tuple(r)[2:6] for r in got) == sorted(row[2:] for row in rows)
    assert got[0].__fields__ == ["doc_id", "text", "one", "Two", "found", "entity", "n_entities", "entities"]


def test_spot_fingerprints(docs, texts):
    got = {row.doc_id: row for row in spots.fingerprint_edits(docs).collect()}
    order = sorted(texts, reverse=True)
    for at, key in enumerate(order):
        text, after = texts[key], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[key].n_chars == len(text) and 0 <= got[key].near_edited <= 1
    by_text = {}
    for key, text in texts.items():
        assert by_text.setdefault(text, got[key].fingerprint) == got[key].fingerprint


def test_spots_odd_rows(spark, odd):
    got = spots.fingerprint_edits(odd).collect()
    assert len(got) == 10 and {r.fingerprint for r in got if r.doc_id in (1, 2)} == {""}
    chains = spark.createDataFrame([("The cat is of a sat mat",)], "t string").select(F.size(spots.spots(F.col("t"))))
    assert chains.first()[0] == 4
    near = {r.doc_id: r.component_id for r in spots.near_documents(odd).collect()}
    assert near[4] == 3 and near[5] == 5 and near[1] == 1


def test_spot_components(spark, docs):
    rng = random.Random(3)
    data = [(None, "no key"), (900, ""), (901, None)]
    for group in range(12):
        words = [f"g{group}x{i}" for i in range(60)]
        for copy in range(6):
            line = list(words)
            for at in rng.sample(range(60), copy):
                line[at] = f"c{copy}y{at}"
            data.append((group * 10 + copy, " the ".join(line)))
    data += [(3, "the other text of a repeated key"), (500, data[5][1])]
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    sets = [set(row[0]) for row in table.select(spots.spots(F.coalesce("text", F.lit("")))).collect()]
    root = {at: key for at, (key, _) in enumerate(data) if key is not None}
    same = [
        (a, b) for a in root for b in root
        if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    for _ in data:
        for a, b in same:
            root[a] = min(root[a], root[b])
    want = Counter((key, len(sets[at]), root.get(at)) for at, (key, _) in enumerate(data))
    assert len(same) > 50 and any(root[a] != data[a][0] for a in root)
    assert Counter(map(tuple, spots.near_documents(table).collect())) == want
    whole = spots.spot_signatures(table).select("doc_id", F.length("fingerprint") / 8, "component_id").collect()
    assert Counter(map(tuple, whole)) == want
    got = queries.op4_spot_signatures(spark, FOLDER)
    assert got.filter("component_id is null or component_id > doc_id").count() == 0 and got.count() == docs.count()


def test_toxic_segments_in_one_scan():
    rng = random.Random(1)
    for _ in range(200):
        line = [rng.choice([-0.5, -0.5, 1.0, 0.3]) for _ in range(30)]
        at = [i for i, x in enumerate(line) if x > 0]
        got = toxicity.maximal_segments(at, [line[i] for i in at], -0.5)
        best = max((sum(line[a : b + 1]) for a in range(30) for b in range(a, 30)), default=0)
        assert math.isclose(max((s for *_, s in got), default=0), max(best, 0), abs_tol=1e-9)
        assert all(math.isclose(sum(line[a : b + 1]), s, abs_tol=1e-9) for a, b, s in got)
        assert all(got[i][1] < got[i + 1][0] for i in range(len(got) - 1))


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    data, marks = [], []
    for key in range(600):
        text = rng.choices(words, k=80)
        if key % 5 == 0:
            for place in rng.sample(range(80), 6):
                text[place] = rng.choice(["vile", "nasty", "rotten"])
        data.append((key, " ".join(text)))
        marks.append((key, int(key % 5 == 0)))
    docs = spark.createDataFrame([*data, (1000, None), (None, "vile")], "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 602
    held = [row for row in got if row.held_out]
    assert held and all(zlib.crc32(str(row.doc_id).encode()) % 4 == 2 for row in held)
    assert all(row.predicted == int(row.doc_id % 5 == 0) for row in held if row.doc_id < 1000)
    assert all(0 <= row.score <= 1 for row in got)


def test_mixing_meets_targets(docs, odd):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size, taken, target = Counter(), Counter(), {}
    for row in got:
        assert 0 <= row.taken <= 2 * row.size
        size[row.source] += row.size
        taken[row.source] += row.taken
        target[row.source] = row.target
    weight = {name: (3, 1, 2)[at % 3] for at, name in enumerate(sorted(size))}
    want, free, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[name] for name in free)
        full = [name for name in free if level * weight[name] > 2 * size[name]]
        if not full:
            break
        for name in full:
            want[name] = 2 * size[name]
            left -= want[name]
            free.discard(name)
    want |= {name: level * weight[name] for name in free}
    for name in size:
        assert math.isclose(want[name], target[name], rel_tol=1e-9)
        assert abs(taken[name] - target[name]) <= 64
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.size == 0)


def test_packing_round_trip(docs, texts, odd):
    pieces = packing.pack_documents(docs).toPandas()
    filled = pieces.groupby("sequence_id").length.sum()
    assert filled.max() <= 1024 and pieces.length.sum() / (1024 * len(filled)) > 0.95
    line = pieces.sort_values(["sequence_id", "offset"])
    assert (line.groupby("sequence_id").length.cumsum() - line.length == line.offset).all()
    for key, part in pieces.groupby("doc_id"):
        ids = np.array([*TOKENIZER.encode(texts[key], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for row in part.sort_values("start").itertuples():
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes())
            at += row.length
        assert at == len(ids)
    assert packing.pack_documents(odd).filter("start = 0").count() == 10
    assert all(sum(packing.cut_lengths(n, 1024, 0.02)) == n for n in range(1, 5000))


def test_licence_scan(spark, docs, texts, odd):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for row in licences.scan_licences(docs).collect():
        words = word.findall(texts[row.doc_id].translate(LOW))
        found = [
            (at, label)
            for phrase, label in licences.PHRASES
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        ]
        assert (row.n_words, row.n_base) == (len(words), len(found))
        assert row.base_labels == ",".join(sorted({label for _, label in found}))
        assert row.first_word == min((at for at, _ in found), default=None)
        assert row.last_word == max((at for at, _ in found), default=None)
    text = "x y " + licences.TEMPLATES[5][1].replace("with or without", "with or possibly without") + " z"
    got = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got.labels == "bsd" and got.spans[0].first_word == 2 and got.spans[0].score > 0.6
    assert licences.scan_licences(odd).count() == 10


def test_class_model(docs, texts, odd):
    words = {key: [*re.findall("[^\x20\x09-\x0d]+", text.translate(LOW)), None] for key, text in texts.items()}
    held = {key: zlib.crc32(str(key).encode()) % 5 == 1 for key in texts}
    counts = Counter(word for key in words if not held[key] for word in words[key])
    total, kinds = sum(counts.values()), len(counts)
    got = {row.doc_id: row for row in class_model.score_texts(docs, classes=16, parts=500, known_parts=2000, rounds=2).collect()}
    for key, row in got.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words[key])
        assert math.isclose(base, row.base_score, rel_tol=1e-9)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[key], len(words[key]), total)
        assert row.n_known == sum(counts[w] > 0 for w in words[key])
    tested = [row for row in got.values() if row.held_out]
    assert sum(row.score for row in tested) > sum(row.base_score for row in tested)
    assert class_model.score_texts(odd, classes=3, rounds=1).count() == 10


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + rng.normal(size=12) * 0.15).tolist(), i % 2) for i in range(400)]
    rows += [(400, rows[0][1], 0), (401, None, 0), (402, [0.0] * 12, 0), (403, [float("nan")] * 12, 0)]
    rows += [(404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [None] * 12, 0), (407, [], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table, 0.93).collect()}
    single = {r.vec_id: r.embedding for r in table.collect()}
    good = {key: np.array(single[key], float) for key, _, label in rows if key <= 400}
    label = {key: mark for key, _, mark in rows}
    links = {key: {o for o in good if o != key and label[o] == label[key] and good[key] @ good[o] / math.sqrt((good[key] @ good[key]) * (good[o] @ good[o])) >= 0.93} for key in good}
    root = {key: key for key in good}
    while True:
        new = {key: min([root[key], *(root[o] for o in links[key])]) for key in good}
        if new == root:
            break
        root = new
    for key in good:
        assert got[key] == (len(links[key]), root[key], root[key] == key)
    for key in range(401, 408):
        assert got[key] == (0, key, True)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    vector = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    for made in (
        ngram_join.similar_documents(none),
        edit_counts.count_tokens(none),
        surrogates.replace_personal_data(none),
        spots.fingerprint_edits(none),
        toxicity.score_toxicity(none, labels),
        mixing.mix_sources(none),
        packing.pack_documents(none),
        licences.scan_licences(none),
        class_model.score_texts(none, classes=3, rounds=1),
        vectors.near_vectors(vector),
    ):
        assert made.count() == 0


def test_pages_of_shared_blocks(spark):
    rng = random.Random(8)
    block = lambda name, size: [f"{name}x{i}" for i in range(size)]
    pool = [block(f"p{i}", 30) for i in range(8)]
    data = [
        (key, " ".join([*block("common", 40), *sum(rng.sample(pool, 3), []), *block(f"own{key}", rng.randint(0, 4))]))
        for key in range(80)
    ]
    data += [(100 + key, text + " end") for key, text in data[:10]]
    sets = {key: shingles(text, 5) for key, text in data}
    want = linked(sets, 80)
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar_documents(table).collect()} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_signatures_meet_for_every_linked_pair(percent):
    rng = np.random.default_rng(percent)
    universe = np.sort(rng.integers(0, 1 << 64, 400, dtype=np.uint64))
    order = dict(zip(universe.tolist(), rng.integers(2, 60, 400).tolist(), strict=True))
    met = 0
    for _ in range(400):
        size = int(rng.integers(1, 120))
        one = set(rng.choice(universe, size, replace=False).tolist())
        two = set(one)
        for value in rng.choice(sorted(one), int(rng.integers(0, max(1, size // 3))), replace=False).tolist():
            two.discard(value)
            if rng.random() < 0.5:
                two.add(int(rng.choice(universe)))
        common = len(one & two)
        if one == two or 100 * common < percent * len(one | two):
            continue
        met += 1
        signatures = []
        for part in (one, two):
            whole = np.array(sorted(part), np.uint64)
            half = int(np.searchsorted(whole, ngram_join.HALF))
            known = sorted((order[int(x)], int(x)) for x in whole[:half])
            found = ngram_join.prefix_signatures(
                len(whole), half, np.array([df for df, _ in known], np.int64),
                np.array([x for _, x in known], np.uint64), whole[half:], percent,
            )
            signatures.append(set(found.tolist()))
        assert signatures[0] & signatures[1]
    assert met > 30


def test_lines_of_tokens():
    texts = ["", "One two  ÉCOLE naïve", " \t", "日本語の x", "end"]
    tokens = class_model.Lines([text.encode() for text in texts])
    words, endings, owner = tokens.words, tokens.endings(np.arange(len(tokens.words))), tokens.owner
    led = class_model.Lines([text.encode() for text in texts], lead=True)
    assert led.words[0] == class_model.END and (led.words[1:] == words).all()
    plain = [[*text.translate(LOW).split(), None] for text in texts]
    assert owner.tolist() == [at for at, line in enumerate(plain) for _ in line]
    flat = [word for line in plain for word in line]
    code = lambda word: int(class_model.Lines([word.encode()]).words[0]) if word else class_model.END
    assert words.tolist() == [code(word) for word in flat]
    assert endings.tolist() == [code(word[-3:]) if word else class_model.END for word in flat]


def test_exchange_steps_raise_the_likelihood():
    rng = np.random.default_rng(3)
    units, count = 30, 5
    pairs = rng.poisson(1.0, (units, units)).astype(float)
    classes = rng.integers(0, count, units)

    def likelihood(of):
        hot = np.eye(count)[of]
        matrix = hot.T @ pairs @ hot
        f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return f(matrix) - f(matrix.sum(0)) - f(matrix.sum(1))

    for unit in range(units):
        hot = np.eye(count)[classes]
        matrix = hot.T @ pairs @ hot
        into, out = (pairs.T @ hot)[[unit]], (pairs @ hot)[[unit]]
        new = class_model.best_moves(np.array([unit]), into, out, np.diag(pairs)[[unit]], classes, matrix)[0]
        tried = []
        for c in range(count):
            moved = classes.copy()
            moved[unit] = c
            tried.append(likelihood(moved))
        assert tried[new] >= max(tried) - 1e-6
        classes[unit] = new


def test_class_scores_follow_the_classes(spark, docs, texts):
    # One class leaves the unigram model.
    for row in class_model.score_texts(docs, classes=1).collect():
        assert math.isclose(row.score, row.base_score, rel_tol=1e-9)
    # Words that alternate get classes of their own, seen or not in the held-out fold.
    rng = random.Random(4)
    sides = [[f"{side}{i}{side}" for i in range(40)] for side in ("red", "blue")]
    data = [(key, " ".join(rng.choice(sides[at % 2]) for at in range(60))) for key in range(200)]
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    for parts in (4_000, 12):  # 12: no word is frequent enough, only endings and later steps
        got = class_model.score_texts(table, classes=3, parts=parts).collect()
        held = [row for row in got if row.held_out]
        assert held and all(row.score > row.base_score + 10 for row in held)


def test_known_words_leave_the_class_of_their_ending(spark):
    rng = random.Random(5)
    one, two = [f"a{i}xyz" for i in range(30)], [f"b{i}xyz" for i in range(30)]
    # Two frequent words tell the sides apart; the others share their ending.
    draw = lambda at: ("left", "right")[at % 2] if rng.random() < 0.4 else rng.choice((one, two)[at % 2])
    data = [(key, " ".join(draw(at) for at in range(80))) for key in range(300)]
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    options = {"classes": 4, "parts": 10, "known_parts": 100_000}
    score = lambda **more: sum(r.score for r in class_model.score_texts(table, **options, **more).collect() if r.held_out)
    assert score(refinements=1) > score(refinements=0) + 100


def plain_chains(text):
    words = re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", text.lower()).split(" ")
    words = [word for word in words if word]
    common, out = set(spots.ANCHORS), set()
    for at, word in enumerate(words):
        after = [w for w in words[at + 1 : at + 200] if w not in common][:2]
        if word in common and len(after) == 2:
            out.add((word, *after))
    if not out:
        out = {tuple(words[at : at + 2]) for at in range(len(words))}
    return out or ({text} if text else set())


def test_spot_likeness_follows_plain_chains(docs, texts):
    got = {row.doc_id: row for row in spots.fingerprint_edits(docs).collect()}
    order = sorted(texts, reverse=True)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for at, key in enumerate(order):
        text, after = texts[key], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        own, edited = plain_chains(text), plain_chains(text[: len(text) - half] + after[:half])
        assert len(got[key].fingerprint) == 8 * len(own)
        assert math.isclose(got[key].near_edited, alike(own, edited), abs_tol=1e-9)
        assert math.isclose(got[key].near_next, alike(own, plain_chains(after)), abs_tol=1e-9)


def test_surrogates_hash_an_identity_once_a_draw(spark, monkeypatch):
    """The stream of a draw is a column, not written out wherever a character is drawn from it."""
    plans, kept = [], surrogates.materialize

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    monkeypatch.setattr(surrogates, "materialize", watched)
    data = [(1, "write to anna@web.de or Mrs Smith, 4111 1111 1111 1111"), (2, 'token = "abcdef0123456789"'), (3, None)]
    got = surrogates.replace_personal_data(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert sorted(r.n_entities for r in got) == [0, 1, 3]
    assert max(plan.count("sha2(") for plan in plans) == 1


def test_surrogates_search_all_texts_once(spark):
    """Texts without mentions are told by a map of the others, not by a second search."""
    data = [(1, "write to anna@web.de"), (1, "write to anna@web.de"), (None, "Mrs Smith, anna@web.de"), (2, "plain"), (2, "plain"), (None, ""), (3, None)]
    data += [(key, f"word {key}") for key in range(10, 200)]
    got = surrogates.replace_personal_data(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(((r.n_entities, r.doc_id or 0, r.text or "") for r in got.collect()), reverse=True)
    assert [r[:2] for r in found[:3]] == [(2, 0), (1, 1), (1, 1)] and found[1] == found[2] and "anna" not in found[0][2] + found[1][2]
    assert sorted(r[1:] for r in found[3:]) == sorted((key or 0, text or "") for key, text in data[3:])
