import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpuslab.operators import duplicates as dup
from corpuslab.operators import lookup

DOCS = "doc_id bigint, text string"


def brute_ranges(texts, length, unit):
    """Ranges covered by windows that occur twice, by plain counting."""
    coded = [(t or "").encode() if unit == "bytes" else (t or "") for t in texts]
    seen = Counter(c[i : i + length] for c in coded for i in range(len(c) - length + 1))
    found = set()
    for doc, c in enumerate(coded):
        merged = []
        for i in range(len(c) - length + 1):
            if seen[c[i : i + length]] > 1:
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = i + length
                else:
                    merged.append([i, i + length])
        found |= {(doc, s, e) for s, e in merged}
    return found


@pytest.mark.parametrize("length,unit", [(1, "bytes"), (3, "bytes"), (4, "chars"), (9, "chars")])
def test_ranges_match_brute_force(spark, length, unit):
    rng = random.Random(length)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    texts += ["", None, "ab" * 20, "ab" * 20, "aé" * 15, "b" * length]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {tuple(r) for r in dup.duplicate_ranges(df, length, unit).collect()}
    assert got == brute_ranges(texts, length, unit)


def test_long_texts_are_cut_into_blocks_without_losing_windows(spark, monkeypatch):
    rng = random.Random(5)
    common = "".join(rng.choice("abcd") for _ in range(300_000))
    texts = ["x" + common, "yy" + common + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = rows(dup.duplicate_ranges(df, 50))
    assert got == [(0, 1, 300_001), (1, 2, 300_002)]


def test_annotation_covers_all_documents(spark):
    texts = ["é" * 30, "é" * 30, "short", "", "x" * 10 + "é" * 26 + "tail"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: r for r in dup.annotate_duplicates(df, 50, ratio_unit="chars").collect()}
    assert got[0]["dup_ratio"] == 2.0 and got[0]["dup_pct"] == 200
    assert got[2]["dup_ratio"] == 0.0 and got[2]["pairs"] == [] and got[3]["dup_ratio"] == 0.0
    assert [tuple(p) for p in got[4]["pairs"]] == [(10, 62)]
    assert bytes(got[4]["repetitions"][0]).decode() == "é" * 26
    same = {r["doc_id"]: r for r in dup.annotate_duplicates(df, 50).collect()}
    assert same[0]["dup_ratio"] == 1.0


def test_trimming_that_empties_a_range_fails(spark):
    df = spark.createDataFrame([(0, "a" * 8), (1, "a" * 8)], DOCS)
    ranges = dup.duplicate_ranges(df, 8)
    assert {bytes(r["repetition"]) for r in dup.range_bytes(df, ranges, trim=1).collect()} == {b"a" * 6}
    with pytest.raises(Exception, match="empties"):
        dup.range_bytes(df, ranges, trim=4).collect()


def test_repetitions_members_and_clusters(spark):
    block, other = "q" * 3 + "uvwxyz" * 2, "0123456789abcde"
    texts = [f"1{block}2", f"3{block}4", f"5{block}6{other}7", f"8{other}9"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    contents = dup.range_bytes(df, dup.duplicate_ranges(df, 12))
    table = rows(dup.repetitions_table(contents).select("num_docs", "num_ranges", "num_bytes"))
    assert table == [(2, 2, 15), (3, 3, 15)]
    members = dup.memberships(contents)
    chunks = dup.clusters_by_repetition(members, max_ids=2)
    listed = sorted(i for r in chunks.collect() for i in r["ids"])
    assert listed == [0, 1, 2, 2, 3]
    assert sorted(tuple(r["ids"]) for r in dup.clusters_by_repetition(members).collect()) == [(0, 1, 2), (2, 3)]
    chosen = spark.createDataFrame([(3,)], "doc_id bigint")
    assert rows(dup.document_clusters(members, chosen)) == [(3, 2), (3, 3)]
    texts_of = dup.repetition_text(contents, dup.repetitions_table(contents))
    assert {bytes(r["repetition"]).decode() for r in texts_of.collect()} == {block, other}
    summary = dup.dedup_summary(dup.duplicate_ranges(df, 12), contents).first()
    assert tuple(summary) == (4, 3, 5, 2)


def test_two_tier_filter(spark):
    data = [
        (1, True, 0.0, None), (2, True, 0.5, False), (3, False, 0.0, False),
        (4, False, 0.0, True), (5, None, None, None), (6, True, None, False),
    ]
    df = spark.createDataFrame(data, "doc_id bigint, included_in_dedup boolean, dup_ratio double, has_dup boolean")
    assert [r["doc_id"] for r in dup.dedup_filter(df).orderBy("doc_id").collect()] == [1, 3, 5]


def test_near_duplicates_only(spark):
    data = [(1, True, 0.0, [1, 2]), (2, True, 0.5, [1, 2]), (3, False, 0.0, []), (4, True, 0.0, [4, 5, 6])]
    df = spark.createDataFrame(data, "doc_id bigint, near_dup boolean, dup_ratio double, near_dup_cluster array<bigint>")
    assert [r["doc_id"] for r in dup.near_only(df).orderBy("doc_id").collect()] == [1, 4]
    assert dup.near_cluster_size(df).first()[0] == 5


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray("a ➝ b".encode()),), (bytearray(b"\xe2\x9e"),)], "r binary")
    got = df.select(
        dup.decode_repetition("r").alias("u"), dup.decode_repetition("r", "latin-1").alias("l")
    ).collect()
    assert got[0]["u"] == "a ➝ b" and got[0]["l"] == "a â\x9e\x9d b"
    assert "�" in got[1]["u"]


def test_lookup_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    index = [" ".join(word() for _ in range(30)) for _ in range(3)]
    texts = [" ".join(word() for _ in range(20)) for _ in range(10)]
    texts += [texts[0][:5] + " " + index[1][3:40] + " end", "", "tiny"]
    for stride in (1, 2):
        want = set()
        for doc, text in enumerate(texts):
            breaks = [-1] + [i for i, c in enumerate(text) if c == " "]
            for i in breaks[::stride]:
                if i + 9 < len(text) and any(text[i + 1 : i + 9] in other for other in index):
                    want.add((doc, i + 1))
        got = lookup.matched_queries(
            spark.createDataFrame(list(enumerate(texts)), DOCS),
            spark.createDataFrame(list(enumerate(index)), DOCS),
            8,
            stride,
        )
        assert {tuple(r) for r in got.collect()} == want and want


def test_occurrences_overlap(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "xaay"), (3, "nothing")], DOCS)
    queries = spark.createDataFrame([("aa",), ("aay",), ("zz",), ("",)], "query string")
    got = rows(lookup.count_occurrences(df, queries))
    assert got == [("aa", 4, 2), ("aay", 1, 1), ("zz", 0, 0)]
    assert rows(lookup.count_occurrences(df, queries, unit="bytes")) == got


def test_occurrences_of_all_lengths(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab😀") for _ in range(90)) for _ in range(6)] + ["", "a"]
    parts = {t[at : at + n] for t in texts for n in (1, 2, 3, 5, 8, 13, 31, 32, 33, 70) for at in (0, 7) if t[at : at + n]}
    parts |= {part[:-1] + "c" for part in parts} | {"a" * 16 + texts[0][20:30]}
    want = []
    for part in parts:
        here = [sum(t.startswith(part, at) for at in range(len(t))) for t in texts]
        want.append((part, sum(here), sum(n > 0 for n in here)))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    queries = spark.createDataFrame([(part,) for part in parts], "query string")
    assert sorted(map(tuple, lookup.count_occurrences(df, queries).collect())) == sorted(want)


def test_plain_windows(spark):
    from corpuslab.operators.windows import windows

    df = spark.createDataFrame([(1, "aéb"), (2, "a")], DOCS)
    assert [bytes(r["window"]) for r in windows(df, 2).orderBy("pos").collect()] == [b"a\xc3", b"\xc3\xa9", b"\xa9b"]
    chars = windows(df, 2, "chars").select(F.decode("window", "UTF-32").alias("w"))
    assert sorted(r["w"] for r in chars.collect()) == ["aé", "éb"]


def test_chance_repeats_of_anchors_open_no_windows(spark, monkeypatch):
    """Windows of runs that differ are compared in the bucket of their anchor; only crowded anchors make rows of them."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(40)] + ["x" * 80, "x" * 70 + "é" * 30, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for length, unit in ((20, "bytes"), (17, "chars")):
        want = brute_ranges(texts, length, unit)
        with monkeypatch.context() as patched:
            patched.setattr(dup, "CROWD", 3)
            assert {tuple(r) for r in dup.duplicate_ranges(df, length, unit).collect()} == want
        with monkeypatch.context() as patched:
            patched.setattr(dup, "windows_of_runs", None)
            assert {tuple(r) for r in dup.duplicate_ranges(df, length, unit).collect()} == want


def test_runs_of_lone_anchors_are_not_sent(spark):
    """Only runs whose anchor may occur several times go to a bucket, as one row for many runs."""
    from corpuslab.operators import windows

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)) for _ in range(20)]
    texts += [texts[0][100:400] + "é" + texts[1][:200], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    repeated = windows.repeated_anchors(windows.run_anchors(df, 50), dup.CROWD)
    sent = windows.run_units(df, 50, repeated).select(F.size("keys").alias("runs"), "bucket")
    runs, rows_sent, buckets = sent.agg(F.sum("runs"), F.count("*"), F.count_distinct("bucket")).first()
    assert 20 < runs < 200 and rows_sent == buckets
    assert {tuple(r) for r in dup.duplicate_ranges(df, 50).collect()} == brute_ranges(texts, 50, "bytes")
