"""Duplicate substrings, clusters, lookups and the filters on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.hashing import unit_interval
from corpuslab.operators import duplicates as dup
from corpuslab.operators import lookup, near
from corpuslab.operators.profile import in_ratio
from corpuslab.plans.registry import query, table
from corpuslab.session import materialize

LENGTH = 50

# Every window of 50 bytes, found by brute force on the hexadecimal form. Texts
# are taken in blocks so that a substring is not counted from the far start.
WINDOWS_SQL = """
texts AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM {docs}),
blocks AS (SELECT doc_id, n, x, unnest(range(0, n, 1000)) AS b FROM texts),
pieces AS (SELECT doc_id, b, substr(x, (2 * b + 1)::BIGINT, 2 * 1049) AS piece FROM blocks),
places AS (SELECT doc_id, b, piece, unnest(range(0, least(1000, length(piece) // 2 - 49))) AS o
           FROM pieces WHERE length(piece) >= 100),
windows AS (SELECT doc_id, b + o AS pos, md5(substr(piece, 2 * o + 1, 100)) AS w FROM places),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
flagged AS (SELECT doc_id, pos,
              CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS opens
            FROM windows WHERE w IN (SELECT w FROM repeated)),
islands AS (SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM flagged),
ranges AS (SELECT doc_id, min(pos)::BIGINT AS s, (max(pos) + 50)::BIGINT AS e FROM islands GROUP BY doc_id, island)
"""
RANGES_SQL = "WITH " + WINDOWS_SQL.format(docs="documents")
CONTENTS_SQL = RANGES_SQL + """,
contents AS (SELECT r.doc_id, r.e - r.s AS num_bytes,
               sha256(unhex(substr(t.x, (2 * r.s + 1)::BIGINT, (2 * (r.e - r.s))::BIGINT))) AS repetition_id
             FROM ranges r JOIN texts t USING (doc_id))
"""
LENGTHS_SQL = RANGES_SQL + """,
lengths AS (SELECT doc_id, sum(e - s)::BIGINT AS dup_len, count(*)::BIGINT AS num_ranges FROM ranges GROUP BY doc_id),
annotated AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(l.num_ranges, 0)::BIGINT AS num_ranges,
         coalesce(l.dup_len, 0)::BIGINT AS dup_len, length(d.text)::BIGINT AS text_length,
         coalesce(l.dup_len, 0)::DOUBLE / t.n AS dup_ratio,
         coalesce(l.dup_len, 0)::DOUBLE / length(d.text) AS mixed_ratio
  FROM documents d JOIN texts t USING (doc_id) LEFT JOIN lengths l USING (doc_id))
"""


def _contents(spark, folder):
    docs = table(spark, folder, "documents")
    return dup.range_bytes(docs, dup.duplicate_ranges(docs, LENGTH))


@query(RANGES_SQL + "SELECT doc_id, s AS range_start, e AS range_end FROM ranges")
def dup_ranges(spark, folder):
    """Maximal ranges covered by windows of 50 bytes that occur at least twice."""
    docs = table(spark, folder, "documents")
    return dup.duplicate_ranges(docs, LENGTH).select(
        "doc_id", F.col("start").alias("range_start"), F.col("end").alias("range_end")
    )


@query(
    LENGTHS_SQL
    + """SELECT doc_id, num_ranges, dup_len, text_length, round(dup_ratio, 9) AS dup_ratio,
    floor(100.0 * dup_ratio)::BIGINT AS dup_pct, true AS included_in_dedup FROM annotated"""
)
def dup_info(spark, folder):
    """All documents with their duplicate columns."""
    docs = table(spark, folder, "documents")
    return dup.annotate_duplicates(docs, LENGTH).select(
        "doc_id",
        F.size("pairs").cast("bigint").alias("num_ranges"),
        "dup_len",
        "text_length",
        F.round("dup_ratio", 9).alias("dup_ratio"),
        "dup_pct",
        "included_in_dedup",
    )


@query(LENGTHS_SQL + "SELECT doc_id, round(mixed_ratio, 9) AS dup_ratio FROM annotated WHERE mixed_ratio > 1")
def dup_ratio_above_one(spark, folder):
    """Duplicated bytes over characters, the mixed ratio that may exceed 1."""
    docs = table(spark, folder, "documents")
    marked = dup.annotate_duplicates(docs, LENGTH, ratio_unit="chars")
    return dup.dup_subset(marked, "above_one").select("doc_id", F.round("dup_ratio", 9).alias("dup_ratio"))


@query(
    CONTENTS_SQL
    + """SELECT repetition_id, num_bytes, count(DISTINCT doc_id)::BIGINT AS num_docs,
    count(*)::BIGINT AS num_ranges FROM contents GROUP BY repetition_id, num_bytes"""
)
def repetitions(spark, folder):
    """Every distinct range content, in how many documents and ranges."""
    return dup.repetitions_table(_contents(spark, folder)).select(
        "repetition_id", F.col("num_bytes").cast("bigint").alias("num_bytes"), "num_docs", "num_ranges"
    )


@query(
    CONTENTS_SQL
    + """, best AS (SELECT repetition_id, count(DISTINCT doc_id)::BIGINT AS num_docs FROM contents
      GROUP BY repetition_id ORDER BY num_docs DESC, repetition_id LIMIT 100)
    SELECT DISTINCT b.repetition_id, b.num_docs, c.doc_id, d.lang, d.n_chars
    FROM best b JOIN contents c USING (repetition_id) JOIN documents d USING (doc_id)"""
)
def repetition_members(spark, folder):
    """The hundred most widespread repetitions with the documents behind them."""
    docs = table(spark, folder, "documents")
    contents = materialize(_contents(spark, folder))
    top = materialize(dup.repetitions_table(contents).orderBy(F.desc("num_docs"), "repetition_id").limit(100))
    found = dup.cluster_members(dup.memberships(contents), top, docs.select("doc_id", "lang", "n_chars"))
    return found.join(top.select("repetition_id", "num_docs"), "repetition_id").select(
        "repetition_id", "num_docs", "doc_id", "lang", "n_chars"
    )


@query(
    CONTENTS_SQL
    + """SELECT repetition_id, count(*) OVER (PARTITION BY repetition_id)::BIGINT AS num_docs, doc_id
    FROM (SELECT DISTINCT repetition_id, doc_id FROM contents)"""
)
def clusters(spark, folder):
    """Document ids per repetition, gathered in chunks of about eight and read back."""
    grouped = dup.clusters_by_repetition(dup.memberships(_contents(spark, folder)), max_ids=8)
    return grouped.select("repetition_id", "num_docs", F.explode("ids").alias("doc_id"))


@query(
    CONTENTS_SQL
    + """, texts_of AS (SELECT DISTINCT substr(t.x, (2 * r.s + 1)::BIGINT, (2 * (r.e - r.s))::BIGINT) AS content
      FROM ranges r JOIN texts t USING (doc_id))
    SELECT sha256(unhex(content)) AS repetition_id, content, (length(content) // 2)::BIGINT AS latin_length FROM texts_of"""
)
def repetition_contents(spark, folder):
    """Every repetition with its bytes, and its length read as single-byte characters."""
    contents = materialize(_contents(spark, folder))
    found = dup.repetition_text(contents, dup.repetitions_table(contents))
    return found.select(
        "repetition_id",
        F.hex("repetition").alias("content"),
        F.length(dup.decode_repetition("repetition", "latin-1")).cast("bigint").alias("latin_length"),
    )


@query(
    CONTENTS_SQL
    + """, members AS (SELECT DISTINCT repetition_id, doc_id FROM contents)
    SELECT DISTINCT a.doc_id, b.doc_id AS member FROM members a JOIN members b USING (repetition_id) WHERE a.doc_id % 100 = 0"""
)
def clusters_of_documents(spark, folder):
    """The cluster of every hundredth document: all that share one of its repetitions."""
    members = materialize(dup.memberships(_contents(spark, folder)))
    chosen = table(spark, folder, "documents").filter("doc_id % 100 = 0")
    return dup.document_clusters(members, chosen)


@query(
    CONTENTS_SQL
    + """SELECT count(*)::BIGINT AS docs_with_dups, count(*) FILTER (n = 1)::BIGINT AS singleton_docs,
    sum(n)::BIGINT AS num_ranges, (SELECT count(DISTINCT repetition_id) FROM contents)::BIGINT AS num_repetitions
    FROM (SELECT doc_id, count(*) AS n FROM ranges GROUP BY doc_id)"""
)
def dedup_summary(spark, folder):
    docs = table(spark, folder, "documents")
    ranges = materialize(dup.duplicate_ranges(docs, LENGTH))
    return dup.dedup_summary(ranges, dup.range_bytes(docs, ranges))


@query(RANGES_SQL + "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ranges)")
def dedup_clean(spark, folder):
    """Documents without any repetition."""
    docs = table(spark, folder, "documents")
    kept = dup.drop_with_repetitions(docs, dup.duplicate_ranges(docs, LENGTH))
    return kept.select("doc_id", "lang", "source", "n_chars")


@query(
    LENGTHS_SQL
    + """SELECT source, count(*) FILTER (dup_ratio > 0)::BIGINT AS dup_docs,
    count(*) FILTER (dup_ratio = 0)::BIGINT AS clean_docs, round(avg(dup_ratio), 9) AS mean_dup_ratio
    FROM annotated GROUP BY source"""
)
def dup_by_source(spark, folder):
    docs = table(spark, folder, "documents")
    return dup.dup_by_group(dup.annotate_duplicates(docs, LENGTH), "source").withColumn(
        "mean_dup_ratio", F.round("mean_dup_ratio", 9)
    )


@query(
    LENGTHS_SQL
    + """SELECT lang, round(100.0 * count(*) FILTER (dup_ratio = 0) / count(*), 6) AS clean_share
    FROM annotated GROUP BY lang"""
)
def clean_share(spark, folder):
    docs = table(spark, folder, "documents")
    return in_ratio(dup.annotate_duplicates(docs, LENGTH), F.col("dup_ratio") == 0, ["lang"]).select(
        "lang", F.round("in_ratio", 6).alias("clean_share")
    )


# Query windows: 100 characters from the start and after each whitespace.
QUERY_SQL = """
chars AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS ix, len(c) AS n
          FROM (SELECT doc_id, string_split(text, '') AS c FROM {docs})),
starts AS (SELECT doc_id, 0 AS pos, max(n) AS n FROM chars GROUP BY doc_id
           UNION ALL SELECT doc_id, ix + 1, n FROM chars WHERE ch IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
q_blocks AS (SELECT doc_id, b, substr(text, (b + 1)::BIGINT, 1100) AS piece
             FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS b FROM {docs})),
queries AS (SELECT s.doc_id, s.pos::BIGINT AS pos, substr(q.piece, (s.pos % 1000 + 1)::BIGINT, 100) AS w
            FROM starts s JOIN q_blocks q ON q.doc_id = s.doc_id AND q.b = s.pos - s.pos % 1000
            WHERE s.pos - 1 + 101 < s.n)
"""
INDEX_SQL = """
i_blocks AS (SELECT k, substr(text, (b + 1)::BIGINT, 1099) AS piece
             FROM (SELECT {key} AS k, text, unnest(range(0, length(text), 1000)) AS b FROM {index})),
i_windows AS (SELECT DISTINCT substr(piece, (o + 1)::BIGINT, 100) AS w
              FROM (SELECT piece, unnest(range(0, least(1000, length(piece) - 99))) AS o
                    FROM i_blocks WHERE length(piece) >= 100))
"""


@query(
    "WITH " + QUERY_SQL.format(docs="documents") + "," + INDEX_SQL.format(index="benchmark", key="item_id")
    + "SELECT doc_id, pos FROM queries WHERE w IN (SELECT w FROM i_windows)"
)
def lookup_windows(spark, folder):
    """Query windows of the documents that occur anywhere in the second corpus."""
    docs, index = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return lookup.matched_queries(docs, index, 100, index_key="item_id")


@query(
    "WITH " + QUERY_SQL.format(docs="documents") + "," + INDEX_SQL.format(index="benchmark", key="item_id")
    + """SELECT doc_id, doc_id IN (SELECT doc_id FROM queries WHERE w IN (SELECT w FROM i_windows)) AS has_dup
    FROM documents"""
)
def lookup_flags(spark, folder):
    docs, index = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return lookup.flag_against_index(docs, index, index_key="item_id").select("doc_id", "has_dup")


SAMPLE_SQL = "('0x' || substr(md5('7|' || doc_id), 1, 15))::BIGINT / 1152921504606846976.0 < 0.25"


@query(
    "WITH sampled AS (SELECT * FROM documents WHERE " + SAMPLE_SQL + "),"
    + WINDOWS_SQL.format(docs="sampled") + "," + QUERY_SQL.format(docs="documents") + ","
    + INDEX_SQL.format(index="sampled", key="doc_id")
    + """, hit AS (SELECT DISTINCT doc_id FROM queries WHERE w IN (SELECT w FROM i_windows))
    SELECT doc_id, doc_id IN (SELECT doc_id FROM sampled) AS included_in_dedup FROM documents
    WHERE CASE WHEN doc_id IN (SELECT doc_id FROM sampled) THEN doc_id NOT IN (SELECT doc_id FROM ranges)
          ELSE doc_id NOT IN (SELECT doc_id FROM hit) END"""
)
def two_tier_filter(spark, folder):
    """Deduplicate a quarter exactly and check the rest against it."""
    docs = table(spark, folder, "documents")
    chosen = unit_interval("doc_id", seed=7) < F.lit(0.25)
    marked = dup.annotate_duplicates(docs, LENGTH, included=chosen)
    rest = docs.filter(~chosen).select("doc_id", "text")
    found = lookup.flag_against_index(rest, docs.filter(chosen)).select("doc_id", "has_dup")
    return dup.dedup_filter(marked.join(found, "doc_id", "left")).select("doc_id", "included_in_dedup")


# Starts of all sentences, one after the other, so that overlaps are found.
STARTS_SQL = """WITH RECURSIVE parts AS (SELECT DISTINCT unnest(string_split(text, '. ')) AS query FROM benchmark),
usable AS (SELECT query FROM parts WHERE length(query) > 0),
starts AS (SELECT query, doc_id, instr(text, query)::BIGINT AS place FROM usable, documents WHERE contains(text, query)
  UNION ALL
  SELECT s.query, s.doc_id, s.place + instr(substr(d.text, s.place + 1), s.query) FROM starts s JOIN documents d USING (doc_id)
  WHERE contains(substr(d.text, s.place + 1), s.query))
"""
COUNTS_SQL = STARTS_SQL + """SELECT query, count(place)::BIGINT AS occurrences, count(DISTINCT doc_id)::BIGINT AS num_docs
FROM usable LEFT JOIN starts USING (query) GROUP BY query"""


def _sentences(spark, folder):
    return table(spark, folder, "benchmark").select(F.explode(F.split("text", r"\. ", -1)).alias("query"))


@query(COUNTS_SQL)
def count_occurrences(spark, folder):
    """How often each sentence of the second corpus occurs in the documents."""
    return lookup.count_occurrences(table(spark, folder, "documents"), _sentences(spark, folder))


@query(COUNTS_SQL)
def count_all_occurrences(spark, folder):
    """The same counts, found in the bytes of the texts."""
    return lookup.count_occurrences(table(spark, folder, "documents"), _sentences(spark, folder), unit="bytes")


@query(STARTS_SQL + "SELECT query, doc_id, (place - 1)::BIGINT AS pos FROM starts")
def occurrence_positions(spark, folder):
    """Where each sentence of the second corpus occurs in the documents."""
    return lookup.occurrence_positions(table(spark, folder, "documents"), _sentences(spark, folder))


# All pairs of documents that share a shingle, and the clusters their links make.
NEAR_SQL = """WITH RECURSIVE
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
named AS (SELECT a AS doc_id, min(b) AS cluster_id, count(*)::BIGINT AS cluster_size FROM reached GROUP BY a)
"""


@query(
    NEAR_SQL
    + """SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, cluster_size > 1 AS near_dup, cluster_id, cluster_size
    FROM named LEFT JOIN sizes USING (doc_id)"""
)
def near_duplicates(spark, folder):
    """Clusters of documents that share four fifths of their five-word shingles."""
    return near.near_duplicates(table(spark, folder, "documents"))


@query(
    NEAR_SQL + "," + WINDOWS_SQL.format(docs="documents")
    + """SELECT doc_id, cluster_id, cluster_size FROM named WHERE cluster_size > 1 AND doc_id NOT IN (SELECT doc_id FROM ranges)"""
)
def near_only(spark, folder):
    """Near duplicates in which no exact range was found."""
    docs = table(spark, folder, "documents")
    found = materialize(near.near_duplicates(docs))
    marked = dup.annotate_duplicates(docs, LENGTH).select("doc_id", "dup_ratio").join(found, "doc_id")
    return dup.near_only(marked).select("doc_id", "cluster_id", "cluster_size")
