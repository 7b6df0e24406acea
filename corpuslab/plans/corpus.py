"""Profiles, normalisation, passages, perplexity, samples, mixtures, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import domains, mixtures, order, packing, passages, perplexity, profile, ranges, sampling
from corpuslab.operators.skew import possible
from corpuslab.plans.registry import query, table
from corpuslab.sources.corpus import cap_length

# ---------------------------------------------------------------- profiles


@query("SELECT source, lang, count(*)::BIGINT AS count FROM documents GROUP BY source, lang")
def count_by_source(spark, folder):
    return profile.count_by(table(spark, folder, "documents"), "source", "lang")


@query("SELECT l_partkey, count(*)::BIGINT AS count FROM lineitem GROUP BY l_partkey ORDER BY count DESC, l_partkey LIMIT 20")
def top_ids(spark, folder):
    """The ids found most often."""
    return profile.top_values(table(spark, folder, "lineitem"), "l_partkey", 20)


@query("SELECT source, lang, count(*)::BIGINT AS count FROM documents GROUP BY source, lang")
def sorted_sources(spark, folder):
    """Sources and languages, the largest groups first."""
    return profile.sort_by(profile.count_by(table(spark, folder, "documents"), "source", "lang"), "count", "source", "lang")


@query(
    """SELECT l_returnflag, l_linestatus, l_extendedprice, l_orderkey, l_linenumber FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1"""
)
def cheapest_lines(spark, folder):
    """The lowest price of each group, and the line it stands on."""
    lines = table(spark, folder, "lineitem")
    return profile.top_of_group(lines, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query("SELECT DISTINCT o_custkey, l_suppkey AS member FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def customer_suppliers(spark, folder):
    """All suppliers of each customer, out of the sets of single orders."""
    sets = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"))
    orders = table(spark, folder, "orders").join(sets, F.col("o_orderkey") == F.col("l_orderkey"))
    return mixtures.union_sets(orders, "o_custkey", "suppliers")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def longest_documents(spark, folder):
    return profile.top_k(table(spark, folder, "documents").select("doc_id", "n_chars"), "n_chars", 100)


@query(
    """SELECT lang, least(floor((least(length(text), 5000)) / 100.0), 49)::BIGINT AS bin, count(*)::BIGINT AS count
    FROM documents GROUP BY ALL"""
)
def length_hist(spark, folder):
    docs = tx.with_text_length(table(spark, folder, "documents"))
    return profile.histogram(docs, "text_length", 50, 0, 5000, ["lang"], clip=5000).select("lang", "bin", "count")


@query(
    """SELECT source, count(*)::BIGINT AS docs, min(length(text))::BIGINT AS min_length, max(length(text))::BIGINT AS max_length,
    round(avg(length(text)), 6) AS mean_length, arg_max(doc_id, length(text) * 1000000000 - doc_id) AS longest
    FROM documents GROUP BY source"""
)
def length_stats(spark, folder):
    return profile.length_stats(table(spark, folder, "documents")).withColumn("mean_length", F.round("mean_length", 6))


@query("SELECT sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM documents")
def total_bytes(spark, folder):
    return profile.total_bytes(table(spark, folder, "documents"))


@query(
    """SELECT lang, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50,
    round(quantile_cont(n_chars, 0.75), 6) AS p75 FROM documents GROUP BY lang"""
)
def length_percentiles(spark, folder):
    found = profile.percentiles(table(spark, folder, "documents"), "n_chars", [25, 50, 75], ["lang"])
    return found.select("lang", *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")])


@query(
    """SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50
    FROM lineitem"""
)
def price_percentiles(spark, folder):
    found = profile.percentiles(table(spark, folder, "lineitem"), "l_extendedprice", [25, 50])
    return found.select(*[F.round(p, 6).alias(p) for p in ("p25", "p50")])


@query(
    """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i,
                        count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, max(n_chars) FILTER (i = floor(n * 0.25)) AS p25, max(n_chars) FILTER (i = floor(n * 0.5)) AS p50
    FROM r GROUP BY lang"""
)
def rank_percentiles(spark, folder):
    return profile.rank_percentile(table(spark, folder, "documents"), "n_chars", [25, 50], ["lang"])


@query(
    """SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1)::BIGINT AS row_index
    FROM documents"""
)
def row_index(spark, folder):
    ranked = profile.row_index(table(spark, folder, "documents"), ["n_chars", "doc_id"], ["lang"])
    return ranked.select("lang", "doc_id", "row_index")


@query("SELECT lang, round(100.0 * count(*) FILTER (n_chars < 1500) / count(*), 6) AS in_ratio FROM documents GROUP BY lang")
def length_in_ratio(spark, folder):
    found = profile.in_ratio(table(spark, folder, "documents"), F.col("n_chars") < 1500, ["lang"])
    return found.withColumn("in_ratio", F.round("in_ratio", 6))


@query(
    """SELECT doc_id, length(text)::BIGINT AS text_length, octet_length(encode(text))::BIGINT AS bytes_len,
    len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS tokens,
    CASE WHEN length(text) < 2000 THEN length(text) ELSE 4000 END::BIGINT AS clipped,
    round((length(text) / 10000.0) * 8.0 + 1.0, 9) AS remapped
    FROM documents"""
)
def text_measures(spark, folder):
    """Lengths, token counts and clipped values of all texts."""
    docs = table(spark, folder, "documents")
    measured = tx.token_counts(tx.with_bytes_len(tx.with_text_length(docs)), r"[^ \t\n\r\f\x0b]+")
    return measured.select(
        "doc_id",
        "text_length",
        "bytes_len",
        "tokens",
        tx.clipped("text_length", 2000, 4000).cast("bigint").alias("clipped"),
        F.round(tx.remap_range(F.col("text_length").cast("double"), 0.0, 10000.0, 1.0, 9.0), 9).alias("remapped"),
    )


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) <= 20000")
def capped_texts(spark, folder):
    """Documents whose text is at most as long as the cap that the caller names."""
    return cap_length(table(spark, folder, "documents"), 20000).select("doc_id", "n_chars")


@query("SELECT round(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))::DOUBLE / count(*), 6) AS mean_tokens FROM documents")
def tokens_per_sample(spark, folder):
    tokens = tx.token_count("text", r"[^ \t\n\r\f\x0b]+")
    return sampling.tokens_per_sample(table(spark, folder, "documents"), tokens).select(
        F.round("mean_tokens", 6).alias("mean_tokens")
    )


# ----------------------------------------------------------------- domains


@query(
    """SELECT split_part(url, '/', 3) AS domain, count(*)::BIGINT AS count,
    round(100.0 * count(*) / (SELECT count(*) FROM pages WHERE url LIKE '%/%/%'), 6) AS ratio
    FROM pages WHERE url LIKE '%/%/%' GROUP BY domain"""
)
def domain_counts(spark, folder):
    return domains.domain_counts(table(spark, folder, "pages")).withColumn("ratio", F.round("ratio", 6))


DOMAINS_SQL = """
WITH a AS (SELECT split_part(url, '/', 3) AS domain, count(*)::BIGINT AS count FROM pages WHERE url LIKE 'https:%' GROUP BY domain),
b AS (SELECT split_part(url, '/', 3) AS domain, count(*)::BIGINT AS count FROM pages WHERE url NOT LIKE 'https:%' GROUP BY domain),
ra AS (SELECT *, 100.0 * count / (SELECT sum(count) FROM a) AS ratio FROM a ORDER BY count DESC, domain LIMIT 100),
rb AS (SELECT *, 100.0 * count / (SELECT sum(count) FROM b) AS ratio FROM b)
SELECT ra.domain, ra.count AS count_a, round(ra.ratio, 6) AS ratio_a, coalesce(rb.count, 0)::BIGINT AS count_b,
       round(coalesce(rb.ratio, 0), 6) AS ratio_b,
       round(CASE WHEN coalesce(rb.ratio, 0) = 0 THEN 13131313.0 ELSE ra.ratio / rb.ratio END, 6) AS ratio
FROM ra LEFT JOIN rb USING (domain)
"""


@query(DOMAINS_SQL)
def blindspots(spark, folder):
    """Domains of the encrypted pages that are rare among the others."""
    pages = table(spark, folder, "pages")
    secure = F.col("url").startswith("https:")
    a, b = domains.domain_counts(pages.filter(secure)), domains.domain_counts(pages.filter(~secure))
    found = domains.blindspots(a, b, 100)
    return found.select(
        "domain",
        "count_a",
        F.round("ratio_a", 6).alias("ratio_a"),
        "count_b",
        F.round("ratio_b", 6).alias("ratio_b"),
        F.round("ratio", 6).alias("ratio"),
    )


# ----------------------------------------------------------- normalisation


def _sql_text(value: str) -> str:
    return " || ".join(
        f"chr({ord(c)})" if ord(c) < 32 or ord(c) > 126 else ("''''" if c == "'" else f"'{c}'") for c in value
    )


def normalized_sql(text: str) -> str:
    """The normalisation chain in SQL, from the same fixed values."""
    control = "[\\x00-\\x1f\\x7f-\\x{9f}]"
    strip = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    spaces = tx.OTHER_WHITESPACE + tx.ASCII_WHITESPACE
    single = {mark: to for mark, to in tx.PUNCTUATION.items() if len(to) == 1}
    sql = f"regexp_replace({text}, '{control}', '', 'g')"
    sql = f"regexp_replace({sql}, '^{strip}+|{strip}+$', '', 'g')"
    sql = f"translate({sql}, {_sql_text(spaces)}, '{' ' * len(spaces)}')"
    sql = f"regexp_replace({sql}, '\\p{{Nd}}', '0', 'g')"
    sql = f"translate({sql}, {_sql_text(''.join(single))}, {_sql_text(''.join(single.values()))})"
    for mark, to in tx.PUNCTUATION.items():
        if len(to) > 1:
            sql = f"replace({sql}, {_sql_text(mark)}, '{to}')"
    return sql


@query(f"SELECT doc_id, {normalized_sql('text')} AS text FROM documents")
def normalize_text(spark, folder):
    return tx.normalize(table(spark, folder, "documents").select("doc_id", "text"))


@query(f"SELECT conv_id, turn, {normalized_sql('lower(text)')} AS text FROM conversations")
def normalize_turns(spark, folder):
    """The same chain with lower-casing, on the turns of conversations."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return tx.normalize(turns, lower=True)


# ---------------------------------------------------------------- passages

BREAKS_SQL = """
chars AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS ix
          FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)),
breaks AS (SELECT doc_id, -1 AS ix FROM documents
           UNION ALL SELECT doc_id, ix FROM chars WHERE ch IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
numbered AS (SELECT doc_id, ix, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS i,
                    count(*) OVER (PARTITION BY doc_id) AS n FROM breaks)
"""


def segments_sql(passage: int, step: int) -> str:
    return f"""{BREAKS_SQL},
    lefts AS (SELECT doc_id, i, n, ix + 1 AS l FROM numbered
              WHERE i % {step} = 0 AND i <= greatest(0, ceil((n - {passage}) / {step}.0) * {step})),
    segments AS (SELECT l.doc_id, (l.i // {step})::BIGINT AS seg, l.l::BIGINT AS seg_start,
                   (CASE WHEN l.i + {passage} >= l.n THEN length(d.text) ELSE r.ix + 1 END)::BIGINT AS seg_end, d.text
                 FROM lefts l JOIN documents d USING (doc_id)
                 LEFT JOIN numbered r ON r.doc_id = l.doc_id AND r.i = l.i + {passage})
    """


@query(
    f"""WITH {segments_sql(64, 48)},
    blocks AS (SELECT doc_id, b, substr(text, (b + 1)::BIGINT, 1000) AS piece
               FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS b FROM documents)),
    parts AS (SELECT s.doc_id, seg, seg_start, seg_end, b, substr(piece, greatest(seg_start - b, 0)::BIGINT + 1,
                (least(seg_end - b, 1000) - greatest(seg_start - b, 0))::BIGINT) AS part
              FROM segments s JOIN blocks k ON k.doc_id = s.doc_id AND b + 1000 > seg_start AND b < seg_end)
    SELECT doc_id, seg, seg_start, seg_end, coalesce(passage, '') AS passage FROM segments LEFT JOIN
      (SELECT doc_id, seg, string_agg(part, '' ORDER BY b) AS passage FROM parts GROUP BY doc_id, seg) USING (doc_id, seg)"""
)
def segments(spark, folder):
    """Passages of 64 tokens that overlap by 16."""
    found = passages.segment(table(spark, folder, "documents"), 64, 16)
    return found.select(
        "doc_id",
        F.col("seg").cast("bigint").alias("seg"),
        F.col("left").cast("bigint").alias("seg_start"),
        F.col("right").cast("bigint").alias("seg_end"),
        "passage",
    )


@query(
    f"""WITH {segments_sql(256, 256)},
    sizes AS (SELECT doc_id, max(seg) + 1 AS n FROM segments GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length(text) > 1024 THEN substr(text, seg_start + 1, seg_end - seg_start) ELSE text END AS passage
    FROM segments JOIN sizes USING (doc_id)
    WHERE seg = ('0x' || substr(md5('3|' || doc_id), 1, 15))::BIGINT % n"""
)
def choose_passage(spark, folder):
    """One passage of 256 tokens per long document."""
    return passages.choose_passage(table(spark, folder, "documents"), seed=3).select("doc_id", "passage")


@query(
    """WITH chars AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS ix, len(c) AS n
              FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)),
    spaces AS (SELECT doc_id, ix, n, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS i FROM chars
               WHERE ch IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    starts AS (SELECT doc_id, 0 AS pos, max(n) AS n FROM chars GROUP BY doc_id
               UNION ALL SELECT doc_id, ix + 1, n FROM spaces WHERE i % 2 = 0),
    blocks AS (SELECT doc_id, b, substr(text, (b + 1)::BIGINT, 1100) AS piece
               FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS b FROM documents))
    SELECT s.doc_id, s.pos::BIGINT AS pos, substr(q.piece, (s.pos % 1000 + 1)::BIGINT, 100) AS query
    FROM starts s JOIN blocks q ON q.doc_id = s.doc_id AND q.b = s.pos - s.pos % 1000
    WHERE s.pos - 1 + 101 < s.n"""
)
def query_windows(spark, folder):
    """Windows of 100 characters at every second whitespace."""
    found = passages.query_windows(table(spark, folder, "documents"), 100, 2)
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("window").alias("query"))


# -------------------------------------------------------------- perplexity

WORDS_SQL = f"""
words AS (SELECT doc_id, list_concat(list_concat(['<s>'], list_filter(string_split({normalized_sql('text')}, ' '), lambda w: w <> '')), ['</s>']) AS w
          FROM documents),
pairs AS (SELECT doc_id, w[i] AS before, w[i + 1] AS word
          FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words)),
model AS (SELECT before, word, count(*)::BIGINT AS n FROM pairs
          WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY before, word)
"""
SCORES_SQL = WORDS_SQL + """,
contexts AS (SELECT before, sum(n) AS n_before FROM model GROUP BY before),
unigrams AS (SELECT word, sum(n) AS n_word FROM model GROUP BY word),
sizes AS (SELECT sum(n) AS total, count(DISTINCT word) AS vocabulary FROM model),
logs AS (SELECT p.before, p.word,
           log10(0.75 * coalesce(m.n::DOUBLE / c.n_before, 0) + 0.25 * (coalesce(u.n_word, 0) + 1)::DOUBLE / (s.total + s.vocabulary + 1)) AS logp
         FROM (SELECT DISTINCT before, word FROM pairs) p LEFT JOIN model m USING (before, word)
         LEFT JOIN contexts c USING (before) LEFT JOIN unigrams u USING (word) CROSS JOIN sizes s),
scores AS (SELECT doc_id, round(pow(10.0, -sum(logp) / count(*)), 1) AS perplexity
           FROM pairs JOIN logs USING (before, word) GROUP BY doc_id)
"""


def _model(spark, folder):
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    docs = possible(table(spark, folder, "documents"), good, "doc_id")
    return perplexity.train_ngram(docs.join(good, "doc_id", "left_semi"))


def _scores(spark, folder):
    docs = table(spark, folder, "documents")
    return perplexity.perplexity(docs, perplexity.materialize(_model(spark, folder)))


@query("WITH " + WORDS_SQL + "SELECT before, word, n FROM model")
def ngram_counts(spark, folder):
    """Bigram counts of the documents labelled good."""
    return _model(spark, folder)


@query("WITH " + SCORES_SQL + "SELECT doc_id, perplexity FROM scores")
def document_perplexity(spark, folder):
    return _scores(spark, folder)


@query("WITH " + SCORES_SQL + "SELECT doc_id, perplexity FROM scores WHERE perplexity < (SELECT quantile_cont(perplexity, 0.25) FROM scores)")
def ppl_below25(spark, folder):
    return perplexity.below_percentile(perplexity.materialize(_scores(spark, folder)), "perplexity", 25)


@query(
    "WITH " + SCORES_SQL
    + """SELECT doc_id, perplexity FROM scores WHERE perplexity > (SELECT quantile_cont(perplexity, 0.25) FROM scores)
    AND perplexity < (SELECT quantile_cont(perplexity, 0.75) FROM scores)"""
)
def ppl_mid(spark, folder):
    return perplexity.between_percentiles(perplexity.materialize(_scores(spark, folder)), "perplexity", 25, 75)


@query(
    "WITH " + SCORES_SQL
    + """SELECT least(floor(least(perplexity, 20000.0::DOUBLE) / 200), 99)::BIGINT AS bin, count(*)::BIGINT AS count
    FROM scores GROUP BY bin"""
)
def ppl_histogram(spark, folder):
    """Documents per bin of perplexity, high ones in the last bin."""
    return profile.histogram(_scores(spark, folder), "perplexity", 100, 0, 20000, clip=20000).select("bin", "count")


PERCENTS = (5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0)


@query(
    "WITH " + SCORES_SQL
    + f""", cuts AS (SELECT unnest({list(PERCENTS)}::DOUBLE[]) AS p,
      unnest(quantile_cont(perplexity, {[p / 100 for p in PERCENTS]})) AS t FROM scores)
    SELECT p AS percent, round(t, 6) AS threshold, (SELECT count(*) FROM scores WHERE perplexity < t)::BIGINT AS below,
      (SELECT count(*) FROM scores WHERE perplexity > t)::BIGINT AS above, true AS sketch_holds FROM cuts"""
)
def ppl_thresholds(spark, folder):
    """What each percentile of perplexity would keep, exactly and by a sketch of one pass."""
    found = perplexity.threshold_table(perplexity.materialize(_scores(spark, folder)), "perplexity", PERCENTS)
    return found.select(
        "percent", F.round("threshold", 6).alias("threshold"), "below", "above", (F.col("rank_error") <= 0.001 + 1 / F.col("n")).alias("sketch_holds")
    )


@query(
    "WITH " + SCORES_SQL
    + """SELECT doc_id, perplexity, round(590 - 10000 / cbrt(length(text)), 6) AS lower_bound,
    round(590 + 10000 / cbrt(length(text)), 6) AS upper_bound,
    perplexity > 590 - 10000 / cbrt(length(text)) AND perplexity < 590 + 10000 / cbrt(length(text)) AS is_in
    FROM scores JOIN documents USING (doc_id)"""
)
def length_envelope(spark, folder):
    docs = tx.with_text_length(table(spark, folder, "documents")).select("doc_id", "text_length")
    found = perplexity.length_envelope(_scores(spark, folder).join(docs, "doc_id"))
    return found.select(
        "doc_id",
        "perplexity",
        F.round("lower", 6).alias("lower_bound"),
        F.round("upper", 6).alias("upper_bound"),
        "is_in",
    )


@query(
    "WITH " + SCORES_SQL
    + """SELECT (length(text) // 1000)::BIGINT AS length_bin, count(*) FILTER (perplexity < 451)::BIGINT AS inside,
    count(*) FILTER (perplexity >= 451)::BIGINT AS outside FROM scores JOIN documents USING (doc_id) GROUP BY length_bin"""
)
def ppl_by_length(spark, folder):
    docs = tx.with_text_length(table(spark, folder, "documents")).select("doc_id", "text_length")
    return perplexity.in_out_by_length(_scores(spark, folder).join(docs, "doc_id"), 451.0)


@query(
    f"""WITH {WORDS_SQL},
    contexts AS (SELECT before, sum(n) AS n_before FROM model GROUP BY before),
    unigrams AS (SELECT word, sum(n) AS n_word FROM model GROUP BY word),
    sizes AS (SELECT sum(n) AS total, count(DISTINCT word) AS vocabulary FROM model),
    {segments_sql(256, 256)},
    seg_words AS (SELECT doc_id, seg, list_concat(list_concat(['<s>'], list_filter(string_split(
        {normalized_sql('substr(text, seg_start + 1, seg_end - seg_start)')}, ' '), lambda w: w <> '')), ['</s>']) AS w FROM segments),
    seg_pairs AS (SELECT doc_id, seg, w[i] AS before, w[i + 1] AS word
                  FROM (SELECT doc_id, seg, w, unnest(range(1, len(w))) AS i FROM seg_words)),
    logs AS (SELECT p.doc_id, p.seg,
               log10(0.75 * coalesce(m.n::DOUBLE / c.n_before, 0) + 0.25 * (coalesce(u.n_word, 0) + 1)::DOUBLE / (s.total + s.vocabulary + 1)) AS logp
             FROM seg_pairs p LEFT JOIN model m USING (before, word)
             LEFT JOIN contexts c USING (before) LEFT JOIN unigrams u USING (word) CROSS JOIN sizes s),
    scored AS (SELECT doc_id, seg, floor(round(pow(10.0, -sum(logp) / count(*)), 1))::BIGINT AS ppl FROM logs GROUP BY doc_id, seg)
    SELECT doc_id, min(ppl) AS min_perplexity, max(ppl) AS max_perplexity FROM scored GROUP BY doc_id"""
)
def passage_perplexity(spark, folder):
    """Lowest and highest perplexity over passages of 256 tokens."""
    docs = table(spark, folder, "documents")
    return perplexity.passage_perplexity_range(docs, perplexity.materialize(_model(spark, folder)), 256)


# ----------------------------------------------------- samples and budgets

WORD_COUNT = r"[^ \t\n\r\f\x0b]+"
TOKENS_SQL = "len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))"


@query(
    """SELECT doc_id, (sum(octet_length(encode(text)) + 6) OVER (ORDER BY doc_id) - octet_length(encode(text)))::BIGINT AS byte_start,
    sum(octet_length(encode(text)) + 6) OVER (ORDER BY doc_id)::BIGINT AS byte_end FROM documents"""
)
def byte_offsets(spark, folder):
    found = order.byte_offsets(table(spark, folder, "documents"), "doc_id")
    return found.select("doc_id", F.col("start").alias("byte_start"), F.col("end").alias("byte_end"))


@query(
    """WITH offsets AS (SELECT doc_id, sum(octet_length(encode(text)) + 6) OVER (ORDER BY doc_id) - octet_length(encode(text)) AS s,
      sum(octet_length(encode(text)) + 6) OVER (ORDER BY doc_id) AS e FROM documents)
    SELECT l_orderkey, l_linenumber, l_partkey, doc_id, (l_partkey * 997 - s)::BIGINT AS pos_in_doc
    FROM lineitem LEFT JOIN offsets ON l_partkey * 997 >= s AND l_partkey * 997 < e + 6"""
)
def assign_document(spark, folder):
    """Which document each of many global byte positions falls in; one in a separator, in the document to its left."""
    offsets = order.byte_offsets(table(spark, folder, "documents"), "doc_id")
    places = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 997).alias("pos")
    )
    return ranges.assign_document(places, offsets, separator_bytes=6).drop("pos")


@query(
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n
    FROM documents) WHERE i < n * 0.4::DOUBLE"""
)
def shorter_part(spark, folder):
    """The first two fifths of the documents in the order of their length."""
    docs = table(spark, folder, "documents")
    return sampling.split_range(docs, 0.0, 0.4, ["n_chars", "doc_id"]).select("doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 150")
def head_documents(spark, folder):
    return sampling.head(table(spark, folder, "documents"), 150).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 150")
def tail_documents(spark, folder):
    return sampling.tail(table(spark, folder, "documents"), 150).select("doc_id", "lang")


@query(
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
    WHERE i >= 0.95 * n"""
)
def validation_split(spark, folder):
    return sampling.split_range(table(spark, folder, "documents"), 0.95, 1.0).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE ('0x' || substr(md5('5|' || doc_id), 1, 15))::BIGINT / 1152921504606846976.0 < 0.3")
def bernoulli_sample(spark, folder):
    return sampling.bernoulli(table(spark, folder, "documents"), 0.3, 5).select("doc_id", "n_chars")


@query(
    """WITH size AS (SELECT count(*) AS n FROM documents),
    wanted AS (SELECT CASE WHEN 100000 <= n THEN 100000 WHEN 10000 <= n THEN 10000 WHEN 1000 <= n THEN 1000 ELSE 100 END AS k FROM size)
    SELECT doc_id FROM documents
    QUALIFY row_number() OVER (ORDER BY ('0x' || substr(md5('9|' || doc_id), 1, 15))::BIGINT, doc_id) <= (SELECT k FROM wanted)"""
)
def small_sample(spark, folder):
    return sampling.small_sample(table(spark, folder, "documents"), 100_000, "doc_id", seed=9).select("doc_id")


@query(
    f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents),
    m AS (SELECT ceil(100000.0 / (sum(tokens)::DOUBLE / count(*))) AS k FROM t)
    SELECT doc_id, tokens::BIGINT AS tokens FROM t QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT k FROM m)"""
)
def take_budget(spark, folder):
    """Documents for a budget of 100,000 tokens."""
    docs = tx.token_counts(table(spark, folder, "documents"), WORD_COUNT)
    return sampling.take_budget(docs, 100_000, "tokens").select("doc_id", "tokens")


@query(
    """WITH c AS (SELECT doc_id, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS running,
                       sum(octet_length(encode(text))) OVER () AS total FROM documents)
    SELECT doc_id, name AS subset FROM c
    JOIN (VALUES (0.9, 'large'), (0.5, 'half'), (0.1, 'small')) AS r(ratio, name) ON running < total * ratio::DOUBLE"""
)
def ratio_subsets(spark, folder):
    found = sampling.ratio_subsets(
        table(spark, folder, "documents"), [0.1, 0.5, 0.9], ["small", "half", "large"]
    )
    return found.select("doc_id", F.explode("subsets").alias("subset"))


@query(
    f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents),
    m AS (SELECT ceil(50000.0 / (sum(tokens)::DOUBLE / count(*))) AS k FROM t),
    base AS (SELECT * FROM t QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT k FROM m)),
    u AS (SELECT sum(tokens) AS unique_tokens, 180000 // sum(tokens) AS epochs FROM base),
    whole AS (SELECT doc_id, unnest(range(0, (SELECT epochs FROM u)::BIGINT)) AS epoch FROM base),
    part AS (SELECT doc_id, sum(tokens) OVER (ORDER BY ('0x' || substr(md5('0|' || doc_id), 1, 15))::BIGINT, doc_id) AS running FROM base)
    SELECT doc_id, epoch::BIGINT AS epoch FROM whole
    UNION ALL SELECT doc_id, (SELECT epochs FROM u)::BIGINT FROM part
    WHERE running <= 180000 - (SELECT epochs * unique_tokens FROM u)"""
)
def repeat_budget(spark, folder):
    """50,000 unique tokens repeated up to 180,000."""
    docs = tx.token_counts(table(spark, folder, "documents"), WORD_COUNT).select("doc_id", "tokens")
    return sampling.repeat_to_budget(docs, 50_000, 180_000, "tokens").select("doc_id", "epoch")


def mixture_sql(shares: str) -> str:
    return f"""WITH t AS (SELECT doc_id, lang, {TOKENS_SQL} AS tokens FROM documents),
    r AS (SELECT doc_id, lang, sum(tokens) OVER (PARTITION BY lang ORDER BY doc_id) AS running,
                 sum(tokens) OVER (PARTITION BY lang) AS size FROM t),
    s AS (SELECT * FROM (VALUES {shares}) AS v(mix_id, lang, weight)),
    e AS (SELECT mix_id, doc_id, lang,
            floor(weight::DOUBLE * 300000 / size)
            + (running <= weight::DOUBLE * 300000 - floor(weight::DOUBLE * 300000 / size) * size)::INT AS epochs
          FROM r JOIN s USING (lang))
    SELECT mix_id, lang, doc_id, unnest(range(0, epochs::BIGINT))::BIGINT AS epoch FROM e"""


@query(
    "SELECT lang, doc_id, epoch FROM ("
    + mixture_sql("('a', 'en', 0.5), ('a', 'fr', 0.3), ('a', 'de', 0.2)")
    + ")"
)
def mix_sources(spark, folder):
    """Three languages mixed to 300,000 tokens, short ones repeated."""
    docs = tx.token_counts(table(spark, folder, "documents"), WORD_COUNT).select("doc_id", "lang", "tokens")
    weights = {"en": 0.5, "fr": 0.3, "de": 0.2}
    return mixtures.mix(docs, weights, 300_000, "tokens", "lang").select("lang", "doc_id", "epoch")


@query(
    mixture_sql(
        ", ".join(f"('en_{i}0', 'en', {i / 10!r}), ('en_{i}0', 'es', {(10 - i) / 10!r})" for i in range(1, 10))
    )
)
def mixture_series(spark, folder):
    """Two languages in nine proportions."""
    docs = tx.token_counts(table(spark, folder, "documents"), WORD_COUNT).select("doc_id", "lang", "tokens")
    found = mixtures.mixture_series(docs, mixtures.tenths_series("en", "es"), 300_000, "tokens", "lang")
    return found.select("mix_id", "lang", "doc_id", "epoch")


@query(
    """SELECT part AS split, '/data/' || source || '_' || lang AS source, round(1.0 * count(*) / 1000, 3)::DOUBLE AS weight,
    0.0::DOUBLE AS low, CASE WHEN part = 'train' THEN 0.95 ELSE 1.0 END::DOUBLE AS high
    FROM documents, (VALUES ('train'), ('valid')) AS v(part) GROUP BY ALL"""
)
def mixture_lines(spark, folder):
    """One-line specifications written from the corpus and read back."""
    return _specification(spark, folder)


@query(
    """SELECT doc_id, round(1.0 * count(*) OVER (PARTITION BY source, lang) / 1000, 3)::DOUBLE AS weight FROM documents"""
)
def weighted_documents(spark, folder):
    """Every document with the weight its source has for training."""
    spec = _specification(spark, folder).filter("split = 'train'")
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("_"), "lang").alias("source"))
    return mixtures.attach_weight(docs, spec).select("doc_id", "weight")


def _specification(spark, folder):
    counts = profile.count_by(table(spark, folder, "documents"), "source", "lang")
    weight = F.round(F.col("count") / 1000, 3)
    path = F.concat(F.lit("/data/"), "source", F.lit("_"), "lang")
    item = lambda high: F.format_string(f"%.3f 0:{high} %s", weight, path)
    lines = counts.select(
        F.format_string('"train: %s" "valid: %s"', item("0.95"), item("1")).alias("value")
    )
    return mixtures.mixture_spec(lines)


@query(
    """WITH t AS (SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''),
        lambda w: ('0x' || substr(md5(w), 1, 4))::INT) AS ids FROM documents),
    n AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch_no FROM t),
    u AS (SELECT batch_no, doc_id, generate_subscripts(ids, 1) AS i, unnest(ids) AS id FROM n),
    g AS (SELECT batch_no, id, row_number() OVER (PARTITION BY batch_no ORDER BY doc_id, i) - 1 AS ix FROM u)
    SELECT batch_no::BIGINT AS batch_no, (ix // 128)::BIGINT AS block_no, string_agg(id::VARCHAR, ' ' ORDER BY ix) AS ids
    FROM g GROUP BY batch_no, ix // 128 HAVING count(*) = 128"""
)
def pack_sequences(spark, folder):
    """Word ids packed into blocks of 128 within batches of 100 documents."""
    words = F.filter(F.split("text", " ", -1), lambda word: word != "")
    ids = F.transform(words, lambda word: F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int"))
    docs = table(spark, folder, "documents").select("doc_id", ids.alias("input_ids"))
    packed = packing.pack_sequences(docs, 128, 100)
    text = F.array_join(F.transform("input_ids", lambda i: i.cast("string")), " ")
    return packed.select("batch_no", "block_no", text.alias("ids"))
