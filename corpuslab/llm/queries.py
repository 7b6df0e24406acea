"""A query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import (
    class_model,
    edit_counts,
    licences,
    mixing,
    ngram_join,
    packing,
    phrases,
    spots,
    superkmers,
    surrogates,
    toxicity,
    vectors,
    whitening,
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document before and after four edits, counted along its tree."""
    docs = _documents(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text").cast("bigint")

    def edit(start: Column, deleted: int, inserted: Column) -> Column:
        return F.struct(
            start.cast("bigint").alias("start"), F.lit(deleted).cast("bigint").alias("deleted"), inserted.alias("inserted")
        )

    edits = F.array(
        edit(F.floor(size / 3), 0, F.lit(" [redacted] ")),
        edit(F.floor(size / 2), 12, F.lit("")),
        edit(F.lit(0), 3, F.substring("text", 1, 40)),
        edit(size, 0, F.lit("\n\nRevised.")),
    )
    counted = edit_counts.count_tokens(docs.withColumn("edits", edits)).withColumnRenamed("n_tokens", "tokens_before")
    counted = counted.withColumn("chars_before", size)
    return edit_counts.recount(counted).select(
        "doc_id",
        "chars_before",
        "tokens_before",
        F.length("text").cast("bigint").alias("chars_after"),
        F.col("n_tokens").alias("tokens_after"),
        "encoded_chars",
    )


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(_documents(spark, folder), size=4, percent=85)


def op3_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace_personal_data(_documents(spark, folder))


def op4_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return spots.spot_signatures(_documents(spark, folder))


def op5_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.score_toxicity(_documents(spark, folder), labels)


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, folder))


def op7_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, folder))


def op8_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(_documents(spark, folder))


def op9_class_model(spark: SparkSession, folder: str) -> DataFrame:
    return class_model.score_texts(_documents(spark, folder))


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine_phrases(_documents(spark, folder))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return superkmers.remove_repeats(_documents(spark, folder))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    plan.__name__: plan
    for plan in (
        op1_edit_counts,
        op2_ngram_join,
        op3_surrogates,
        op4_spot_signatures,
        op5_toxic_segments,
        op6_mix_sources,
        op7_harmonic_packing,
        op8_licence_scan,
        op9_class_model,
        op10_near_vectors,
        op11_collocations,
        op12_substring_dedup,
        op13_whitening,
        pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op11_collocations": """
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')) as piece
            from documents
        ), split as (
            select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as words from pieces
        ), placed as (
            select lang, words, unnest(range(1, len(words) + 1)) as pos from split
        ), grams as (
            select lang, unnest(list_transform(range(1, least(5, len(words) - pos + 1) + 1),
                lambda s: {'size': s, 'phrase': array_to_string(words[pos:pos + s - 1], ' ')})) as gram
            from placed
        ), f as (
            select lang, gram.phrase as phrase, gram.size as size, count(*) as f from grams group by all
        ), totals as (
            select lang, sum(f) as n from f where size = 1 group by lang
        ), candidates as (
            select lang, phrase, size, f as a, string_split(phrase, ' ') as words from f where size > 1 and f >= 100
        ), inside as (
            select distinct c.lang, array_to_string(c.words[i:i + s - 1], ' ') as phrase, c.a
            from (select *, unnest(range(2, size)) as s from candidates) c, unnest(range(1, size - s + 2)) as t(i)
        ), most as (
            select lang, phrase, max(a) as most from inside group by all
        ), left_over as (
            select c.* from candidates c left join most m on c.lang = m.lang and c.phrase = m.phrase
            where m.most is null or 100 * m.most < 100 * c.a
        ), cuts as (
            select *, unnest(range(1, size)) as k from left_over
        ), parted as (
            select c.lang, c.phrase, a, k, x.f as l, y.f as r, n,
                   (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score
            from cuts c
            join f x on x.lang = c.lang and x.phrase = array_to_string(c.words[1:k], ' ')
            join f y on y.lang = c.lang and y.phrase = array_to_string(c.words[k + 1:], ' ')
            join totals t on t.lang = c.lang
        ), lowest as (
            select * from parted qualify row_number() over (partition by lang, phrase order by score, k) = 1
        )
        select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
               cast(n as bigint) as n, cast(score as bigint) as score
        from (
            select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
        ) where rank <= 2000
    """,
    "op12_substring_dedup": """
        with d as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
        ), starts as (
            select doc_id, words, unnest(range(1, len(words) - 48)) as pos from d
        ), windows as (
            select doc_id, pos, array_to_string(words[pos:pos + 49], ' ') as content from starts
        ), firsts as (
            select content, min(doc_id) as first_id from windows group by content
        ), gone as (
            select distinct doc_id, unnest(range(pos, pos + 50)) as pos
            from windows join firsts using (content) where doc_id > first_id
        ), placed as (
            select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from d
        ), kept as (
            select p.doc_id, count(g.pos) as n_removed,
                   string_agg(p.word, ' ' order by p.pos) filter (where g.pos is null) as kept
            from placed p left join gone g on p.doc_id = g.doc_id and p.pos = g.pos group by p.doc_id
        )
        select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
               sha256(coalesce(kept, '')) as kept_sha256
        from d left join kept using (doc_id)
    """,
}
