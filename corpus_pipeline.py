"""From documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept. Stages are written as Parquet and read again before the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import mixing, ngram_join, packing, surrogates, toxicity
from corpuslab.operators.skew import join_counted, with_possible
from corpuslab.session import materialize, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _split(docs: DataFrame, decisions: DataFrame, usual: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose decision is the usual one, and the others with the columns of theirs.

    Decisions have one row per ``doc_id`` of ``docs``; ``copies`` counts them.
    Only texts that may have another decision are shuffled. Rows without an id
    are among the first, as nothing can be decided about them.
    """
    counted = decisions.groupBy("doc_id").agg(
        *(F.max(name).alias(name) for name in decisions.columns if name != "doc_id"), F.count("*").alias("copies")
    )
    unusual = ~F.coalesce(F.expr(usual), F.lit(False))
    others = materialize(counted.filter(unusual & F.col("doc_id").isNotNull()).withColumn("fan_in", F.col("copies")))
    told = with_possible(docs.select(*COLUMNS), others.select("doc_id"), "doc_id", "maybe")
    joined = join_counted(told.filter("maybe").drop("maybe"), others, "doc_id", "fan_in", "left")
    plain = told.filter("not maybe").select(*COLUMNS).unionByName(joined.filter("copies is null").select(*COLUMNS))
    return plain, joined.filter("copies is not null")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic. Rows without an id are kept as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels).select("doc_id", "predicted")
    return _split(docs, scored, "predicted = 0")[0]


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Rows that share an id are one document; of them the longest text stays, the
    one of the greater hash if several are as long.
    """
    joined = ngram_join.similar_documents(docs, size=5, percent=80).select("doc_id", "component_id")
    single, others = _split(docs, joined, "component_id = doc_id and copies = 1")
    order = F.struct(F.length("text"), F.xxhash64("text"), F.xxhash64("lang", "source", "n_chars"))
    longest = F.max_by(F.struct(*COLUMNS), order).alias("row")
    several = others.filter("component_id = doc_id").groupBy("doc_id").agg(longest).select("row.*")
    return single.unionByName(several)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data; ``n_chars`` follows the text."""
    replaced = surrogates.replace_personal_data(docs)
    length = F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", length.cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, to the nearest whole time.

    Weights, share and passes are those of the operator. A shard's quota is one
    run of documents, so only the two at the ends of a run are taken in part.
    Of a source of which all would be rounded off, the document most of which
    is taken stays once. A document without words is kept once: it has no
    weight in the mix.
    """
    taken = mixing.mix_sources(docs).select("doc_id", "source", "size", "taken")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    taken = materialize(taken.withColumn("times", times))
    part = F.when((F.col("times") == 0) & (F.col("taken") > 0), F.struct("taken", F.negative("doc_id").alias("id")))
    lost = taken.filter("size > 0").groupBy("source").agg(F.sum("times").alias("kept"), F.max(part).alias("most"))
    saved = lost.filter("kept = 0 and most is not null").select(F.negative("most.id").alias("doc_id"), F.lit(1).alias("saved"))
    taken = taken.join(saved, "doc_id", "left").withColumn("times", F.greatest("times", F.coalesce("saved", F.lit(0))))
    once, others = _split(docs, taken.select("doc_id", "times"), "times = 1")
    repeated = others.filter("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return once.unionByName(repeated.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_copies),
    ("surrogates", replace_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

# The stages learn, link and encode: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
