"""Tables written to files and read back, as the pipelines before and after would."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import mixtures, profile
from corpuslab.plans.evaluation import _lines
from corpuslab.plans.registry import query, table
from corpuslab.session import shared_folder
from corpuslab.sources import corpus, evaluations, logs


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 1000 THEN 'short' ELSE 'long' END AS dataset, 'train' AS split,
    'https://' || source || '.example.org:80/' || doc_id AS url, source || '.example.org:80' AS domain,
    round(n_chars / 8.0::DOUBLE, 6) AS perplexity, md5(text) AS text_md5 FROM documents"""
)
def jsonl_documents(spark, folder):
    """Documents with metadata as JSON lines in two parts, read back with their URL and stored score."""
    docs = table(spark, folder, "documents")
    meta = F.struct(
        F.struct(F.format_string("https://%s.example.org:80/%d", "source", "doc_id").alias("warc-target-uri")).alias("warc_headers"),
        (F.col("n_chars") / 8).alias("perplexity_score"),
    )
    described = docs.select("doc_id", "text", F.to_json(meta).alias("meta"))
    parts = {"short": profile.filter_length(described, high=1000), "long": profile.filter_length(described, low=1001)}
    path = _folder(spark)
    corpus.write_jsonl(mixtures.concat(parts), path, ("doc_id", "text", "meta", "dataset"))
    found = corpus.read_corpus(spark, path, schema=f"{corpus.CORPUS_SCHEMA}, dataset string")
    found = tx.with_meta_perplexity(tx.with_domain(tx.with_url(tx.tag_source(found, "train", "split"), "oscar")))
    found = found.withColumn("text_md5", F.md5("text")).withColumn("perplexity", F.round("perplexity", 6))
    return tx.keep_columns(found, "doc_id", "dataset", "split", "url", "domain", "perplexity", "text_md5")


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def parquet_documents(spark, folder):
    """Documents written as two tables by length and read back as one."""
    docs = profile.split_by_cutoff(table(spark, folder, "documents"), "n_chars", 1000)
    paths = [_folder(spark), _folder(spark)]
    corpus.write_table(docs.filter("is_in").drop("is_in"), paths[0])
    corpus.write_table(docs.filter("not is_in").drop("is_in"), paths[1])
    found = corpus.read_corpus(spark, paths, "parquet")
    return found.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    """SELECT event_type AS dataset, (user_id % 6)::INT AS fewshots, 'p, "' || (user_id % 10) || '"' AS prompt, 'acc' AS metric,
    round(sum(value), 6) AS value FROM events GROUP BY ALL"""
)
def score_files(spark, folder):
    """A score table as CSV, read back; names hold commas and quotes."""
    scores = table(spark, folder, "events").groupBy(
        F.col("event_type").alias("dataset"),
        (F.col("user_id") % 6).cast("int").alias("fewshots"),
        F.format_string('p, "%d"', F.col("user_id") % 10).alias("prompt"),
        F.lit("acc").alias("metric"),
    ).agg(F.sum("value").alias("value"))
    path = _folder(spark)
    corpus.write_scores(scores, path)
    return corpus.read_scores(spark, path).drop("file").withColumn("value", F.round("value", 6))


@query("SELECT 'r' || (user_id % 7) AS run, event_type AS tag, event_id AS step, value FROM events")
def curve_files(spark, folder):
    """Loss curves as CSV, one folder a run, read back and stacked."""
    run = F.format_string("r%d", F.col("user_id") % 7)
    points = table(spark, folder, "events").select(
        F.lit(0).alias("row"), run.alias("run_name"), F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value",
        run.alias("run"),
    )
    path = _folder(spark)
    points.write.option("header", True).partitionBy("run").csv(path)
    return corpus.read_curves(spark, f"{path}/*/*.csv", named_by="folder")


@query(
    """WITH named AS (SELECT event_id, value / 1000 AS v, event_type, (event_id // 100)::BIGINT AS file,
      ['en-fr', 'fr-en', 'hi-en', 'en-hi', 'plain'][(user_id % 5 + 1)::INT] AS pair FROM events),
    flat AS (SELECT file, 'set/' || event_type || CASE WHEN pair = 'plain' THEN '' ELSE '_' || pair END AS dataset,
      (file % 6)::INT AS fewshots, 'p' || (event_id % 100) || ' ' || pair AS prompt, v FROM named),
    last AS (SELECT (user_id % 3) AS a, (user_id % 7) AS b, arg_max(value, event_id) / 1000 AS v, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
    SELECT dataset, fewshots, prompt, 'acc' AS metric, round(arg_max(v, file), 9) AS value FROM flat GROUP BY ALL
    UNION ALL SELECT dataset, fewshots, prompt, 'tries', 3.0 FROM flat GROUP BY ALL
    UNION ALL SELECT 'set/last_' || a, 0, 't' || b, 'evaluation.accuracy', round(v, 9) FROM last
    UNION ALL SELECT 'set/last_' || a, 0, 't' || b, 'evaluation.n', n FROM last"""
)
def result_files(spark, folder):
    """A tree of result files of both kinds, found, told apart by name and merged."""
    events = table(spark, folder, "events")
    path = _folder(spark)
    number = F.floor(F.col("event_id") / 100).cast("bigint")
    pairs = F.array(*[F.lit(p) for p in ("en-fr", "fr-en", "hi-en", "en-hi", "plain")])
    entry = F.struct(
        F.concat(F.lit("set/"), "event_type").alias("task_name"),
        F.format_string("p%d %s", F.col("event_id") % 100, F.element_at(pairs, (F.col("user_id") % 5 + 1).cast("int"))).alias("prompt_name"),
        (F.col("value") / 1000).alias("acc"),
        F.lit(3).alias("tries"),
        F.lit("0.7").alias("note"),
        F.lit(True).alias("greedy"),
    )
    # A hundred events make a file.
    first = events.groupBy(number.alias("number")).agg(F.collect_list(entry).alias("results")).select(
        F.struct((F.col("number") % 6).cast("int").alias("num_fewshot")).alias("config"), "results",
        F.format_string("slim_%012d", "number").alias("result"),
    )
    second = events.groupBy((F.col("user_id") % 3).alias("a"), (F.col("user_id") % 7).alias("b")).agg(
        (F.max_by("value", "event_id") / 1000).alias("accuracy"), F.count("*").cast("double").alias("n")
    ).select(
        F.lit("set/last").alias("dataset_name"),
        F.col("a").cast("string").alias("dataset_config_name"),
        F.concat(F.lit("t"), F.col("b").cast("string")).alias("template_name"),
        F.struct("accuracy", "n").alias("evaluation"),
        F.format_string("one_%d_%d", "a", "b").alias("result"),
    )
    first.repartition("result").write.partitionBy("result").json(f"{path}/first/deep")
    first.limit(1).withColumn("result", F.lit("agg_all")).write.partitionBy("result").json(f"{path}/first/sums")
    second.repartition("result").write.partitionBy("result").json(f"{path}/second")
    found = evaluations.read_eval_json(spark, path, named_by="folder")
    return found.withColumn("value", F.round("value", 9))


@query("SELECT 'babi' AS task, round(avg(value) / 1000, 9) AS score FROM events GROUP BY user_id % 5")
def babi_files(spark, folder):
    """Exact-match scores out of one result file per model."""
    models = table(spark, folder, "events").groupBy((F.col("user_id") % 5).alias("model")).agg(F.avg("value").alias("mean"))
    score = F.struct(F.struct((F.col("mean") / 1000).alias("em")).alias("babi")).alias("results")
    path = _folder(spark)
    models.select("model", score).repartition("model").write.partitionBy("model").json(path)
    return evaluations.read_babi(spark, f"{path}/*").select("task", F.round("score", 9).alias("score"))


LOG_SQL = """WITH lines AS (SELECT 'r' || (user_id % 7) AS run, event_id, event_type || ' ' || event_id || ': ' || user_id AS value FROM events)
SELECT run, (row_number() OVER (PARTITION BY run ORDER BY event_id) - 1)::BIGINT AS line_no, value FROM lines"""


@query(LOG_SQL)
def log_files(spark, folder):
    """Log lines with their line numbers, from one file a run."""
    lines = table(spark, folder, "events").select(
        F.format_string("r%d", F.col("user_id") % 7).alias("run"), "event_id",
        F.format_string("%s %d: %d", "event_type", "event_id", "user_id").alias("value"),
    )
    path = _folder(spark)
    ordered = lines.repartition("run").sortWithinPartitions("run", "event_id")
    ordered.select("run", "value").write.partitionBy("run").text(path)
    found = logs.numbered_lines(logs.read_logs(spark, f"{path}/*/*", named_by="folder"))
    return found.select("run", "line_no", "value")


@query("SELECT 'r' || (user_id % 7) AS run, (user_id % 8)::INT AS rank, count(*)::BIGINT AS lines FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def log_ranks(spark, folder):
    """Lines per run and rank of the overflow lines, read from files."""
    path = _folder(spark)
    _lines(spark, folder).select("run", "value").write.partitionBy("run").text(path)
    found = logs.read_logs(spark, f"{path}/*/*", named_by="folder").filter(F.col("value").contains("Grad overflow"))
    return found.groupBy("run", "rank").agg(F.count("*").alias("lines"))
