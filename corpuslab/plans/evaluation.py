"""Evaluation results, loss curves and training logs, derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import boxes, curves, profile, scores, trainlogs
from corpuslab.plans.registry import query, table
from corpuslab.session import materialize
from corpuslab.sources.evaluations import HARNESS_SCHEMA, TEMPLATE_SCHEMA

# ------------------------------------------------------------ result files
# Every event stands for one result file. Errors are files of the second kind.


def _merged(spark, folder):
    events = table(spark, folder, "events").withColumn("file", F.format_string("%012d", "event_id"))
    pair = F.element_at(F.array(*[F.lit(p) for p in ("en-fr", "fr-en", "hi-en", "plain")]), (F.col("user_id") % 4 + 1).cast("int"))
    prompt = F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string"), F.lit(" "), pair)
    metric = F.when(F.col("event_type") == "purchase", "rouge2_fmeasure").otherwise("acc")
    value = F.col("value") / 1000
    entry = F.struct(
        F.concat(F.lit("set/"), "event_type").alias("task_name"),
        prompt.alias("prompt_name"),
        F.when(metric == "rouge2_fmeasure", value).alias("rouge2_fmeasure"),
        F.when(metric == "acc", value).alias("acc"),
        F.lit(0.5).alias("acc_stderr"),
        # Texts and truth values are no metrics.
        F.lit("0.7").alias("note"),
        F.lit(True).alias("greedy"),
    )
    first = events.filter("event_type <> 'error'").select(
        "file",
        F.to_json(
            F.struct(
                F.struct((F.col("user_id") % 6).cast("int").alias("num_fewshot")).alias("config"),
                F.array(entry).alias("results"),
            )
        ).alias("body"),
    )
    second = events.filter("event_type = 'error'").select(
        "file",
        F.to_json(
            F.struct(
                F.lit("set/error").alias("dataset_name"),
                (F.col("user_id") % 3).cast("string").alias("dataset_config_name"),
                F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("template_name"),
                F.create_map(F.lit("accuracy"), F.col("value") / 1000).alias("evaluation"),
            )
        ).alias("body"),
    )
    harness = first.select("file", F.from_json("body", HARNESS_SCHEMA).alias("r")).select("file", "r.*")
    template = second.select("file", F.from_json("body", TEMPLATE_SCHEMA).alias("r")).select("file", "r.*")
    return scores.merge_results(scores.flatten_harness(harness), scores.flatten_template(template))


MERGED_SQL = """
named AS (SELECT event_id, value / 1000 AS v, user_id, event_type,
            ['en-fr', 'fr-en', 'hi-en', 'plain'][(user_id % 4 + 1)::INT] AS pair FROM events),
flat AS (
  SELECT event_id, 'set/' || event_type || CASE WHEN pair = 'plain' THEN '' ELSE '_' || pair END AS dataset,
    (user_id % 6)::INT AS fewshots, 'p' || (user_id % 10) || ' ' || pair AS prompt,
    CASE WHEN event_type = 'purchase' THEN 'rouge2_fmeasure' ELSE 'acc' END AS metric, v AS value
  FROM named WHERE event_type <> 'error'
  UNION ALL SELECT event_id, 'set/' || event_type || CASE WHEN pair = 'plain' THEN '' ELSE '_' || pair END,
    (user_id % 6)::INT, 'p' || (user_id % 10) || ' ' || pair, 'acc_stderr', 0.5 FROM named WHERE event_type <> 'error'
  UNION ALL SELECT event_id, 'set/error_' || (user_id % 3), 0, 't' || (user_id % 7), 'evaluation.accuracy', v
  FROM named WHERE event_type = 'error'),
merged AS (SELECT dataset, fewshots, prompt, metric, arg_max(value, event_id) AS value FROM flat GROUP BY ALL)
"""
DETAIL_SQL = MERGED_SQL + """,
detail AS (SELECT split_part(dataset, '/', 2) AS dataset, fewshots, prompt, replace(metric, 'evaluation.', '') AS metric, value
           FROM merged WHERE metric <> 'acc_stderr'),
medians AS (SELECT dataset, fewshots,
              CASE WHEN min(metric) LIKE 'acc%' THEN 'accuracy' ELSE 'rouge2_fmeasure' END AS metric, median(value) AS value
            FROM detail GROUP BY dataset, fewshots)
"""


@query("WITH " + MERGED_SQL + "SELECT dataset, fewshots, prompt, metric, round(value, 9) AS value FROM merged")
def merged_results(spark, folder):
    """All result files flattened and merged, the last file winning."""
    return _merged(spark, folder).withColumn("value", F.round("value", 9))


@query(
    "WITH " + DETAIL_SQL
    + """SELECT dataset, fewshots, prompt, metric, round(value, 9) AS value FROM detail
    UNION ALL SELECT dataset, fewshots, 'median', metric, round(value, 9) FROM medians
    UNION ALL SELECT m.dataset, max(m.fewshots), 'average', 'multiple', round(avg(m.value), 9) FROM medians m GROUP BY m.dataset"""
)
def score_table(spark, folder):
    """Detail rows with medians per shot and the average of the medians."""
    detail = materialize(scores.pick_metrics(_merged(spark, folder)))
    return scores.ordered_scores(scores.score_table(detail)).withColumn("value", F.round("value", 9))


# ------------------------------------------------------------- score tables

# Stand-in baselines for the event types.
EVENT_BASELINES = {"click": 0.25, "error": 0.5, "signup": 1 / 3, "view": 0.5}


def _rank(spark, folder):
    """Mean value per model, shot and task; users stand for models and seeds."""
    seed = F.col("user_id") % 5
    name = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    model = F.when(seed == 0, name).otherwise(F.concat(name, F.lit("seed"), seed.cast("string")))
    return (
        table(spark, folder, "events")
        .groupBy(model.alias("model"), (F.col("event_id") % 6).cast("int").alias("shot"), F.col("event_type").alias("task"))
        .agg((F.avg("value") / 1000).alias("value"))
        .withColumn("metric", F.lit("acc"))
    )


def _scores(spark, folder):
    rank = _rank(spark, folder)
    base = spark.createDataFrame(list(EVENT_BASELINES.items()), "task string, baseline double")
    generated = rank.filter("task = 'purchase'").select(
        "model", F.col("task").alias("dataset"), F.col("shot").alias("fewshots"), F.lit("p").alias("prompt"), "value"
    )
    return scores.normalize_scores(rank.filter("task <> 'purchase'"), generated, base)


SCORES_SQL = """
rank AS (SELECT 'm' || (user_id % 3) || CASE WHEN user_id % 5 = 0 THEN '' ELSE 'seed' || (user_id % 5) END AS model,
           'm' || (user_id % 3) AS base, (user_id % 5)::INT AS seed, (event_id % 6)::INT AS shot, event_type AS task,
           avg(value) / 1000 AS value FROM events GROUP BY ALL),
lines AS (SELECT * FROM (VALUES ('click', 0.25::DOUBLE), ('error', 0.5), ('signup', 1.0::DOUBLE / 3), ('view', 0.5), ('purchase', 0.0)) AS v(task, b)),
scores AS (SELECT model, base, seed, shot, task, (value - b) / (1 - b) AS score FROM rank JOIN lines USING (task)),
per_task AS (SELECT base, seed, task, avg(score) AS score FROM scores GROUP BY base, seed, task HAVING count(DISTINCT shot) = 6),
overall AS (SELECT base, seed, avg(score) AS score FROM scores GROUP BY base, seed),
cells AS (SELECT base, task, avg(score) AS mean, stddev_pop(score) AS std, count(*)::BIGINT AS seeds FROM per_task GROUP BY base, task
          UNION ALL SELECT base, 'Average', avg(score), stddev_pop(score), count(*)::BIGINT FROM overall GROUP BY base)
"""


@query("WITH " + SCORES_SQL + "SELECT model, shot, task, round(score, 9) AS score FROM scores")
def normalized_scores(spark, folder):
    """Scores rescaled so that random guessing is zero."""
    return _scores(spark, folder).withColumn("score", F.round("score", 9))


@query(
    "WITH " + SCORES_SQL
    + "SELECT base, task, round(mean, 9) AS mean, round(std, 9) AS std, seeds FROM cells WHERE task <> 'Average'"
)
def seed_stats(spark, folder):
    """Mean over shots, then mean and deviation over seeds."""
    found = scores.over_seeds(scores.seed_family(scores.mean_over_shots(_scores(spark, folder))))
    return found.select("base", "task", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "seeds")


@query(
    "WITH " + SCORES_SQL
    + """SELECT task, max(c) FILTER (base = 'm0') AS m0, max(c) FILTER (base = 'm1') AS m1, max(c) FILTER (base = 'm2') AS m2
    FROM (SELECT base, task, round(mean * 100, 1)::VARCHAR || ' ± ' || round(std * 100, 1)::VARCHAR AS c FROM cells) GROUP BY task"""
)
def score_matrix(spark, folder):
    """Wide table of tasks and models with an average row."""
    return scores.score_matrix(materialize(_scores(spark, folder)), ["m0", "m1", "m2"])


@query(
    "WITH " + SCORES_SQL
    + """SELECT model, shot, task, round(score, 9) AS score FROM scores
    UNION ALL SELECT DISTINCT model, shot, t, 0.0 FROM scores s, (VALUES ('babi'), ('view')) AS v(t)
    WHERE NOT EXISTS (SELECT 1 FROM scores o WHERE o.model = s.model AND o.shot = s.shot AND o.task = t)"""
)
def filled_scores(spark, folder):
    """A missing task counted as zero."""
    return scores.fill_missing(materialize(_scores(spark, folder)), {"babi": 0.0, "view": 0.0}).withColumn(
        "score", F.round("score", 9)
    )


@query(
    "WITH " + SCORES_SQL
    + """SELECT model, shot, count(DISTINCT task)::BIGINT AS tasks FROM scores WHERE shot <> 3 OR task <> 'view'
    GROUP BY model, shot HAVING count(DISTINCT task) <> 5"""
)
def incomplete_models(spark, folder):
    """Models and shots that do not have all five tasks: here those that were not viewed with three shots."""
    return scores.check_complete(_scores(spark, folder).filter("shot <> 3 or task <> 'view'"), 5)


@query(
    "WITH " + SCORES_SQL
    + """, per_model AS (SELECT base, seed, model, avg(score) AS score FROM scores GROUP BY ALL)
    SELECT CASE WHEN base = 'm0' THEN 'repeat' ELSE 'code' END AS strategy,
      round((seed + 1) * 8.4e9 / 84e9 * 100, 6) AS budget_pct, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std,
      count(*)::BIGINT AS models FROM per_model GROUP BY 1, seed"""
)
def strategy_series(spark, folder):
    """Mean score against the data budget, per strategy."""
    found = materialize(_scores(spark, folder))
    facts = scores.seed_family(found.select("model").distinct()).select(
        "model",
        F.when(F.col("base") == "m0", "repeat").otherwise("code").alias("strategy"),
        ((F.col("seed") + 1) * 8.4e9).alias("tokens"),
    )
    series = scores.strategy_series(found, facts)
    return series.select(
        "strategy",
        F.round("budget_pct", 6).alias("budget_pct"),
        F.round("mean", 9).alias("mean"),
        F.round("std", 9).alias("std"),
        "models",
    )


@query(
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m,
      quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag),
    j AS (SELECT *, l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1) AS ok FROM lineitem JOIN q USING (l_returnflag))
    SELECT l_returnflag, round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3,
      min(l_extendedprice) FILTER (ok) AS low, max(l_extendedprice) FILTER (ok) AS high,
      count(*) FILTER (NOT ok)::BIGINT AS outliers, count(*)::BIGINT AS n FROM j GROUP BY l_returnflag"""
)
def box_stats(spark, folder):
    found = boxes.box_stats(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return found.select(
        "l_returnflag", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "low", "high", "outliers", "n"
    )


# ------------------------------------------------------------- loss curves


@query(
    """WITH RECURSIVE p AS (SELECT user_id, event_id, ln(value + 1) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    s AS (SELECT user_id, event_id, i, value * 0.85::DOUBLE + (1 - 0.85::DOUBLE) * value AS smoothed FROM p WHERE i = 1
          UNION ALL SELECT p.user_id, p.event_id, p.i, s.smoothed * 0.85::DOUBLE + (1 - 0.85::DOUBLE) * p.value FROM s JOIN p ON p.user_id = s.user_id AND p.i = s.i + 1)
    SELECT user_id, event_id, round(smoothed, 6) AS smoothed FROM s"""
)
def smooth_curves(spark, folder):
    """Exponential smoothing of every user's (log) values in the order of events."""
    logs = table(spark, folder, "events").withColumn("value", F.log(F.col("value") + 1))
    found = curves.ema(logs, ["user_id"], "event_id", "value", 0.85)
    return found.select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query(
    """SELECT user_id, event_id, round(value / first_value(value) OVER (PARTITION BY user_id ORDER BY event_id), 9) AS relative
    FROM events"""
)
def relative_curves(spark, folder):
    found = profile.relative_to_first(table(spark, folder, "events"), ["user_id"], "event_id", "value")
    return found.select("user_id", "event_id", F.round("relative", 9).alias("relative"))


@query("SELECT event_type, min(value) AS min_loss FROM events GROUP BY event_type")
def min_loss(spark, folder):
    return curves.min_loss(table(spark, folder, "events"), ["event_type"])


@query(
    """WITH t AS (SELECT user_id, event_id, value,
      CASE WHEN event_type = 'click' THEN 'lm-loss-training/lm loss vs tokens'
           WHEN event_type = 'view' THEN 'lm-loss-validation/validation_oscar/lm loss validation vs tokens'
           ELSE 'lm-loss-validation/validation/lm loss validation vs tokens' END AS tag FROM events)
    SELECT user_id, event_id, value FROM t WHERE tag = 'lm-loss-validation/validation_oscar/lm loss validation vs tokens'"""
)
def selected_curves(spark, folder):
    """The validation curve of one corpus out of all logged curves."""
    tag = (
        F.when(F.col("event_type") == "click", curves.curve_tag("training"))
        .when(F.col("event_type") == "view", curves.curve_tag("validation", "oscar"))
        .otherwise(curves.curve_tag("validation"))
    )
    tagged = table(spark, folder, "events").select("user_id", "event_id", "value", tag.alias("tag"))
    return curves.select_curve(tagged, "validation", "oscar").drop("tag")


@query(
    """WITH r AS (SELECT event_id, event_type || user_id AS run FROM events),
    l AS (SELECT * FROM (VALUES ('click', 'a'), ('click1', 'b'), ('click12', 'c'), ('view', 'd'), ('sign', 'e')) AS v(prefix, label))
    SELECT event_id, run, arg_max(label, length(prefix)) AS label FROM r LEFT JOIN l ON starts_with(run, prefix) GROUP BY event_id, run"""
)
def labelled_runs(spark, folder):
    """Strategy labels by the longest matching prefix of the run name."""
    rows = [("click", "a"), ("click1", "b"), ("click12", "c"), ("view", "d"), ("sign", "e")]
    labels = spark.createDataFrame(rows, "prefix string, label string")
    runs = table(spark, folder, "events").select(
        "event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("run")
    )
    return curves.label_runs(runs, labels).select("event_id", "run", "label")


@query(
    """WITH o AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
    s AS (SELECT *, max(CASE WHEN value >= best THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS stalled FROM o)
    SELECT user_id, event_id, value FROM s WHERE stalled = 0"""
)
def improving_curves(spark, folder):
    """Every user's values up to the first that does not improve."""
    found = curves.improving_prefix(table(spark, folder, "events"), "event_id", "value", ["user_id"])
    return found.select("user_id", "event_id", "value")


@query(
    """WITH n AS (SELECT user_id, event_id, value, lag(value) OVER w AS p, lead(value) OVER w AS f FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, value, CASE WHEN value > p THEN 'peak' ELSE 'valley' END AS kind FROM n
    WHERE (value > p AND value > f) OR (value < p AND value < f)"""
)
def turning_points(spark, folder):
    """Where every user's values stop rising or falling."""
    return curves.turning_points(table(spark, folder, "events"), ["user_id"], "event_id", "value")


# ------------------------------------------------------------------- logs
# Every event writes one log line; its type decides which kind.


def _lines(spark, folder, iterations: int | None = None):
    """``iterations``: runs start anew after so many events."""
    number = F.col("event_id") if iterations is None else F.col("event_id") % iterations
    loss = F.when(F.col("user_id") % 2 == 0, F.format_string(" lm loss: %.6E |", "value")).otherwise("")
    iteration = F.format_string(
        "0:  iteration %8d/  148693 | consumed samples: %12d | consumed tokens: %12d | "
        "elapsed time per iteration (s): %.2f | learning rate: 1.449E-04 | global batch size:   128 |%s "
        "loss scale: 1.0 | grad norm: 2.698 | num zeros: 0.0 | number of skipped iterations:   0 | "
        "number of nan iterations:   0 | samples per second: %.3f | TFLOPs: 31.35 |",
        number, F.col("event_id") * 128, F.col("event_id") * 262144, F.col("value"), loss, F.col("value") / 10,
    )
    valid = F.format_string(
        "0: valid loss at iteration %d | lm loss value: %.6E | lm loss PPL: %.6E | ", "event_id", "value", F.col("value") * 2
    )
    overflow = F.format_string("%d: [INFO] Grad overflow on iteration: %d", F.col("user_id") % 8, F.floor(F.col("event_id") / 50))
    argument = F.format_string("0:   option_%d ........................ %d", F.col("user_id") % 13, F.floor(F.col("user_id") / 40))
    failure = F.when(F.col("user_id") % 3 == 0, F.format_string("%d: Segmentation fault in step %d", "user_id", "event_id")).otherwise(
        F.format_string("rank %d: Failed to initialize RSMI device mutex", "user_id")
    )
    value = (
        F.when(F.col("event_type") == "click", iteration)
        .when(F.col("event_type") == "view", valid)
        .when(F.col("event_type") == "purchase", overflow)
        .when(F.col("event_type") == "signup", argument)
        .otherwise(failure)
    )
    run = F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string"))
    return table(spark, folder, "events").select(run.alias("run"), F.col("event_id").alias("line"), value.alias("value"))


RECORDS_SQL = """WITH records AS (SELECT 'r' || (user_id % 7) AS run, event_id AS iteration, 148693::BIGINT AS planned, event_id * 128 AS samples,
    event_id * 262144 AS tokens, value AS seconds, 1.449e-4::DOUBLE AS learning_rate, 128::BIGINT AS batch_size,
    CASE WHEN user_id % 2 = 0 THEN value END AS lm_loss, round(value / 10, 3) AS samples_per_second, 31.35::DOUBLE AS tflops
    FROM events WHERE event_type = 'click')
"""


@query(
    RECORDS_SQL + """SELECT *, 1.0::DOUBLE AS loss_scale, 2.698::DOUBLE AS grad_norm, 0::BIGINT AS skipped, 0::BIGINT AS nan
    FROM records"""
)
def iteration_records(spark, folder):
    """Typed records of the iteration lines."""
    return trainlogs.iteration_records(_lines(spark, folder)).drop("line")


@query(
    """SELECT 'r' || (user_id % 7) AS run, event_id AS iteration, value AS lm_loss, round(value * 2, 6) AS ppl
    FROM events WHERE event_type = 'view'"""
)
def validation_records(spark, folder):
    return trainlogs.validation_records(_lines(spark, folder)).withColumn("ppl", F.round("ppl", 6))


@query("SELECT DISTINCT 'r' || (user_id % 7) AS run, (event_id // 50)::BIGINT AS iteration FROM events WHERE event_type = 'purchase'")
def overflow_events(spark, folder):
    return trainlogs.overflow_events(_lines(spark, folder))


@query(
    """WITH a AS (SELECT DISTINCT 'r' || (user_id % 7) AS run, 'option_' || (user_id % 13) AS argument, (user_id // 40)::VARCHAR AS setting
      FROM events WHERE event_type = 'signup'),
    v AS (SELECT argument FROM a GROUP BY argument HAVING min(setting) <> max(setting)
          OR count(DISTINCT run) < (SELECT count(DISTINCT run) FROM a))
    SELECT argument, setting, count(*)::BIGINT AS runs FROM a WHERE argument IN (SELECT argument FROM v) GROUP BY argument, setting"""
)
def argument_differences(spark, folder):
    """Arguments that differ between runs."""
    return trainlogs.diff_arguments(materialize(trainlogs.run_arguments(_lines(spark, folder))))


@query(
    """SELECT printf('nid%06d', user_id) AS node, user_id::INT AS rank, user_id || ': Segmentation fault in step ' || event_id AS line
    FROM events WHERE event_type = 'error' AND user_id % 3 = 0"""
)
def error_nodes(spark, folder):
    """Nodes that failed, looked up by the rank at the head of the line."""
    launches = table(spark, folder, "events").select("user_id").distinct().select(
        F.format_string("0: Launching on nid%06d (%d/150), master", "user_id", "user_id").alias("value")
    )
    return trainlogs.error_nodes(_lines(spark, folder), launches)


@query(
    """SELECT 'r' || (user_id % 7) AS run, 'rank ' || user_id || ': Failed to initialize RSMI device mutex' AS value
    FROM events WHERE event_type = 'error' AND user_id % 3 <> 0"""
)
def unranked_errors(spark, folder):
    return trainlogs.unranked_errors(_lines(spark, folder)).drop("line")


@query(
    RECORDS_SQL
    + """, s AS (SELECT run, max(iteration) AS last_iteration, arg_max(lm_loss, iteration) FILTER (lm_loss IS NOT NULL) AS best_known,
      min(lm_loss) AS best_loss, avg(samples_per_second) AS speed FROM records GROUP BY run)
    SELECT run, last_iteration, best_known AS last_loss, best_loss, 31.35::DOUBLE AS tflops, round(speed, 6) AS samples_per_second,
      round(100.0 * speed / (SELECT speed FROM s WHERE run = 'r0'), 6) AS percent_of_base FROM s"""
)
def relative_throughput(spark, folder):
    """Speed of every run in percent of a base run."""
    summary = materialize(trainlogs.throughput(trainlogs.iteration_records(_lines(spark, folder))))
    found = trainlogs.relative_throughput(summary, "r0")
    return found.select(
        "run",
        "last_iteration",
        "last_loss",
        "best_loss",
        F.round("tflops", 6).alias("tflops"),
        F.round("samples_per_second", 6).alias("samples_per_second"),
        F.round("percent_of_base", 6).alias("percent_of_base"),
    )


@query(
    """WITH lines AS (SELECT 'r' || (user_id % 7) AS run, event_id AS line, event_id % 500 AS iteration, event_id * 262144 AS tokens,
      CASE WHEN user_id % 2 = 0 THEN value END AS lm_loss, round(value / 10, 3) AS speed FROM events WHERE event_type = 'click'),
    steps AS (SELECT *, lag(iteration) OVER (PARTITION BY run ORDER BY line) AS p FROM lines),
    starts AS (SELECT run, count(*) FILTER (iteration <= p)::BIGINT AS restarts FROM steps GROUP BY run),
    kept AS (SELECT run, iteration, arg_max(struct_pack(l := lm_loss, s := speed), line) AS r FROM lines GROUP BY run, iteration),
    known AS (SELECT run, iteration, r.l AS loss, r.s AS speed FROM kept),
    ends AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY iteration DESC) AS back FROM known WHERE loss IS NOT NULL),
    tails AS (SELECT run, max(loss) - min(loss) AS spread FROM ends WHERE back <= 10 GROUP BY run),
    whole AS (SELECT run, count(*)::BIGINT AS iterations, max(iteration) AS last_iteration, arg_max(loss, iteration) AS last_loss,
      min(loss) AS best_loss, avg(speed) AS speed FROM known GROUP BY run)
    SELECT run, iterations, restarts, last_iteration, last_loss, best_loss, round(speed, 6) AS samples_per_second,
      round(spread, 6) AS tail_spread, spread > 350 OR last_loss - best_loss > 350 AS blown_up
    FROM whole JOIN starts USING (run) LEFT JOIN tails USING (run)"""
)
def run_summary(spark, folder):
    """Runs that start anew now and then, with what their last iterations say."""
    records = materialize(trainlogs.iteration_records(_lines(spark, folder, 500)))
    found = trainlogs.run_summary(records, ["line"], tail=10, limit=350.0)
    return found.select(
        "run", "iterations", "restarts", "last_iteration", "last_loss", "best_loss",
        F.round("samples_per_second", 6).alias("samples_per_second"), F.round("tail_spread", 6).alias("tail_spread"), "blown_up",
    )
