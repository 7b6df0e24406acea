"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslab.plans import QUERIES  # noqa: E402
from corpuslab.session import build_session, shared_folder  # noqa: E402

HEADLINE = (
    "dup_ranges repetitions two_tier_filter lookup_flags normalize_text segments "
    "query_windows ngram_counts document_perplexity length_percentiles ratio_subsets "
    "repeat_budget mixture_series pack_sequences blindspots score_table score_matrix box_stats "
    "smooth_curves iteration_records parsed_runs law_goodness allocation frontier objective_grid "
    "dup_by_source ppl_mid dup_info clusters repetition_members passage_perplexity assign_document "
    "count_occurrences compare_allocation plan_runs near_duplicates occurrence_positions ppl_thresholds "
    "turning_points run_summary subset_fits log_files"
).split()


def in_files(spark, folder: str, files: int) -> str:
    """The tables dealt over several files each, as a cluster would hold them.

    The given ones have a single row group each, which a single task reads.
    """
    made = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{folder}/{name}").repartition(files).write.parquet(f"{made}/{name}")
    return made


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Dealing the tables is part of the total, under a name of its own.
    started = time.perf_counter()
    given, folder = folder, in_files(spark, folder, int(cpus))
    dealt = round(time.perf_counter() - started, 3)
    # Start the Python workers and the code generator before timing.
    QUERIES["total_bytes"](spark, folder).collect()
    spark.range(100).mapInArrow(lambda batches: batches, "id bigint").count()
    seconds = {"deal_tables": dealt}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": given.rsplit("sf", 1)[-1], "files_per_table": int(cpus)}))


if __name__ == "__main__":
    main()
