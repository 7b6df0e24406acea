"""Quick queries against their SQL. ``python tests/oracle.py`` runs all of them."""

import pytest
from oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "dup_ranges length_stats domain_counts blindspots normalize_text segments ratio_subsets mixture_lines "
    "merged_results seed_stats iteration_records parsed_runs law_predict objective_grid "
    "near_duplicates occurrence_positions count_occurrences assign_document improving_curves turning_points "
    "run_summary smooth_curves labelled_runs ppl_thresholds subset_fits result_files log_files jsonl_documents "
    "curve_files clusters_of_documents repetition_contents lookup_windows choose_passage plan_runs"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, con, name):
    assert difference(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


def test_all_sentences_are_counted(spark, con):
    got = queries()["count_all_occurrences"](spark, FOLDER)
    assert difference(got, con, oracle_sql()["count_all_occurrences"]) is None
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    sentences = {part for item in items for part in item.text.split(". ")} - {""}
    counted = {row["query"] for row in got.select("query").collect()}
    assert counted == sentences and any(len(part) < 20 for part in counted)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
