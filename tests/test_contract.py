"""The driver contract: names, columns and results at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "dense_batch_topk", "hybrid_rrf2", "eval_metrics", "stratified_sample", "window_scan", "upsert_latest", "chunk_documents", "rate_sliding_log",
    "metadata_windows", "metadata_search", "metadata_first_page", "semantic_filter", "bonus_null_topic", "upsert_sparse_maps", "resumed_collection",
    "keyword_log", "papers_with_abstract", "equation_search", "text_search_stop_words", "parse_fallback", "parsing_stats", "archive_includes", "prompt_build", "stream_ingest", "metadata_paged", "figure_files",
]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    problems, _ = compare(contract.queries()[name](spark, FOLDER), con, contract.oracle_sql()[name])
    assert problems == []
