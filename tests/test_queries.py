"""Registered queries against their SQL on the small tables.

The default run takes a cross-section; CLAUSESPARK_ALL=1 takes every query.
"""

import os

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck

SAMPLE = (
    "clean_text stem_tokens query_terms exact_refs numeric_score intent query_gates knn_topk lexical_retrieve rrf near_dup clause_candidates "
    "row_candidates final_order confidence verified_upsert fifo_pairs filter_tree dashboard draft_dedupe job_ledger clauses table_numbers eval_summary"
).split()


@pytest.fixture(scope="session")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("CLAUSESPARK_ALL") else SAMPLE)
def test_query(spark, con, small, name):
    line = compare(spark, con, small, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert line.startswith(("ok", "ROWS")), line


def test_entry(spark):
    assert entry.entry(spark).count() == 1
