"""Queries against their SQL oracles on the smallest tables.

All of them run when RISKLOOM_ALL is set; a plain run takes one per area.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracle.sql import ORACLES
from riskloom.plans.catalog import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "pages_to_docs", "case_upsert", "page_main_container", "pii_redact", "pii_scan", "phrase_hits_join", "similar_topk_partitioned",
    "rule_score", "hash_embed", "dense_topk", "validate_cases", "hash_bucket", "detect_calls", "detect_json", "similar_documents", "risk_escalation_partitioned", "page_text_coalesce", "judge_scores", "ingest_cases", "stream_windows", "table_windows", "stream_windows_panes", "src_articles_order",
]
NAMES = sorted(ORACLES) if os.environ.get("RISKLOOM_ALL") else SOME


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def normal(table):
    names = sorted(table.column_names)
    rows = [tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r.values()) for r in table.select(names).to_pylist()]
    return names, sorted(rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, data, duck, name):
    got = entry.queries()[name](spark, data).toArrow()
    assert normal(got) == normal(duck.sql(ORACLES[name]).to_arrow_table())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
