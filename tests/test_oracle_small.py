"""Differential check against the DuckDB oracle on the smallest tables."""

import pytest

from tests.conftest import SF001
from tests.harness import compare, duck
from vitrine.plans.oracle import ORACLE
from vitrine.plans.registry import QUERIES

FAST = ["scan_interactions", "user_product_matrix", "popular_top8", "recommend_users", "recommend_users_orders",
        "catalog_enriched", "product_record", "catalog_filter", "tokens_clean", "doc_vectors", "similar_products",
        "llm_reply_parsed", "question_intent", "chat_answer", "call_gap_audit", "phrase_bigrams"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    info = compare(spark, con, name, QUERIES[name], ORACLE[name], SF001)
    assert info["ok"], info
