"""Plans that must hold at scale: pruned scans, one shuffle where one is enough, no Python on native paths."""

import re

import pytest

from folioflow.catalogue import QUERIES


def plan(spark, sf_dir, name):
    """The physical plan before adaptive execution changes it."""
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("nid_by_governorate", {"c_custkey"}),
        ("demo_parse", {"c_custkey"}),
        ("text_clean_common", {"doc_id", "text"}),
        ("img_scale_factor", {"p_partkey", "p_size"}),
        ("rate_limit", {"event_id", "ts", "user_id"}),
        ("cache_keys", {"p_partkey", "p_name", "p_brand", "p_size"}),
    ],
)
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan(spark, sf_dir, name))[1]
    assert {c.split(":")[0] for c in schema.split(",")} == columns


@pytest.mark.parametrize(
    ("name", "exchanges"),
    [("nid_decode", 0), ("mrz_td3", 0), ("text_language_detect", 0), ("route_document", 1), ("nid_by_governorate", 1), ("rate_limit", 2), ("ttl_cache_hits", 2), ("layout_text", 2), ("region_last_wins", 2), ("digit_string", 2)],  # of the last three, one numbers the input
)
def test_shuffles(spark, sf_dir, name, exchanges):
    assert len(re.findall(r"\bExchange hashpartitioning", plan(spark, sf_dir, name))) == exchanges


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("text_strip_accents", "text_postprocess", "img_steps", "pipeline_idp", "rate_limit", "ttl_cache_hits")))
def test_no_python_and_no_cross_joins(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert not re.search(r"ArrowEvalPython|MapInArrow|BatchEvalPython|CartesianProduct|BroadcastNestedLoopJoin", text)
