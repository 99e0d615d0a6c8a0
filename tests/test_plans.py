"""Plans of the registered queries: no cross joins, pruned scans, no single-task windows on data."""

import pytest

from querywarden.plans.catalog import QUERIES

# these run jobs while they are built, their result only reads what was written
EAGER = {"paginate_deep", "index_stats_incremental", "reuse_within_ttl_exact", "reuse_within_ttl_exact_short", "stream_dedup_ttl", "stream_incremental_upsert", "stream_provider_health", "push_event_route_stream", "source_tree_scan", "source_tree_stream", "file_scan_pipeline", "ddl_export_load", "ddl_export", "ddl_directory_load"}


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    plan = plan_of(QUERIES["batch_page"](spark, sf_dir))
    assert "html" not in plan and "TakeOrderedAndProject" in plan
    plan = plan_of(QUERIES["handle_status_apply"](spark, sf_dir))
    assert "l_extendedprice" not in plan.split("Physical Plan")[-1]


@pytest.mark.parametrize("name", ["analysis_budget", "retrieve_context"])
def test_top_n_ranks_salted_parts_first(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["first_occurrence_dedup", "latest_analysis", "file_last_author", "handle_status_apply"])
def test_pick_one_is_combined_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir)).split("Physical Plan")[-1]
    assert "Window" not in plan and ("partial_m" in plan)
