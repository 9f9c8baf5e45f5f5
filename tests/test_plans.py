"""Shapes of the physical plans: what must hold at any size of the tables."""

import pytest

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.001"
def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [
    ("dlq_redacted", {"event_id", "user_id"}),
    ("rate_limit_remaining", {"event_id", "user_id", "ts"}),
    ("mask_pii", {"doc_id", "text"}),
])
def test_only_needed_columns_are_read(spark, name, columns):
    plan = plan_of(driver.queries()[name](spark, SF_DIR))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {f.split(":")[0] for f in schema.split(",")} == columns


def test_dedup_and_attribution_shuffle_once_each(spark):
    plan = plan_of(driver.queries()["enriched_events"](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan") == 1


def test_cubes_expand_groups_not_events(spark):
    plan = plan_of(driver.queries()["star_cube_placement"](spark, SF_DIR))
    # reading from the bottom: aggregate at the finest grain, shuffle, only then expand
    assert plan.index("Expand") < plan.rindex("HashAggregate(keys=[tenant_id")
