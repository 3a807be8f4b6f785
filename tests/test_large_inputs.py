"""Joins of the letters' queries whose sides grow with the input are merged, whatever size a plan expects of them."""

import pytest

from maskwright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
MERGED = [
    "match_item_overlap",
    "detections",
    "apply_overrides",
    "upload_response",
    "included_summary",
    "pages_rasterised",
    "detection_id",
    "default_included",
    "preview_pct",
    "detection_source",
    "count_by_type",
    "count_by_page",
    "pages_left_zones",
    "pages_untouched",
    "zones_by_page",
    "sub_box_uniform",
    "union_boxes",
    "zone_pixels",
    "zones",
    "included_lookup",
    "sub_box_measured",
]


@pytest.mark.parametrize("name", MERGED)
def test_nothing_that_grows_is_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


EXECUTED = [
    "zones",
    "zone_pixels",
    "union_boxes",
    "sub_box_measured",
    "sub_box_uniform",
    "count_by_type",
    "detections",
    "preview_pct",
    "default_included",
    "detection_id",
    "detection_source",
    "count_by_page",
    "pages_untouched",
    "zones_by_page",
]


@pytest.mark.parametrize("name", EXECUTED)
def test_execution_keeps_the_merge(spark, name):
    rows = QUERIES[name](spark, SF)
    rows.collect()  # small inputs, so that adaptive execution would broadcast what it may
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
