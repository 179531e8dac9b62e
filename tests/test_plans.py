"""Physical plans: pruned scans, pushed filters, no shuffle for per-frame work, no cross joins."""

import pytest

from vocalgrid.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load_all()


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    read = [line for line in plan(spark, "pair_utterances").splitlines() if "ReadSchema" in line]
    assert read and all("text" not in line for line in read)
    assert "ReadSchema: struct<o_totalprice:double>" in plan(spark, "tier_counts")


@pytest.mark.parametrize(
    "name", ["geometric_features", "class_distribution", "tissue_mask", "vocal_tract_mask", "spatial_gaussian", "augment", "digitize"]
)
def test_frame_work_never_shuffles(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["histogram", "ecdf", "standardize", "shard_assign", "subject_split", "lag_join", "interp_asof"])
def test_no_cross_join(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_top_n_limits_groups_before_the_shuffle(spark):
    text = plan(spark, "top_n_per_subject")
    assert text.index("WindowGroupLimit") < text.index("Exchange") and "Partial" in text
