"""Plans of the registered queries: no cross joins, narrow folds, one exchange per table."""

import pytest

from __spark_entry__ import queries
from conftest import SMALL

PLAIN = [
    "meta_join_modality",
    "three_way_fusion_join",
    "missing_modality_rows",
    "orders_fused",
    "lodo_split",
    "class_weights",
    "minibatch_counts",
    "confusion_matrix",
    "confusion_mean_std",
    "linear_layer_join",
    "dynamic_fusion_logits",
    "tcp_running_stats",
    "tcp_threshold_shares",
    "nearest_upsample",
    "focal_sum",
    "attention_weights",
    "cross_attention",
    "co_attention",
    "outer_product_fusion",
    "survival_curve",
    "knn_neighbours",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_aligned_tables_are_shuffled_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(queries()["sample_aligned"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("Exchange hashpartitioning") == 4


def test_expanding_folds_adds_no_exchange(spark):
    plan = plan_of(queries()["lodo_split"](spark, SMALL))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_scan_reads_only_the_needed_columns(spark):
    plan = plan_of(queries()["confusion_matrix"](spark, SMALL))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


@pytest.mark.parametrize("name", ["dedup_keep_first", "modality_width"])
def test_raw_rows_are_not_shuffled(spark, name):
    assert "REPARTITION" not in plan_of(queries()[name](spark, SMALL))
