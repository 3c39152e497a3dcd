"""Plan shapes that have to hold when one key owns a third of the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import changes, joins
from ledgerloom.operators.skew import splittable_join


@pytest.fixture
def small_skew_limits(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_left_key_is_split_although_the_right_side_is_aggregated(spark, small_skew_limits):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id") % 500))
    left = spark.range(0, 60000, 1, 8).select("id", hot.alias("name"), F.lit(1).alias("company_id"))
    right = left.groupBy("company_id", "name").agg(F.count("*").alias("n"))
    joined = splittable_join(left, right, ["company_id", "name"])
    assert "skew=true" in _plan(joined)
    assert joined.count() == 60000


def test_sender_rules_split_a_hot_sender(spark, small_skew_limits):
    address = F.when(F.col("id") % 3 == 0, F.lit("hot@spam.net")).otherwise(
        F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@x.org")))
    mail = spark.range(0, 60000, 1, 8).select(F.col("id").alias("message_id"), F.lit(1).alias("account_id"),
                                              address.alias("from_address"))
    rules = spark.createDataFrame([(1, "hot@spam.net", "deny"), (1, "y.org", "allow")],
                                  "account_id INT, pattern STRING, action STRING")
    judged = joins.sender_verdicts(mail, rules)
    assert "skew=true" in _plan(judged)
    assert judged.where("verdict = 'deny'").count() == 20000


def test_a_group_of_copies_is_combined_before_the_shuffle(spark, tables):
    plan = _plan(changes.exact_duplicates(tables.v_upload))
    assert "partial_min" in plan and "partial_count" in plan
    plan = _plan(joins.new_scans_only(tables.v_upload, tables.v_upload))
    assert plan.count("partial_") >= 2


def test_no_query_has_a_cross_join(spark, tables):
    import __spark_entry__  # noqa: F401 - registers the plans
    from ledgerloom.plans.catalog import PLANS, runnable
    from tests.conftest import SMALL

    for key, plan in PLANS.items():
        if key[0] == "S" or key in ("K01_intake_stream", "K05_cursor_commit", "K07_monthly_revenue_stream", "R08_report_history"):
            continue  # these run streams while they are built
        text = runnable(plan)(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key
