from __future__ import annotations

from pyspark.sql import functions as F

from guardrail_spark.operators import policies
from guardrail_spark.plans import QUERIES, policy_queries
from guardrail_spark.plans.views import view

SF = "/root/testdata/sf0.001"


def test_counts_of_all_requests_equal_the_rows_of_the_fan_out(spark):
    approved = policy_queries.pol(spark, SF).where("status = 'approved' and env = 'prod'")
    guards = policy_queries.grd(spark, SF).select("policy_key", "scenario", F.col("direction").alias("guard_direction"))
    rows = policies.fan_out(view(spark, SF, "guard_events").select("app", "env", "direction"), approved, guards)
    want = {tuple(r) for r in rows.groupBy("app", "policy_id", "scenario").count().collect()}
    assert want and {tuple(r) for r in QUERIES["j3_fan_out_all"](spark, SF).collect()} == want
