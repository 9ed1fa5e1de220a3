from __future__ import annotations

from pyspark.sql import functions as F

from guardrail_spark.operators import actions, detection, policies
from guardrail_spark.sources import shared


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_side_gives_the_same_in_parts(spark, monkeypatch):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("app"), F.lit("e").alias("env"))
    known = rows.where("id % 5 < 2").select("app", "env").distinct().withColumn("x", F.length("app"))
    for how in ("inner", "left"):
        small = shared.meet(rows, known, ["app", "env"], known.count(), how)
        assert "BroadcastHashJoin" in plan_of(small)
        with monkeypatch.context() as m:
            m.setattr(shared, "MOST_BROADCAST", 10)
            large = shared.meet(rows, known, ["app", "env"], known.count(), how)
        assert small.columns == large.columns and sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    parts = large.groupBy("app").agg(F.count_distinct(F.pmod(F.xxhash64("id", "app", "env"), F.lit(shared.SALTS))).alias("n"))
    assert parts.where("app = 'hot'").first().n == shared.SALTS


def test_few_guards_shuffle_no_request(spark):
    doc = '{"metadata":{"id":"p","version":"1.0.0"},"spec":{"applies_to":{"apps":["a"],"environments":["prod"]},"guards":[{"id":"g-1","scenario":"pii","detector":"pii-regex@1.0.0","direction":["input"],"on_fail":"redact"}]}}'
    plan = policies.guard_plan(spark.createDataFrame([(doc,)], "document string")).cache()
    plan.count()
    requests = spark.createDataFrame([("r", "a", "prod", "input", "me@example.org"), ("s", "b", "prod", "input", "me@example.org")], "request_id string, app string, env string, direction string, text string")
    out = actions.check(requests, plan, detection.scan, ["request_id"])
    assert {r.request_id: r.mutated for r in out.collect()} == {"r": "[EMAIL]", "s": None} or {r.request_id: r.mutated is None for r in out.collect()} == {"r": False, "s": True}
    text = plan_of(out)
    requests_side = text[: text.index("InMemoryTableScan")] if "InMemoryTableScan" in text else text
    assert "SortMergeJoin" not in requests_side
