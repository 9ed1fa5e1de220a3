from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from guardrail_spark.operators import evidence, metrics, policies
from guardrail_spark.plans.views import view
from guardrail_spark.sources import records

SF = "/root/testdata/sf0.001"


def value(rng, depth):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.5:
            return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcdé\"[{,:") + str(i): value(rng, depth - 1) for i in range(rng.randrange(4))}
    return rng.choice([1, -2.5, True, None, "x", "a\n{b}", "q\"[,]:", "", 10**20])


def test_pretty_lines_and_what_differs(spark):
    rng = random.Random(2)
    docs = [({"k": value(rng, 4)}, {"k": value(rng, 4)}) for _ in range(60)]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(docs)] + [(100, None, '{"a":1}'), (101, "nope", None)]
    df = spark.createDataFrame(rows, "key long, older string, newer string")
    lines = lambda d: json.dumps(d, indent=2, sort_keys=True, ensure_ascii=False).split("\n")
    got = {r.key: r.l for r in df.select("key", policies.pretty_lines(F.col("older")).alias("l")).collect()}
    assert got == {i: lines(a) for i, (a, _) in enumerate(docs)} | {100: None, 101: None}
    want = [(100, "b", 1, "{"), (100, "b", 2, '  "a": 1'), (100, "b", 3, "}")]
    for i, (a, b) in enumerate(docs):
        for side, own, other in (("a", lines(a), set(lines(b))), ("b", lines(b), set(lines(a)))):
            want += [(i, side, n, x) for n, x in enumerate(own, 1) if x not in other]
    assert sorted(tuple(r) for r in policies.diff_documents(df).collect()) == sorted(want)


def test_a_store_has_each_batch_once_and_prunes(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = evidence.sequence_events(view(spark, SF, "guard_events"))
    for batch in ("a", "b", "a", "b"):
        records.store_events(rows.where((F.col("event_id").cast("bigint") % 2 == 0) == F.lit(batch == "a")), path, batch)
    assert spark.read.parquet(path).count() == rows.count()
    page = records.scan_stored(spark, path, "t1", "app2", since_seq=3, limit=10, since="2024-01-01")
    plan = page._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert all(c in filters for c in ("tenant", "app", "dt")) and "GreaterThan(chain_seq,3)" in filters
    assert [r.chain_seq for r in page.collect()] == list(range(4, 14))


def test_sketches_merge(spark):
    rng = random.Random(1)
    values = [rng.randrange(10_000) for _ in range(30_000)] + [None] * 10
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "day int, latency_ms long").withColumn("guard", F.lit("g"))
    days = metrics.latency_sketches(df, ["guard", "day"])
    assert days.count() == 7
    known = sorted(v for v in values if v is not None)
    for q in (0.05, 0.5, 0.95):
        (r,) = metrics.quantile_of_sketches(days, ["guard"], q).collect()
        below = sum(v < r.value for v in known) / len(known)
        assert r.n == len(known) and abs(below - q) < 0.02
