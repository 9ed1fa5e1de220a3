"""What larger tables have and the small ones don't: folders of files, numbers that stand twice, fan-outs of many rows."""

from __future__ import annotations

import datetime
import os
import re

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from guardrail_spark import plans
from guardrail_spark.operators import evidence, policies, profiles
from guardrail_spark.sources.shared import new_path

SF = "/root/testdata/sf0.001"


def folder_of(spark, tmp_path, name, rows):
    """The small tables with one of them as a folder of two files."""
    for f in os.listdir(SF):
        if f != f"{name}.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    rows.repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("query, name", [("t1_stream_guard", "documents"), ("t3_dedup_stream", "events"), ("t4_stream_chain", "events")])
def test_streams_of_tables_that_are_folders(spark, tmp_path, query, name):
    sf, con = folder_of(spark, tmp_path, name, spark.read.parquet(f"{SF}/{name}.parquet"))
    assert_same(plans.QUERIES[query](spark, sf), con, plans.ORACLES[query])


def test_a_number_that_stands_twice(spark, tmp_path):
    number, far = "+1 (476) 555-6291", "x " * 60
    texts = [f"{number} {far} and {number}", f"and {number} {far} {number}", f"é {far} {number} {far} and {number} and +1 (930) 555-2361"]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    sf, con = folder_of(spark, tmp_path, "documents", rows)
    df = plans.QUERIES["d2_context_score"](spark, sf)
    assert_same(df, con, plans.ORACLES["d2_context_score"])
    assert sorted(tuple(r) for r in df.collect()) == [(0, 2, 0.75), (1, 2, 0.95), (2, 3, 0.95)]


def test_a_fan_out_is_counted_without_its_rows(spark):
    plan = plans.QUERIES["j3_fan_out"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join Inner") :].count("Aggregate [") == 2  # both sides of the join are counted below it


def test_layers_of_a_key_meet_in_one_shuffle(spark):
    deep = '{"a":' * 40 + "1.50" + "}" * 40
    df = spark.createDataFrame([(1, 0, "l0", deep), (1, 1, "l1", '{"a":{"b":[true]}}'), (2, 0, "l0", deep)], "key long, layer int, name string, document string")
    stamps = spark.createDataFrame([(1, "t", "p"), (2, "t", None)], "key long, tenant string, profile string")
    merged = profiles.merge_documents(df)
    for made in (merged, profiles.document_trace(df)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    whole = '{"a":' * 40 + "1.5" + "}" * 40
    assert {r.key: r.document for r in merged.collect()} == {1: whole.removesuffix("}}") + ',"b":[true]}}', 2: whole}
    assert [tuple(r) for r in profiles.document_trace(df).collect()] == [(1, 1, "l1", "a.b", "ADDED", None, "[true]", None)]
    assert {r.key: r.document.rsplit(',"kind"')[1] for r in profiles.compile_documents(df, stamps).collect()} == {k: f':"Policy","metadata":{{"profile":"{p}","status":"draft","tenant":"t"}}}}' for k, p in ((1, "p"), (2, ""))}


def test_documents_of_packs_are_read_before_they_meet_the_apps(spark):
    plan = plans.policy_queries.layered(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.split("\n") if "Join Inner, (name" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    reads = [line for line in plan.split("\n") if "marked" in line and "Project" in line]
    assert any(depth(line) > depth(join) for line in reads)


def test_a_chain_is_the_same_in_rounds_of_any_length(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(f"e{i * 7 % 60:03}", t0 + datetime.timedelta(seconds=i // 9), [None, "t"][i % 5 > 0], "a", i / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id string, ts timestamp, tenant string, app string, score double").withColumns({"evidence_mode": F.lit("none"), "spans": F.lit(None).cast(evidence.SPAN)})
    fields = ["tenant", "app", "chain_seq", "event_id", "prev_event_hash", "event_hash"]
    sort = lambda d: sorted(map(tuple, d.select(*fields).collect()), key=str)
    whole = sort(evidence.build_chain(df))
    for tenant in (None, "t"):
        assert [r[3] for r in sorted((r for r in whole if r[0] == tenant), key=lambda r: r[2])] == [r[0] for r in sorted((r for r in rows if r[2] == tenant), key=lambda r: (r[1], r[0]))]
    short = evidence.build_chain(df, together=5)
    assert sort(short) == whole and short.columns == evidence.build_chain(df).columns
    sizes = short.groupBy(F.input_file_name(), "tenant", "app").count().collect()
    assert len(sizes) == 3 + 10 and max(r["count"] for r in sizes) == 5  # 12 and 48 rows
    cut = t0 + datetime.timedelta(seconds=3)
    heads = evidence.chain_heads(evidence.build_chain(df.where(F.col("ts") < cut), together=4))
    assert set(sort(evidence.build_chain(df.where(F.col("ts") >= cut), heads, together=4))) == {r for r in whole if r[2] > {h.tenant: h.chain_seq for h in heads.collect()}[r[0]]}
    assert evidence.build_chain(df.where("false")).collect() == []


def test_lines_of_versions_meet_in_parts(spark):
    rows = [(f"p{i % 4}" if i % 11 else None, "ab"[i // 28 % 2] if i % 13 else "c", f"l{i % 7}" if i % 5 else None, i) for i in range(120)]
    lines = spark.createDataFrame(rows, "policy_id string, side string, line string, n int")
    diff = policies.diff_versions(lines, together=10)
    want = [r for r in rows if r[1] in "ab" and not any(None not in (r[0], r[2]) and (r[0], r[2]) == (o[0], o[2]) and o[1] in "ab" and o[1] != r[1] for o in rows)]
    assert sorted(map(tuple, diff.collect()), key=str) == sorted(want, key=str) and 20 < len(want) < 100
    assert diff.columns == lines.columns and diff.rdd.getNumPartitions() == 13


def many_chains(spark, chains=6, length=10):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(f"e{i:03}", t0 + datetime.timedelta(seconds=i), f"t{i % chains}", "a", i / 10) for i in range(chains * length)]
    return spark.createDataFrame(rows, "event_id string, ts timestamp, tenant string, app string, score double").withColumns({"evidence_mode": F.lit("none"), "spans": F.lit(None).cast(evidence.SPAN)})


def test_long_chains_of_a_round_are_linked_in_tasks_of_their_own(spark):
    out = evidence.build_chain(many_chains(spark), together=10)
    assert out.count() == 60 and all(r.ok for r in evidence.verify_chain(out).collect())
    assert [r.n for r in out.groupBy(F.input_file_name()).agg(F.countDistinct("tenant").alias("n")).collect()] == [1] * 6


def parts(df):
    """Numbers of parts that the plan of df asks for by number."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


def test_verification_has_as_many_parts_as_a_chain_asks_for(spark, monkeypatch):
    chain = evidence.build_chain(many_chains(spark))
    monkeypatch.setattr(evidence, "TOGETHER", 10)
    forged = chain.withColumn("score", F.when((F.col("tenant") == "t1") & (F.col("chain_seq") == 4), -1.0).otherwise(F.col("score")))
    report = evidence.verify_chain(forged)
    assert parts(report) == [25] and "verdict" not in report._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert {r.tenant: (r.checked, r.ok, r.first_bad_seq, r.reason) for r in report.collect()} == {f"t{i}": (3, False, 4, "event_hash") if i == 1 else (10, True, None, None) for i in range(6)}
    faults = evidence.chain_faults(forged)
    assert faults.columns == [*chain.columns, "reason"]
    assert [(r.event_id, r.score) for r in faults.where("reason is not null").collect()] == [("e019", -1.0)]


def test_events_meet_their_anchors_in_parts(spark, monkeypatch):
    chain = evidence.build_chain(many_chains(spark))
    anchors = evidence.make_anchors(evidence.chain_heads(chain)).withColumn("head_hash", F.when(F.col("tenant") == "t1", "?").otherwise(F.col("head_hash")))
    monkeypatch.setattr(evidence, "TOGETHER", 10)
    checked = evidence.verify_anchors(anchors, chain)
    assert parts(checked) == [25]
    assert {r.tenant: r.ok for r in checked.collect()} == {f"t{i}": i != 1 for i in range(6)}


def test_the_events_of_a_bundle_stay_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over large tables
    try:
        df = plans.QUERIES["s7_export_bundle"](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert_same(df, connect(SF), plans.ORACLES["s7_export_bundle"])


@pytest.mark.parametrize("query", ["t5_late_appended", "t5_late_dropped"])
def test_late_events_come_in_as_many_files_as_they_ask_for(spark, monkeypatch, query):
    monkeypatch.setattr(evidence, "TOGETHER", 300)
    made = []
    monkeypatch.setattr(plans.stream_queries, "new_path", lambda spark, name: made.append(new_path(spark, name)) or made[-1])
    assert_same(plans.QUERIES[query](spark, SF), connect(SF), plans.ORACLES[query])
    for k in (0, 1):
        assert len(spark.read.parquet(f"{made[0]}/part={k}").inputFiles()) == 4  # 1,000 events
    assert len(made) == 1
