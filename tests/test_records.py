from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from guardrail_spark.operators import evidence, metrics, policies, tuning
from guardrail_spark.plans import stream_queries
from guardrail_spark.plans.views import view
from guardrail_spark.sources import records
from guardrail_spark.streaming import streams

SF = "/root/testdata/sf0.001"


def chain(spark, n=20):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(f"e{i:03}", t0 + datetime.timedelta(seconds=i), "t", f"a{i % 2}", "PASS", i / 10, [(0, 1, "X", 0.5)], "spans" if i % 3 else "none") for i in range(n)]
    df = spark.createDataFrame(rows, f"event_id string, ts timestamp, tenant string, app string, verdict string, score double, spans {evidence.SPAN}, evidence_mode string")
    return evidence.build_chain(df)


def test_chain_verifies_and_matches_a_plain_walk(spark):
    import hashlib

    c = chain(spark)
    assert all(r.ok for r in evidence.verify_chain(c).collect())
    last = {}
    for r in sorted(c.collect(), key=lambda r: (r.app, r.chain_seq)):
        doc = {f: None for f in evidence.CHAIN_FIELDS}
        doc |= {"event_id": r.event_id, "ts": r.ts.strftime("%Y-%m-%dT%H:%M:%SZ"), "tenant": r.tenant, "app": r.app, "chain_seq": r.chain_seq, "verdict": r.verdict, "evidence_mode": r.evidence_mode}
        doc["score"] = int(r.score) if r.score == int(r.score) else r.score
        doc["spans"] = [s.asDict() for s in r.spans] if r.spans is not None else None
        doc["prev_event_hash"] = last.get(r.app)
        text = json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.prev_event_hash == last.get(r.app)
        assert r.event_hash == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        last[r.app] = r.event_hash


@pytest.mark.parametrize(("change", "reason"), [("verdict", "event_hash"), ("prev_event_hash", "prev_hash"), ("gone", "gap")])
def test_chain_breaks_where_it_was_changed(spark, change, reason):
    c = chain(spark)
    hit = (F.col("app") == "a1") & (F.col("chain_seq") == 4)
    bad = c.where(~hit) if change == "gone" else c.withColumn(change, F.when(hit, "other").otherwise(F.col(change)))
    got = {r.app: (r.ok, r.first_bad_seq, r.reason) for r in evidence.verify_chain(bad).collect()}
    assert got["a0"] == (True, None, None)
    assert got["a1"] == (False, 5 if change == "gone" else 4, reason)


def test_chain_gaps_of_all_kinds(spark):
    """A number given twice, a missing start, a number below 1, and a chain whose tenant is null."""
    c = chain(spark).where("app = 'a1'")
    cases = [
        (c.unionByName(c.where("chain_seq = 3")), 3),
        (c.where("chain_seq > 1"), 2),
        (c.withColumn("chain_seq", F.col("chain_seq") - 1), 0),
    ]
    for rows, at in cases:
        (r,) = evidence.verify_chain(rows).collect()
        assert (r.ok, r.first_bad_seq, r.reason, r.checked) == (False, at, "gap", max(at - 1, 0))
    faults = evidence.chain_faults(c.withColumn("tenant", F.lit(None).cast("string")).withColumn("row", F.lit(1)))
    assert faults.columns == [*c.columns, "row", "reason"] and {r.reason for r in faults.collect()} == {"event_hash"}


def test_chain_goes_on_after_its_head(spark):
    c = chain(spark)
    first, rest = c.where("chain_seq <= 6"), c.where("chain_seq > 6").drop("chain_seq", "prev_event_hash", "event_hash")
    again = evidence.build_chain(rest, evidence.chain_heads(first))
    assert {(r.app, r.chain_seq): r.event_hash for r in again.collect()} == {(r.app, r.chain_seq): r.event_hash for r in c.where("chain_seq > 6").collect()}


def test_ingest_and_jsonl(spark, tmp_path):
    path = tmp_path / "spool"
    path.mkdir()
    (path / "a.jsonl").write_text('{"event_id":"1","ts":"2024-01-01T00:00:00Z","direction":"input","verdict":"PASS","evidence_mode":"none"}\nnot json\n{"event_id":"1","ts":"2024-01-02T00:00:00Z","direction":"input","verdict":"PASS","evidence_mode":"none"}\n{"event_id":"2","direction":"up","verdict":"PASS","evidence_mode":"none"}\n')
    df = records.read_events_jsonl(spark, str(path))
    good, bad = records.ingest_events(df)
    assert [r.event_id for r in good.collect()] == ["1"]
    assert sorted(r.reason for r in bad.collect() if r.event_id) == ["direction", "duplicate"]
    with pytest.raises(Exception):
        records.read_events_jsonl(spark, str(path), "FAILFAST").collect()
    records.write_events(good.select("event_id", "ts", F.lit("t").alias("tenant"), F.lit("a").alias("app")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_rule_feed_and_golden(spark, tmp_path):
    rule = {"id": "r", "description": "d", "regex": "x", "keywords": ["k"], "confidence": 0.9}
    for name, doc in (("a", {"rules": [rule]}), ("b", [rule])):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
        assert [r.id for r in records.read_rule_feed(spark, str(tmp_path / name)).collect()] == ["r"]
    (tmp_path / "c").write_text('{"other": 1}')
    with pytest.raises(Exception):
        records.read_rule_feed(spark, str(tmp_path / "c")).collect()
    (tmp_path / "g.jsonl").write_text('{"text": "x", "expected_labels": ["A"]}\n\n{"text": "y", "expected_labels": []}\n')
    assert records.read_golden(spark, str(tmp_path / "g.jsonl")).count() == 2


def test_tuner(spark):
    rows = [(f"n{i}", "g", 0.72 + i % 3 / 100, False) for i in range(60)] + [(f"p{i}", "g", 0.88 + i % 5 / 100, True) for i in range(60)]
    s = spark.createDataFrame(rows, "event_id string, guard_id string, score double, positive boolean")
    now = spark.createDataFrame([("g", 0.7)], "guard_id string, threshold double")
    (r,) = tuning.recommend_thresholds(s, now).collect()
    assert 0.74 < r.after <= 0.88 and r.fp_rate == 0 and r.fn_rate == 0
    assert tuning.recommend_thresholds(s.limit(5), now).count() == 0
    assert tuning.recommend_thresholds(s.where("false"), now).count() == 0


def test_golden_thresholds(spark):
    """What the cited rule gives by hand on the views."""
    s = tuning.labelled_samples(view(spark, SF, "guard_events"), view(spark, SF, "feedback"))
    got = {r.guard_id: r.after for r in tuning.recommend_thresholds(s, s.select("guard_id").distinct().withColumn("threshold", F.lit(0.7))).collect()}
    assert sorted(got.values()) == [0.771, 0.789, 0.798] and "g-halluc-out" not in got


def test_histogram(spark):
    df = spark.createDataFrame([("k", v) for v in (5, 30, 80, 200)], "k string, latency_ms long")
    rows = metrics.latency_histogram(df, ["k"], (10, 50, 100)).collect()
    assert {r.le: r.n for r in rows} == {10: 1, 50: 2, 100: 3, None: 4} and rows[0].latency_sum == 315


def test_profiles_and_lifecycle(spark):
    p = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("x", "y"), ("y", "x")], "id string, parent string")
    got = {r.id: (r.path, r.cycle) for r in policies.resolve_chains(p).collect()}
    assert got["b"] == (["root", "a", "b"], False) and got["x"][1] and got["y"][1]
    audit = spark.createDataFrame([("k", 1, "submit"), ("k", 2, "revoke"), ("k", 3, "approve")], "key string, at long, action string")
    assert [(r.before, r.after, r.legal) for r in policies.replay_lifecycle(audit).orderBy("at").collect()] == [("draft", "in_review", True), ("in_review", "in_review", False), ("in_review", "approved", True)]


def events_stream(spark, tmp_path):
    g = view(spark, SF, "guard_events").withColumn("ts", F.col("ts").cast("timestamp"))
    g.repartition(3).write.parquet(str(tmp_path / "in"))
    return g, spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_match_batch(spark, tmp_path):
    g, s = events_stream(spark, tmp_path)
    assert drain(streams.dedup_stream(s.unionByName(s), "60 days"), tmp_path, "dedup").count() == g.count()
    batch = {tuple(r) for r in metrics.rates(g, ["verdict"]).collect()}
    assert {tuple(r) for r in drain(streams.stream_rates(s, ["verdict"], late="60 days"), tmp_path, "rates", "complete").collect()} == batch


@pytest.mark.parametrize("late", ["append", "drop"])
def test_stream_chain_verifies(spark, tmp_path, late):
    g, s = events_stream(spark, tmp_path)
    chain = streams.stream_chain(s.withColumns({"spans": F.lit(None).cast(evidence.SPAN)}), late).cache()
    assert (chain.count() == g.count()) == (late == "append")
    assert all(r.ok for r in evidence.verify_chain(chain).collect())


def test_a_batch_that_runs_again_replaces_its_links(spark, tmp_path):
    g, s = events_stream(spark, tmp_path)
    path, links = str(tmp_path / "chain"), []
    rows = s.withColumns({"spans": F.lit(None).cast(evidence.SPAN)})
    for checkpoint in ("a", "a", "b"):  # the second finds nothing new, the third begins anew with the same numbers
        streams.chain_batches(rows, path).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / checkpoint)).start().awaitTermination(120)
        links.append(sorted(r.event_hash for r in spark.read.parquet(f"{path}/chain").collect()))
    assert links[0] == links[1] == links[2] and len(links[0]) == g.count()


def test_policy_swap_and_replay(spark, tmp_path):
    g, s = events_stream(spark, tmp_path)
    seen, folder = [], str(tmp_path / "bundles")
    run = lambda: streams.with_latest_policies(s, folder, str(tmp_path / "kept"), stream_queries.apply_bundle, lambda df, epoch: seen.append(df.count()), max_age_hours=0).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    stream_queries.publish(spark, folder, 1, "2024-01-01T00:00:00Z", ("g-secrets-io",), broken=True)
    with pytest.raises(Exception, match="no sound bundle"):
        run()
    stream_queries.publish(spark, folder, 2, "2024-01-01T00:00:00Z", ("g-pii-out",))
    run()
    assert len(seen) == 3 and sum(seen) == g.where("guard_id = 'g-pii-out'").count()
    bundles = spark.read.schema("manifest string, manifest_hash string").json(folder)
    assert streams.sound_bundles(bundles).isEmpty()  # long stale
    assert [r.bundle_seq for r in streams.sound_bundles(bundles, F.lit("2024-01-02").cast("timestamp")).collect()] == [2]
    (tmp_path / "spool").mkdir()
    (tmp_path / "spool" / "x.jsonl").write_text('{"event_id":"1"}\nbroken\n')
    assert [r.event_id for r in drain(streams.replay(spark, str(tmp_path / "spool")), tmp_path, "spool").collect() if r.event_id] == ["1"]
