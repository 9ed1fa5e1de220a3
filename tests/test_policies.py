"""Chains, guard merges, schema issues, manifests, breakers and thresholds against versions in plain Python."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from guardrail_spark.operators import metrics, policies, tuning


def test_chains_of_any_depth(spark):
    parents = {i: i - 1 if i > 1 else None for i in range(1, 41)} | {100: 101, 101: 102, 102: 100, 103: 101, 200: 999}
    got = {r.id: r for r in policies.resolve_chains(spark.createDataFrame(list(parents.items()), "id long, parent long")).collect()}
    for i, up in parents.items():
        path, cycle = [i], False
        while up is not None and up in parents:
            if up in path:
                cycle = True
                break
            path.append(up)
            up = parents[up]
        assert (got[i].path, got[i].cycle) == (path[::-1], cycle)
    assert got[200].missing == 999 and got[40].missing is None


def test_guards_merge_in_order(spark):
    rows = [
        (1, "a", 1, 1, False, {"on_fail": '"block"', "config.x": "1", "config.y": "2"}), (1, "b", 1, 2, False, {"on_fail": '"flag"'}), (1, "c", 1, 3, False, {"on_fail": '"mask"'}),
        (1, "b", 2, 1, True, {}), (1, "a", 2, 2, False, {"config.x": "9"}), (1, "d", 2, 3, False, {"on_fail": '"flag"'}),
        (1, "b", 3, 1, False, {"on_fail": '"redact"'}), (1, "a", 3, 2, False, {"config": "null"}), (1, "e", 3, 3, True, {}),
    ]
    df = spark.createDataFrame(rows, "key int, guard_id string, layer int, pos int, remove boolean, leaves map<string,string>")
    got = [(r.guard_id, r.layer, r.leaves) for r in policies.merge_guards(df).orderBy("place").collect()]
    assert got == [("a", 1, {"on_fail": '"block"', "config": "null"}), ("c", 1, {"on_fail": '"mask"'}), ("d", 2, {"on_fail": '"flag"'}), ("b", 3, {"on_fail": '"redact"'})]


def good_document():
    guard = {"id": "g-1", "scenario": "pii", "detector": "pii-regex@1.0.0", "direction": ["input"], "on_fail": "block"}
    return {"apiVersion": "v1", "kind": "Policy", "metadata": {"id": "pol-1", "version": "1.0.0", "tenant": "t", "status": "draft"}, "spec": {"applies_to": {"apps": ["a"], "environments": ["prod"]}, "guards": [guard]}}


def test_document_issues(spark):
    def changed(path, value):
        doc = good_document()
        at = doc
        for k in path[:-1]:
            at = at[k]
        if value is None:
            del at[path[-1]]
        else:
            at[path[-1]] = value
        return json.dumps(doc)

    g = ("spec", "guards", 0)
    cases = [
        (json.dumps(good_document()), []), ("no json", ["schema.type"]), ("[1]", ["schema.type"]),
        (changed(("kind",), "Other"), ["schema.const"]), (changed(("metadata", "version"), "1.0"), ["schema.pattern"]), (changed(("metadata", "status"), "gone"), ["schema.enum"]),
        (changed(("metadata", "tenant"), None), ["schema.required"]), (changed(("spec", "guards"), []), ["schema.minItems"]), (changed(("spec", "applies_to", "apps"), []), ["schema.minItems"]),
        (changed((*g, "threshold"), 1.5), ["schema.threshold"]), (changed((*g, "threshold"), "default"), []), (changed((*g, "direction"), ["input", "input"]), ["schema.uniqueItems"]),
        (changed((*g, "direction"), []), ["schema.minItems"]), (changed((*g, "on_fail"), None), ["schema.required"]), (changed((*g, "on_fail"), "explode"), ["schema.enum"]), (changed((*g, "detector"), "x"), ["schema.pattern"]),
        (changed(("spec", "defaults"), {"fail_mode": "ajar", "timeout_ms": 0}), ["schema.enum", "schema.range"]),
    ]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, document string")
    got = {}
    for r in policies.document_issues(df).collect():
        got.setdefault(r.i, []).append(r.code)
    assert {i: sorted(got.get(i, [])) for i in range(len(cases))} == {i: sorted(c) for i, (_, c) in enumerate(cases)}


def test_document_hash_is_of_canonical_json(spark):
    texts = ['{"b": [1.0, 2.50, null], "a": {"z": "é\\n", "y": true}}', '{"a":{"y":true,"z":"\\u00e9\\n"},"b":[1,2.5,null]}', '{"x": "1.0,2.0"}']
    df = spark.createDataFrame([(t,) for t in texts], "document string")
    got = [r.h for r in df.select(policies.document_hash(df).alias("h")).collect()]
    want = ["sha256:" + hashlib.sha256(t.encode()).hexdigest() for t in ('{"a":{"y":true,"z":"é\\n"},"b":[1,2.5,null]}', '{"x":"1.0,2.0"}')]
    assert got == [want[0], want[0], want[1]]


def test_breaker_opens_anew_at_later_failures(spark):
    marks = "EEEPEEEEE"
    rows = [(k, "g", "ERROR" if m == "E" else "PASS", f"2024-01-01 00:00:{2 * k:02d}") for k, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "event_id int, guard_id string, verdict string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [(r.opened_at.second, r.closes_at.second, r.failures) for r in metrics.breaker_windows(df, ["guard_id"], 3).orderBy("opened_at").collect()]
    assert got == [(4, 6, 3), (12, 27, 3), (14, 29, 4), (16, 31, 5)]


def test_grid_of_a_column_is_the_grid(spark):
    df = spark.createDataFrame([(t,) for t in (0.05, 0.3, 0.7, 0.9, 0.99)], "t double")
    assert [r.g for r in df.select(tuning.grid_of(F.col("t")).alias("g")).collect()] == [tuning.grid(r.t) for r in df.collect()]
