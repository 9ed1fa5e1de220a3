from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from guardrail_spark import plans
from guardrail_spark.operators import profiles
from guardrail_spark.sources import shared

SF = "/root/testdata/sf0.001"
REMOVE = "__remove__"


def canonical(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def join(a, b, at, said, names):
    """b over a, the plain way; departures go to said."""
    if not (isinstance(a, dict) and isinstance(b, dict)):
        if canonical(a) != canonical(b):
            said.append((at, names[1], "REPLACED", names[0]))
        return b
    out = dict(a)
    for k, v in b.items():
        here = f"{at}.{k}" if at else k
        if k not in a:
            said.append((here, names[1], "ADDED", None))
            out[k] = v
        elif here == "spec.guards" and isinstance(a[k], list) and isinstance(v, list):
            out[k] = guards(a[k], v, here, said, names)
        else:
            out[k] = join(a[k], v, here, said, names)
    return out


def guards(a, b, at, said, names):
    new, out = {g["id"]: g for g in b}, []
    for g in a:
        mine = new.pop(g["id"], None)
        if mine and mine.get(REMOVE):
            said.append((f"{at}[{g['id']}]", names[1], "REMOVED", names[0]))
        else:
            out.append(join(g, mine, f"{at}[{g['id']}]", said, names) if mine else g)
    for g in b:
        if g["id"] in new and not g.get(REMOVE):
            said.append((f"{at}[{g['id']}]", names[1], "ADDED", None))
            out.append(g)
    return out


def merged(layers):
    said, acc = [], layers[0][1]
    for (before, _), (name, doc) in zip(layers, layers[1:]):
        acc = join(acc, doc, "", said, (before, name))
    return acc, sorted(said, key=str)


def a_document(rng, first):
    def value(depth):
        return rng.choice([1, 2.5, "x", "y.z", None, True, [], [1, "a"], [{"id": "q"}], {}, {rng.choice("abc"): value(depth - 1)} if depth else "deep"])

    doc = {k: value(3) for k in rng.sample(["a", "b", "c.d", "e\"f"], rng.randrange(4))}
    ids = rng.sample(["g-1", "g-2", "g-3", "g-4"], rng.randrange(4))
    listed = [{"id": i, **{k: value(2) for k in rng.sample("pqr", rng.randrange(3))}, **({REMOVE: True} if not first and rng.random() < 0.3 else {})} for i in ids]
    spec = {k: value(2) for k in rng.sample("uvw", rng.randrange(3))}
    if rng.random() < 0.8:
        spec["guards"] = listed
    if first or rng.random() < 0.8:
        doc["spec"] = spec
    return doc


@pytest.mark.parametrize("seed", range(3))
def test_random_layers_against_the_plain_way(spark, seed):
    rng = random.Random(seed)
    rows, want, traces = [], {}, {}
    for key in range(80):
        layers = [(f"l{i}", a_document(rng, i == 0)) for i in range(rng.randrange(1, 5))]
        if "guards" not in layers[0][1]["spec"]:
            layers[0][1]["spec"]["guards"] = []  # a mark of removal in the first list would stand there as it is
        rows += [(key, i, name, json.dumps(doc)) for i, (name, doc) in enumerate(layers)]
        want[key], traces[key] = merged(layers)
    df = spark.createDataFrame(rows, "key long, layer int, name string, document string")
    got = {r.key: r.document for r in profiles.merge_documents(df).collect()}
    assert got == {k: canonical(v) for k, v in want.items()}
    found: dict[int, list] = {k: [] for k in want}
    for r in profiles.document_trace(df).collect():
        found[r.key].append((r.path, r.name, r.change, r.replaced))
    assert {k: sorted(v, key=str) for k, v in found.items()} == traces


BASE = {"metadata": {"id": "baseline", "version": "1.0.0"}, "spec": {"guards": [{"id": "g-halluc-out", "threshold": 0.7, "on_fail": "flag"}, {"id": "g-secrets-io"}]}}
INDUSTRY = {"metadata": {"id": "finance", "version": "1.0.0", "parent": "baseline@1.0.0"}, "spec": {"guards": [{"id": "g-halluc-out", "threshold": 0.8, "on_fail": "block_and_explain"}]}}
REGION = {"metadata": {"id": "region", "version": "2.0.0", "parent": "finance@1.0.0"}, "spec": {"defaults": {"timeout_ms": 900}}}


def compiled(spark, profile, app, tenant="acme"):
    packs = spark.createDataFrame([(d["metadata"]["id"], d["metadata"]["version"], json.dumps(d)) for d in (BASE, INDUSTRY, REGION)] + [("loop", "1", '{"metadata":{"parent":"loop@1"}}'), ("lost", "1", '{"metadata":{"parent":"gone@1"}}')], "id string, version string, document string")
    apps = spark.createDataFrame([(1, profile, json.dumps(app) if app else None)], "key long, profile string, document string")
    layers = profiles.profile_layers(apps, packs)
    stamps = spark.createDataFrame([(1, tenant, profile)], "key long, tenant string, profile string")
    docs = [json.loads(r.document) for r in profiles.compile_documents(layers, stamps).collect()]
    return docs[0] if docs else None, [(r.path, r.name, r.change) for r in profiles.document_trace(layers).collect()]


def test_compilation(spark):
    app = {"metadata": {"id": "claims", "version": "1.0.0"}, "spec": {"applies_to": {"apps": ["claims"]}, "guards": [{"id": "g-halluc-out", "threshold": 0.9}, {"id": "g-secrets-io", REMOVE: True}]}}
    doc, trace = compiled(spark, "region@2.0.0", app)
    assert doc["kind"] == "Policy" and doc["metadata"] == {"id": "claims", "version": "1.0.0", "tenant": "acme", "profile": "region@2.0.0", "status": "draft"}
    assert doc["spec"]["guards"] == [{"id": "g-halluc-out", "threshold": 0.9, "on_fail": "block_and_explain"}] and doc["spec"]["defaults"] == {"timeout_ms": 900}
    assert ("spec.guards[g-halluc-out].threshold", "finance@1.0.0", "REPLACED") in trace and ("spec.guards[g-secrets-io]", "app-policy", "REMOVED") in trace
    doc, trace = compiled(spark, None, {"metadata": {"status": "approved"}})
    assert doc["metadata"]["status"] == "approved" and doc["metadata"]["profile"] == "" and len(doc["spec"]["guards"]) == 2
    assert compiled(spark, "loop@1", None) == (None, []) and compiled(spark, "lost@1", None) == (None, []) and compiled(spark, "unknown@1", None) == (None, [])


def test_texts_that_are_no_documents(spark):
    rows = [(1, 0, "a", None), (1, 1, "b", "[1]"), (1, 2, "c", '{"x":1,"x":2e0}'), (2, 0, "a", "nope"), (3, 0, "a", "{}")]
    df = spark.createDataFrame(rows, "key long, layer int, name string, document string")
    assert {r.key: r.document for r in profiles.merge_documents(df).collect()} == {1: '{"x":2}'}
    assert profiles.merge_documents(df.where("false")).collect() == []


def test_stacks_give_what_layers_give(spark, monkeypatch):
    packs = [(d["metadata"]["id"], d["metadata"]["version"], json.dumps(d)) for d in (BASE, INDUSTRY, REGION)]
    packs += [("loop", "1", '{"metadata":{"parent":"loop@1"}}'), ("lost", "1", '{"metadata":{"parent":"gone@1"}}'), ("broken", "1", "nope"), ("over", "1", '{"metadata":{"parent":"broken@1"},"spec":{"guards":[{"id":"g-secrets-io","__remove__":1}]}}')]
    names = [None, "", "baseline@1.0.0", "finance@1.0.0", "region@2.0.0", "broken@1", "over@1", "loop@1", "lost@1", "unknown@1"]
    texts = [None, "nope", "{}", '{"spec":{"guards":[{"id":"g-halluc-out","threshold":0.80},{"id":"g-secrets-io","__remove__":true},{"id":5}]},"":{"a":1}}', '{"spec":{"guards":[{"id":"g-new"}],"defaults":7},"metadata":{"id":"baseline"}}']
    rows = [(i * len(texts) + j, name, text) for i, name in enumerate(names) for j, text in enumerate(texts)]
    apps = spark.createDataFrame(rows, "key long, profile string, document string")
    assert [tuple(r)[3:] for r in profiles.document_trace(spark.createDataFrame([(1, 0, "a", '{"spec":{"guards":[{"id":"5"}]}}'), (1, 1, "b", '{"spec":{"guards":[{"id":5.0,"x":1},{"id":6}]}}')], "key long, layer int, name string, document string")).collect()] == [
        ("spec.guards[5].id", "REPLACED", '"5"', "5", "a"), ("spec.guards[5].x", "ADDED", None, "1", None), ("spec.guards[6]", "ADDED", None, None, None),
    ]
    stamps = apps.where("key % 3 > 0").select("key", F.concat(F.lit("t"), "key").alias("tenant"), "profile")
    for known, most in ((packs, 0), (packs[1:], 100_000), ([], 100_000)):  # all, without the baseline, none
        monkeypatch.setattr(shared, "MOST_BROADCAST", most)
        known = spark.createDataFrame(known, "id string, version string, document string")
        layers, (own, stacks) = profiles.profile_layers(apps, known), profiles.profile_stacks(apps, known)
        for got, want in (
            (profiles.document_trace(own, stacks), profiles.document_trace(layers)),
            (profiles.merge_documents(own, stacks), profiles.merge_documents(layers)),
            (profiles.compile_documents(own, stamps, stacks), profiles.compile_documents(layers, stamps)),
        ):
            assert got.schema.simpleString() == want.schema.simpleString()
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_what_orders_share_is_traced_once(spark):
    plan = plans.QUERIES["p4_document_trace"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    orders = [i for i, line in enumerate(plan) if "o_orderkey" in line and "Relation" in line]
    above = lambda i: [line for n, line in enumerate(plan[:i]) if depth(line) < min(map(depth, plan[n + 1 : i + 1]))]
    assert len(orders) == 2
    for i in orders:  # their documents are not shuffled, and the departures of packs don't come from a document of each order
        steps = [line.strip(" :+-").split("(")[0].split(" ")[0] for line in above(i)]
        assert "Aggregate" not in steps and steps.count("RepartitionByExpression") == 1
        assert "document" not in above(i)[steps.index("RepartitionByExpression") + 1]
    assert sum("MapInArrow" in line for i in orders for line in above(i)) == 1


def test_numbers_of_documents_are_canonical(spark):
    numbers = "0 -0 -0.0 0e9 7 -12 1.0 1.50 0.1 1e2 1E+2 4E2 1e15 2e15 1e16 -1e15 1e-4 1e-5 1.5e-7 123456789.125 5e-324 1e22 123456789012345678901234567890 12345678901234567890.0 0.30000000000000004".split()
    wrong = "1e999 -1e400 01 1. .5 +1 1e 0x1 1.2.3 1-2 NaN Infinity -".split()
    strings = ['""', '":"', '"12:"', '":12"', '"n1"', '"s"', r'"a\"1,\\"', r'"\\\"2"', '"é\\u00e9\\n\\u001f"', '"\\ud83d\\ude00"']
    texts = [f'{{"b": {x},"a":[{x}, {{"d":1,"c":{x}}}]}}' for x in (*numbers, *wrong, *strings)] + ['{"1:":{":2":3,"3":"4"}}', '{"x":"5}', '{"x":"a"5"}', '{"x":1,"x":[2.0]}', '{"x":"' + 'y\\"1' * 50_000 + '"}']
    df = spark.createDataFrame(list(enumerate(texts)), "key long, document string")
    got = {r.key: r.document for r in profiles.merge_documents(df.withColumns({"layer": F.lit(0), "name": F.lit("l")})).collect()}
    last = lambda pairs: dict(sorted(dict(pairs).items()))

    def number(t):
        v = float(t)
        return Number(t.replace("-0", "0") if t in ("0", "-0") else t if t.lstrip("-").isdigit() else str(int(v)) if v == int(v) and abs(v) <= 1e15 else repr(v))

    for key, text in enumerate(texts):
        try:
            want = written(json.loads(text, parse_int=number, parse_float=number, parse_constant=float, object_pairs_hook=last))
        except (ValueError, OverflowError):
            want = None
        assert got.get(key) == (None if want and ("NaN" in text or "Infinity" in text) else want), text


class Number(str):
    """Text of a number."""


def written(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(written, v)) + "]"
    return str(v) if isinstance(v, Number) else json.dumps(v, ensure_ascii=False)
