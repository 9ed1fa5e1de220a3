from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from guardrail_spark.functions import aba_ok, bump_patch, canonical_double, iban_ok, jwt_ok, luhn_ok, shannon_entropy
from guardrail_spark.operators import actions, detection, safety
from guardrail_spark.rules import PII, SECRETS, Rule, rule_pack

SPAN_ROWS = detection.SPAN


def scan_pii(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r.id: r for r in detection.pii_scan(df).collect()}


def labels(row):
    return [s.label for s in row.spans]


def test_matches_equal_finditer(spark):
    texts = ["", "aa", "xaax é aa", "aaaa", "日本aa語", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: [(m.start, m.end) for m in r.m] for r in df.select("id", detection.matches(F.coalesce("text", F.lit("")), "aa").alias("m")).collect()}
    assert got == {i: [m.span() for m in re.finditer("aa", t or "")] for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Her SSN is 123-45-6789.", "SSN"),
        ("Pay with card 4111 1111 1111 1111 today", "CREDIT_CARD"),
        ("Routing number 021000021 applies", "US_ROUTING"),
        ("write to jane.doe@example.com now", "EMAIL"),
        ("call phone (212) 155-0123", None),
        ("call phone (212) 555-2345", "US_PHONE"),
        ("my account number is 12345678", "US_BANK_ACCOUNT"),
        ("the number is 12345678", None),
        ("IBAN GB82 WEST 1234 5698 7654 32 is ours", "IBAN"),
        ("nothing to see here", None),
        ("", None),
        (None, None),
    ],
)
def test_pii_golden(spark, text, label):
    row = scan_pii(spark, text)[0]
    assert labels(row) == ([label] if label else [])
    assert row.verdict == ("FAIL" if label else "PASS")
    assert row.score == (max(s.confidence for s in row.spans) if label else 0.0)


def test_context_raises_confidence(spark):
    near, far = scan_pii(spark, "SSN: 123-45-6789", "number 123-45-6789").values()
    assert near.spans[0].confidence == pytest.approx(0.95)
    assert far.spans[0].confidence == pytest.approx(0.75)


def test_validators(spark):
    rows = [("4111111111111111", "021000021", "GB82WEST12345698765432", "eyJh.eyJi.abcd"), ("4111111111111112", "021000022", "GB83WEST12345698765432", "eyJh.eyJi"), ("42", "1", "GB", "")]
    df = spark.createDataFrame(rows, "l string, a string, i string, j string")
    got = [tuple(r) for r in df.select(luhn_ok(F.col("l")), aba_ok(F.col("a")), iban_ok(F.col("i")), jwt_ok(F.col("j"))).collect()]
    assert got == [(True,) * 4, (False,) * 4, (False,) * 4]


def test_entropy_and_canonical_double(spark):
    df = spark.createDataFrame([("aabb", 0.5), ("abcd", 1.0), ("", 0.0005)], "s string, d double")
    got = df.select(F.round(shannon_entropy(F.col("s")), 6), canonical_double(F.col("d"))).collect()
    assert [(r[0], r[1]) for r in got] == [(1.0, "0.5"), (2.0, "1"), (0.0, "0.0005")]


def test_secrets(spark):
    token = "ghp_" + "a1B2" * 9
    df = spark.createDataFrame([(f"use {token} now",), ("AKIA" + "ABCD1234EFGH5678",), ("-----BEGIN RSA PRIVATE KEY-----",), ("eyJhbGciOiJI.eyJzdWIiOi",), ("plain words only",)], "text string")
    rows = detection.secrets_scan(df).collect()
    assert [[s.label for s in r.spans] for r in rows] == [["github-pat"], ["aws-access-key"], ["private-key-pem"], [], []]
    assert detection.secrets_scan(df, threshold=0.995).where("verdict = 'FAIL'").count() == 1


def fold(spans, kind):
    """The same by a plain loop."""
    key = (lambda s: (s[0], -s[3], -(s[1] - s[0]), s[2])) if kind == "pii" else (lambda s: (s[0], -s[3], s[2]))
    out = []
    for s in sorted(spans, key=key):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[3] > out[-1][3]:
            out[-1] = s
    return out


@pytest.mark.parametrize("kind", ["pii", "secrets"])
def test_overlaps(spark, kind):
    cases = [
        [],
        [(0, 5, "A", 0.5), (3, 8, "B", 0.9), (7, 9, "C", 0.1)],
        [(0, 5, "A", 0.5), (0, 9, "B", 0.5), (9, 10, "C", 0.5)],
        [(2, 4, "A", 0.9), (0, 10, "B", 0.2), (3, 5, "C", 0.9)],
        [(0, 3, "A", 0.5), (0, 3, "A", 0.5)],
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"id int, s {SPAN_ROWS}")
    got = {r.id: [tuple(s) for s in r.r] for r in df.select("id", detection.resolve_overlaps(F.col("s"), kind).alias("r")).collect()}
    assert got == {i: fold(c, kind) for i, c in enumerate(cases)}


def test_actions(spark):
    text = "call bob at 5551234567 or 42"
    spans = [(12, 22, "PHONE", 0.9), (26, 28, "NUM", 0.9)]
    rows = [
        ("redact", text, 0, "redact", False, "FAIL", spans), ("mask", text, 0, "mask", False, "FAIL", spans), ("block", text, 0, "block", False, "FAIL", spans),
        ("pass", text, 0, "redact", False, "PASS", spans), ("shadow", text, 0, "redact", True, "FAIL", spans), ("flag", text, 0, "flag", False, "FAIL", spans),
        ("later", text, 0, "reask", False, "FAIL", spans), ("two", text, 0, "redact", False, "FAIL", spans[:1]), ("two", text, 1, "mask", False, "FAIL", spans),
    ]
    df = spark.createDataFrame(rows, f"id string, text string, pos int, on_fail string, shadow boolean, verdict string, spans {SPAN_ROWS}")
    got = {r.id: (r.block, r.actions, r.mutated) for r in actions.apply_actions(df, ["id"]).collect()}
    assert got["redact"] == (False, ["redact"], "call bob at [PHONE-REDACTED] or [NUM-REDACTED]")
    assert got["mask"] == (False, ["mask"], "call bob at ******4567 or **")
    assert got["block"] == (True, ["block"], text)
    assert got["pass"] == (False, [], text)
    assert got["shadow"] == (False, [], text)
    assert got["flag"] == (False, ["flag"], text)
    assert got["later"] == (False, ["reask:deferred"], text)
    assert got["two"][1] == ["redact", "mask"]


def test_enforce_order_and_block(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "input"), (2, "mail a@b.co", "output"), (3, "plain", "input")], "id int, text string, direction string")
    pii = {"detector": "pii-regex@1.0.0", "direction": ["input"]}
    redact, block = [pii | {"on_fail": "redact"}], [pii | {"on_fail": "block"}]
    got = {r.id: (r.text, r.blocked, r.actions) for r in actions.enforce(df, [redact, block], detection.scan, ["id"]).collect()}
    assert got == {1: ("mail [EMAIL-REDACTED]", False, ["redact"]), 2: ("mail a@b.co", False, []), 3: ("plain", False, [])}
    got = {r.id: (r.text, r.blocked) for r in actions.enforce(df, [block, redact], detection.scan, ["id"]).collect()}
    assert got[1] == ("mail a@b.co", True)


def test_safety(spark):
    df = spark.createDataFrame([("How to MAKE a bomb and kill myself",), ("nice day",), (None,)], "text string")
    assert [r.category for r in safety.hard_signals(df).collect()] == ["self_harm", None, None]
    r = spark.createDataFrame([("safe",), ("unsafe\nS1, S9",), ("unsafe",), (None,)], "t string").select(safety.parse_llamaguard(F.col("t")).alias("r")).collect()
    assert [(x.r.verdict, x.r.score, sorted(x.r.categories)) for x in r] == [("PASS", 0.0, []), ("FAIL", 1.0, ["S1", "S9"]), ("FAIL", 0.5, []), ("PASS", 0.0, [])]
    j = spark.createDataFrame([('Sure: ```json\n{"a": 1}\n```',), ("none",)], "t string").select(safety.json_in_reply(F.col("t"))).collect()
    assert [x[0] for x in j] == ['{"a": 1}', None]


def test_claims(spark):
    df = spark.createDataFrame([("Dr. Smith is here. He was late, and she has left.",), ("The big apple, and the pear tree. Too short.",), ("The cat is big. The cat is big.",)], "text string")
    rows = df.select(safety.sentences(F.col("text")).alias("s"), safety.claims(F.col("text")).alias("c"), safety.locate_claims(F.col("text"), safety.claims(F.col("text"))).alias("l")).collect()
    assert rows[0].s == ["Dr. Smith is here.", "He was late, and she has left."]
    assert rows[0].c == ["Dr. Smith is here.", "He was late", "she has left."]
    assert rows[1].c == ["The big apple, and the pear tree."]
    assert [(x.start, x.end) for x in rows[2].l] == [(0, 15), (16, 31)]


def test_rule_pack_defaults():
    pack = rule_pack({"entities": [{"label": "X", "regex": "x", "context_words": ["Foo"]}]})
    assert pack == [Rule("X", "x", 0.5, "pii", context_words=("foo",))]
    assert len(PII) == 7 and len(SECRETS) == 12


def test_bump_patch(spark):
    df = spark.createDataFrame([("1.2.3",), ("1.2",), ("1.2.x",)], "v string")
    assert [r[0] for r in df.select(bump_patch(F.col("v"))).collect()] == ["1.2.4", "1.2.1", "1.2.x.1"]


def _plan(spark, *rows):
    names = "app string, env string, step int, pos int, policy string, guard_id string, scenario string, detector string, guard_direction array<string>, on_fail string, fail_mode string, default_fail_mode string, shadow boolean"
    return spark.createDataFrame([("a", "prod", step, pos, f"p{step}@1", f"g{step}{pos}", "pii", detector, ways, act, mode, "closed", quiet) for step, pos, detector, ways, act, mode, quiet in rows], names)


def test_check_reports(spark):
    detection.register("email@1", lambda df, text: detection.pii_scan(df, text, rules=[r for r in detection.PII if r.id == "EMAIL"]))
    rows = [(1, "mail a@b.com now", "a"), (2, "nothing", "a"), (3, None, "a"), (4, "mail a@b.com", "other"), (5, "", "a")]
    df = spark.createDataFrame(rows, "id int, text string, app string").selectExpr("*", "'prod' AS env", "'input' AS direction", "'x' AS verdict", "1 AS step")
    first = (1, 0, "email@1", ["input"], "redact", "", False)
    run = lambda *plan: {r.id: r for r in actions.check(df, _plan(spark, *plan), detection.scan, ["id"]).collect()}
    got = run(first, (2, 0, "email@1", ["input"], "block", "", False))
    assert (got[1].verdict, got[1].blocked, got[1].mutated, got[1].actions) == ("FAIL", False, "mail [EMAIL-REDACTED] now", ["redact"])
    assert [(g.policy, g.guard_id, g.verdict) for g in got[1].guards] == [("p1@1", "g10", "FAIL"), ("p2@1", "g20", "PASS")]
    assert all((got[i].verdict, got[i].mutated, got[i].actions) == ("PASS", None, []) for i in (2, 3, 4, 5))
    assert got[3].current is None and got[4].guards == [] and len(got[5].guards) == 2
    # a block ends the walk; shadow counts, but does not act; other directions are not run; failed detectors by fail mode
    got = run((1, 0, "email@1", ["input"], "block", "", False), (2, 0, "email@1", ["input"], "redact", "", False))
    assert (got[1].blocked, got[1].mutated, len(got[1].guards)) == (True, None, 1)
    got = run((1, 0, "email@1", ["input"], "block", "", True), (1, 1, "email@1", ["output"], "block", "", False), (1, 2, "lost@9", ["input"], "reask", "", False), (1, 3, "lost@9", ["input"], "flag", "open", False))
    assert (got[1].blocked, got[1].verdict, got[1].actions) == (False, "FAIL", ["reask:deferred"])
    assert [(g.guard_id, g.verdict) for g in got[2].guards] == [("g10", "PASS"), ("g12", "FAIL"), ("g13", "PASS")]
    assert actions.check(df.limit(0), _plan(spark, first), detection.scan, ["id"]).count() == 0


def test_guard_conversations_and_writeback(spark):
    detection.register("email@1", lambda df, text: detection.pii_scan(df, text, rules=[r for r in detection.PII if r.id == "EMAIL"]))
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "a@b.com"), (1, 2, "assistant", "c@d.com ok"), (1, 3, "assistant", None), (2, 0, "user", "hello")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    both = _plan(spark, (1, 0, "email@1", ["input", "output"], "redact", "", False))
    reports = actions.guard_conversations(turns, both, detection.scan, F.lit("a"), F.lit("prod"))
    got = {(r.conv_id, r.turn): r.text for r in actions.writeback(turns, reports).collect()}
    assert got == {(1, 0): "be kind", (1, 1): "be kind\n[EMAIL-REDACTED]", (1, 2): "[EMAIL-REDACTED] ok\n", (1, 3): None, (2, 0): "hello"}
    strict = _plan(spark, (1, 0, "email@1", ["input"], "block", "", False))
    out = {r.conv_id: r for r in actions.guard_conversations(turns, strict, detection.scan, F.lit("a"), F.lit("prod")).collect()}
    assert out[1].input.blocked and out[1].output is None and out[2].output.verdict == "PASS"
