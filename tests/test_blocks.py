"""Walks over long keys in blocks, against the plain walk."""

from __future__ import annotations

import datetime
import random

import pytest

from guardrail_spark.operators import evidence, metrics, policies


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_anchor_coverage(spark, block):
    rng = random.Random(block)
    events, anchors, want = [], [], {}
    for app in ("a", "b", None):
        at, covered = 1, {}
        while at < 60:
            if rng.random() < 0.5:
                end = at + rng.randrange(12)
                anchors.append(("t", app, at, end))
                covered |= dict.fromkeys(range(at, end + 1), end)
                at = end
            at += 1 + rng.randrange(4)
        for n in range(1, 61):
            events.append(("t", app, n, f"{app}{n}"))
            want[f"{app}{n}"] = covered.get(n)
    e = spark.createDataFrame(events, "tenant string, app string, chain_seq long, event_id string")
    a = spark.createDataFrame(anchors, "tenant string, app string, start_seq long, end_seq long")
    assert {r.event_id: r.anchor_end for r in evidence.anchor_coverage(e, a, block).collect()} == want


@pytest.mark.parametrize("block_seconds", [1, 7, 60, 3600])
def test_breakers(spark, block_seconds):
    rng, t0 = random.Random(block_seconds), datetime.datetime(2024, 1, 1)
    rows, want = [], []
    for guard in ("g", None):
        own = [(guard, t0 + datetime.timedelta(seconds=rng.randrange(200)), f"{i:03}", rng.choices(["ERROR", "PASS", None], (8, 1, 1))[0]) for i in range(150)]
        own.sort(key=lambda r: (r[1], r[2]))
        rows += own
        own, run = [r for r in own if r[3]], 0
        for i, (_, ts, _, verdict) in enumerate(own):
            run = run + 1 if verdict != "PASS" else 0
            if verdict != "PASS" and run >= 3:
                reset = next((r[1] for r in own[i + 1 :] if r[3] == "PASS"), None)
                late = ts + datetime.timedelta(seconds=15)
                want.append((guard or "", ts, min(late, reset) if reset else late, run))
    df = spark.createDataFrame(rows, "guard_id string, ts timestamp_ntz, event_id string, verdict string")
    got = [(r[0] or "", *r[1:]) for r in metrics.breaker_windows(df, ["guard_id"], 3, 15, block_seconds).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_lifecycles(spark, block):
    rng = random.Random(block)
    rows = [(key, i, rng.choice(["submit", "submit", "approve", "reject", "revoke", "other"])) for key in ("a", "b", None) for i in range(90)]
    want, state = [], {}
    for key, at, action in rows:
        before = state.get(key, "draft")
        after = policies.LEGAL.get((before, action))
        state[key] = after or before
        want.append((key or "", at, action, before, after or before, after is not None))
    rng.shuffle(rows)
    got = policies.replay_lifecycle(spark.createDataFrame(rows, "key string, at long, action string"), block).collect()
    assert sorted((r.key or "", *r[1:]) for r in got) == sorted(want)
