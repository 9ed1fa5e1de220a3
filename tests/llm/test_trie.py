from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from guardrail_spark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows):
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [r[3:] for r in sorted(x)] for c, x in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: turns.get(c - c % 20, [])[: heads[c]] + t[heads[c] :] for c, t in turns.items()}


def want(convs):
    """The trie node by node."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
        below = [sums[k] for k in kids[p]]
        sums[p] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *sums[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def same(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, b"x", 7) for r in rows], SCHEMA + ", depth int, prefix binary, words int")
    got = [tuple(r)[:-1] for r in trie.prefix_trie(df, **more).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want(rebuilt(rows)), key=key)


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in range(130):
        for n in range(rng.randrange(1, 6)):
            rows.append((c if c % 20 or c % 3 else c + 1000, None if rng.random() < 0.05 else n, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c  d\te", "é"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_the_tree(spark, seed):
    rows = conversations(seed)
    rows += [(None, 0, "user", "x"), *[(500 + c, n, "user", f"copy {n} of one") for c in range(60) for n in range(4)], *[(600, n, "user", "long one") for n in range(500)], rows[5], rows[5]]
    same(spark, rows)


def test_small_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    monkeypatch.setattr(trie, "HEAVY", 1)
    same(spark, conversations(5) + [(700 + c, 0, "user", "same") for c in range(50)])


def test_only_turnless_and_empty(spark):
    lone = next(c for c in range(21, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    same(spark, [(lone, 0, "user", "gone: its head is another's")])
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
