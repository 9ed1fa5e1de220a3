from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from guardrail_spark.llm import repair

DONE = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(letters: str) -> tuple[int, str]:
    """By Dijkstra's method over (cost, edits), the plain way."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, out = heapq.heappop(heap)
        if i == len(letters) and DONE.fullmatch(out):
            return cost, edits
        last = out[-1:]
        if (i, last) in seen:
            continue
        seen.add((i, last))
        turn = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, edits + "I", i, out + turn))
        if i < len(letters):
            x = letters[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, out))
            if x != "D":
                more = 3 if x.isupper() else 0
                heapq.heappush(heap, (cost + 3 + more, edits + "R", i + 1, out + turn))
                if x.lower() == turn or (x.lower() == "s" and not out):
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, out + x.lower()))
    raise AssertionError


@pytest.mark.parametrize("seed", range(8))
def test_search_against_all_paths(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = "".join(rng.choices("suaSUAxXD", (2, 6, 6, 1, 1, 1, 1, 1, 2))[0] for _ in range(rng.randrange(14)))
        assert repair.search(letters) == cheapest(letters), letters


def test_floors_are_no_more_than_the_cost():
    rng = random.Random(3)
    for _ in range(300):
        letters = "".join(rng.choices("suaSUAxXD")[0] for _ in range(rng.randrange(12)))
        assert repair.floors(letters)[0] <= repair.search(letters)[0]


def want(rows, ids):
    """The result for turns after damage, the plain way; rows in order within each id."""
    out = {}
    for c in ids:
        own, seen, letters, faults, illegal, before = [r for r in rows if r[0] == c], set(), "", [], 0, None
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for _, _, role, text in own:
            end = text.rstrip(repair.BLANKS)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "D" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
        cost, audit = cheapest(letters)
        turns, i = [], 0
        for e in audit:
            last = turns[-1][0][:1] if turns else ""
            role = "assistant" if last == "u" else "user"
            turns += [] if e == "D" else [(role, "")] if e == "I" else [(own[i][2] if e == "K" else role, own[i][3])]
            i += e != "I"
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        said = "\n".join(f"{r}:{t}" for r, t in turns)
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for c, n, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{space(c)}:{space(n)}".encode()) % 20, space(role), space(text)
        if kind:
            out += [(c, n, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return out


def conversations():
    rng, rows = random.Random(1), []
    for c in [*range(40), None]:
        for n in range(rng.randrange(1, 9)):
            rows.append((c, None if rng.random() < 0.05 else n, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), rng.choice(["Yes.", "no", "Ok! ", "", " \t", None, "né?\x0b", "a. b", "same."])))
    for n in range(700):  # longer than any block
        rows.append((99, n, "user" if n % 2 == 0 else "assistant", f"text {n}{'.' if n % 13 else ''}" if n % 29 else ""))
    rows += [rows[3], rows[3], (7, 2, "user", "tie."), (7, 2, "assistant", "tie."), (98, 0, "user", "x" * 100_000)]
    return rows


@pytest.mark.parametrize("block", [5, repair.BLOCK])
def test_repair_against_the_plain_way(spark, block):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos int, fault string")
    got = {r[0]: tuple(r)[1:] for r in repair.repair(df, repair.damage(df), block).collect()}
    assert got == want(damaged(rows), {r[0] for r in rows})


def test_repaired_turns_are_well_formed(spark):
    df = spark.createDataFrame(conversations(), SCHEMA)
    turns = repair.examined(repair.damage(df)).cache()
    edits = repair.searched(turns, 8)
    by_conv: dict[str, list] = {}
    for r in repair.repaired_turns(turns, edits, 8).collect():
        by_conv.setdefault(r.key, []).append(r)
    digests = {r.key: r.repaired_sha256 for r in repair.digests(turns, edits, 8).collect()}
    for key, rows in by_conv.items():
        rows.sort(key=lambda r: (r.pos, r.n))
        assert DONE.fullmatch("".join(r.role[:1] for r in rows))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows).encode()).hexdigest() == digests[key]


def test_nothing_left_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Yes.")], SCHEMA)
    (row,) = repair.repair(df, repair.damage(df)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(df.where("false"), repair.damage(df.where("false"))).collect() == []
