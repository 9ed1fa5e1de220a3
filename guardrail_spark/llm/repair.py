"""Repair of conversations' structure: the cheapest edits that leave a system turn at most, then user and assistant by turns.

Every turn becomes one letter: what its role begins with and whether it is blank, a copy of an earlier turn, or cut off.
The letters of BLOCK turns make a block; iterative-deepening A* searches its edits: depth first in ASCII order of the edits
(D delete, I insert, K keep, R give another role) under a bound on the cost that grows to the least one exceeded. The bound
on what is left counts turns that cannot stay free, and pairs of neighbours that cannot stand together; a table of failed
states keeps the least cost that each (turn, state) was found to need, so none is searched twice in vain. The first path that
is accepted costs least and is the ASCII-least of those.

A conversation of one block is searched at once. In a longer one each block is searched from every state that it may be
entered in to every state that it may be left in; a stream backwards over the blocks picks each state's best way on, a
stream forwards follows it. Paths between the same turns are never beginnings of one another, so the least of the whole is
made of least parts. No task holds more than a block of letters; texts pass through one stream with the state of a hash.

Defined cases: a null role, text, number or id counts as one space where it is read as text; turns of equal number stand by
role, then text, null numbers first; repeated rows are turns of their own (and copies); ids whose turns are all gone have
zeros and an empty audit; null ids are a conversation; an empty table gives no rows; long texts and conversations are
streamed; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, shuffle_partitions

BLOCK = 64  # turns that are searched together
BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT, END = range(5)  # what stands last; END: the conversation may end
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # whose turn it is
_KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_PAIRS = ("su", "ua", "au")
_FOREVER = 1 << 60


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with damage that depends on crc32 of `conv_id:turn` alone: of 20 rows, one goes, one loses
    its text, one its full stops, one is doubled, and one becomes the user's."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    rows = conversations.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    rows = rows.where("kind <> 0").withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": said, "n": F.explode(F.sequence(F.lit(1), times))})
    return rows.select("conv_id", "turn", "role", "text")


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(f"`{c}`").cast("string")), F.lit(""))


def examined(rows: DataFrame) -> DataFrame:
    """(key, pos, turn, role, text, initial, fault, letter, illegal, new_turn) of turns (conv_id, turn, role, text): pos from
    1; fault: blank, duplicate, truncated or null; the letter of the search; whether the turn cannot follow the one before."""
    rows = rows.select(_key("conv_id").alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "last": F.right(end, F.lit(1)), "said": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)})
    order = W.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(order).cast("long"), "before": F.lag("initial").over(order), "turn_before": F.lag("turn").over(order)})
    again = F.row_number().over(W.partitionBy("key", "said").orderBy("pos")) > 1
    fault = F.when(F.col("last") == "", "blank").when(again, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    illegal = (F.col("pos") > 1) & ~F.concat("before", "initial").isin(*_PAIRS)
    new = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))
    return rows.select("key", "pos", "turn", "role", "text", "fault", letter.alias("letter"), illegal.alias("illegal"), new.alias("new_turn"))


def floors(letters: str) -> list[int]:
    """What the turns from each one on cost at least: each that must go, be given a role, or is cut off; and of separate
    pairs of neighbours, all of which could be kept free alone, one edit each."""
    n = len(letters)
    least = [DELETE if x == "D" else min(DELETE, (REROLE if x in "xX" else KEEP) + (CUT_OFF if x.isupper() else 0)) for x in letters]
    out, after, base = [0] * (n + 1), n, 0  # after: the next turn that can stay, base: what stands between costs
    for i in range(n - 1, -1, -1):
        out[i] = least[i] + out[i + 1]
        if letters[i] == "D":
            base += DELETE
            continue
        if after < n and letters[i] in "sua" and letters[after] in "sua" and letters[i] + letters[after] not in _PAIRS:
            out[i] = max(out[i], min(REROLE, DELETE, INSERT) + base + out[after + 1])
        after, base = i, 0
    return out


def reachable(letters: str, entry: int, goal: int) -> bool:
    """Whether any edits lead from one state to the other: to a user's or assistant's turn always, by inserts."""
    return goal in (END, USER, ASSISTANT, entry) or (goal == SYSTEM and entry == NOTHING and "s" in letters.lower())


def search(letters: str, entry: int = NOTHING, goal: int = END) -> tuple[int, str]:
    """(cost, edits) of the cheapest way through the letters from one state to the other, ASCII-least among equals. With
    goal END it may end in inserts; else its last edit is that of the last letter."""
    n, floor = len(letters), floors(letters)
    failed: dict[tuple[int, int], int] = {}  # (letter, state): what the rest costs at least
    path: list[str] = []

    def steps(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        x = letters[i] if i < n else None
        if x:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, _NEXT[state]
        if x and x != "D":
            more = CUT_OFF if x.isupper() else 0
            kept = _KEPT.get((state, x.lower()))
            if kept:
                yield "K", KEEP + more, i + 1, kept
            yield "R", REROLE + more, i + 1, _NEXT[state]

    def beyond(i: int, state: int, left: int) -> int | None:
        """None if a path was found within what is left, else what the rest costs at least."""
        low = max(floor[i], failed.get((i, state), 0))
        if low > left:
            return low
        if i == n:
            if goal == END and state in (NOTHING, ASSISTANT) or goal == state:
                return None
            if goal != END:
                return _FOREVER
        low = _FOREVER
        for edit, cost, j, to in steps(i, state):
            if cost > left:
                low = min(low, cost + floor[j])
                continue
            path.append(edit)
            rest = beyond(j, to, left - cost)
            if rest is None:
                return None
            path.pop()
            low = min(low, cost + rest)
        failed[i, state] = low
        return low

    bound = 0
    while (more := beyond(0, entry, bound)) is not None:
        bound = more
    return bound, "".join(path)


_PART = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
_PART_DDL = "array<struct<entry:int,exit:int,cost:bigint,edits:string>>"


def _parts(letters: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    entries = (NOTHING,) if first else (NOTHING, SYSTEM, USER, ASSISTANT)
    goals = (END,) if last else (NOTHING, SYSTEM, USER, ASSISTANT)
    return [(e, g, *search(letters, e, g)) for e in entries for g in goals if reachable(letters, e, g)]


def searched(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, block, edits, cost): the edits of each block of examined turns on the way of its conversation that costs least."""
    at = ((F.col("pos") - 1) / block).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    blocks = turns.groupBy("key", at.alias("block")).agg(F.array_join(F.transform(listed, lambda x: x["letter"]), "").alias("letters"))
    blocks = blocks.withColumn("last", F.lead("block").over(W.partitionBy("key").orderBy("block")).isNull())

    def all_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_parts(x, at == 0, last) for x, at, last in zip(*(b.column(c).to_pylist() for c in ("letters", "block", "last")))]
            parts = pa.array([[dict(zip(("entry", "exit", "cost", "edits"), p)) for p in m] for m in made], pa.list_(_PART))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), parts], ["key", "block", "last", "parts"])

    # letters are few bytes and much work: dealt by a number of tasks, not by their size
    blocks = blocks.select("key", "block", "letters", "last").repartition(shuffle_partitions(turns.sparkSession), "key", "block")
    found = settled(blocks.mapInArrow(all_parts, f"key string, block long, last boolean, parts {_PART_DDL}"))
    only = found.where("block = 0 and last").select("key", "block", F.col("parts")[0]["edits"].alias("edits"), F.col("parts")[0]["cost"].alias("cost"))

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block and each state that it may be entered in, the part that begins the best way to the end."""
        togo: dict[int, int] = {}
        for b in batches:
            kept = []
            for last, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if last:
                    togo = {END: 0}
                best: dict[int, tuple] = {}
                for p in parts:
                    if p["exit"] in togo:
                        way = (p["cost"] + togo[p["exit"]], p["edits"], p["exit"], p["cost"])
                        best[p["entry"]] = min(best.get(p["entry"], way), way)
                togo = {e: w[0] for e, w in best.items()}
                kept.append([{"entry": e, "exit": w[2], "cost": w[3], "edits": w[1]} for e, w in best.items()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.list_(_PART))], ["key", "block", "parts"])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = NOTHING
        for b in batches:
            out = []
            for block_at, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                state = NOTHING if block_at == 0 else state
                way = next(p for p in parts if p["entry"] == state)
                state = way["exit"]
                out.append((way["edits"], way["cost"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([e for e, _ in out], pa.string()), pa.array([c for _, c in out], pa.int64())], ["key", "block", "edits", "cost"])

    long_ones = found.where("not (block = 0 and last)").repartition("key").sortWithinPartitions("key", F.col("block").desc())
    ways = long_ones.mapInArrow(backwards, f"key string, block long, parts {_PART_DDL}").repartition("key").sortWithinPartitions("key", "block")
    return only.unionByName(ways.mapInArrow(forwards, "key string, block long, edits string, cost long"))


def _edited(edits: Iterator[str], role: str, text: str, state: int) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, state) of the edits up to a turn's own, and of the inserts at the end; a deleted turn has role ''."""
    named = {USER: "user", ASSISTANT: "assistant"}
    for edit in edits:
        if edit == "I":
            state = _NEXT[state]
            yield edit, named[state], "", state
            continue
        if edit == "R":
            state = _NEXT[state]
            yield edit, named[state], text, state
        elif edit == "K":
            state = _KEPT[state, role[:1]]
            yield edit, role, text, state
        else:
            yield edit, "", "", state
        break


def _with_edits(turns: DataFrame, edits: DataFrame, block: int) -> DataFrame:
    """Examined turns in order; the first of each block with its edits. Both sides are dealt by conversation, so the turns of
    one pass through one task in order, as its hash needs."""
    at = ((F.col("pos") - 1) / block).cast("long")
    left = turns.select("key", at.alias("block"), "pos", "role", "text").repartition("key")
    met = left.join(edits.repartition("key"), ["key", "block"])
    return met.select("key", "pos", "role", "text", F.when((F.col("pos") - 1) % block == 0, F.col("edits")).alias("edits")).sortWithinPartitions("key", "pos")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, str, str, str]]]:
    """Lists of (key, pos, edit, role, text) in order. Inserts after a block's last turn come with that turn."""
    rest, at, state = "", 0, NOTHING
    for b in batches:
        out = []
        for key, pos, role, text, edits in zip(*(c.to_pylist() for c in b.columns)):
            if pos == 1:
                state = NOTHING
            if edits is not None:
                rest, at = edits, 0
            for edit, r, t, state in _edited(iter(rest[at:]), role, text, state):
                at += 1
                out.append((key, pos, edit, r, t))
            if not rest[at:].strip("I"):
                while at < len(rest):
                    state, at = _NEXT[state], at + 1
                    out.append((key, pos, "I", "user" if state == USER else "assistant", ""))
        yield out


def repaired_turns(turns: DataFrame, edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, pos, n, edit, role, text) of the repaired conversations, in order of (pos, n); deleted turns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _walk(batches):
            rows, at, n = [], None, 0
            for key, pos, edit, role, text in made:
                n = n + 1 if (key, pos) == at else 1
                at = key, pos
                if edit != "D":
                    rows.append((key, pos, n, edit, role, text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["key", "pos", "n", "edit", "role", "text"])

    return _with_edits(turns, edits, block).mapInArrow(run, "key string, pos long, n long, edit string, role string, text string")


def digests(turns: DataFrame, edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, audit, repaired_sha256): all edits of a conversation, and the digest of its repaired turns, `role:text`, joined
    by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, state, empty = None, [], hashlib.sha256(), True

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["key", "audit", "repaired_sha256"])

        for made in _walk(batches):
            out = []
            for key, _, edit, role, text in made:
                if key != current:
                    if current is not None:
                        out.append((current, "".join(audit), state.hexdigest()))
                    current, audit, state, empty = key, [], hashlib.sha256(), True
                audit.append(edit)
                if edit != "D":
                    state.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if out:
                yield batch(out)
        if current is not None:
            yield batch([(current, "".join(audit), state.hexdigest())])

    return _with_edits(turns, edits, block).mapInArrow(run, "key string, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, damaged: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every id of conversations: gaps in the numbers of its damaged turns, faults by kind, turns that cannot follow each
    other, the cost and the audit of the cheapest repair, and the digest of the repaired conversation."""
    turns = settled(examined(damaged))
    edits = settled(searched(turns, block))
    counted = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps")
    found = turns.groupBy("key").agg(gaps, counted("blank"), counted("duplicate"), counted("truncated"), F.count_if("illegal").alias("illegal"))
    cost = edits.groupBy("key").agg(F.sum("cost").alias("cost"))
    ids = conversations.select("conv_id").distinct().withColumn("key", _key("conv_id"))
    out = ids.join(found, "key", "left").join(cost, "key", "left").join(digests(turns, edits, block), "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
