"""Evidence chains: minimisation, canonical hashes, building, verification, anchors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import canonical_double, canonical_ts, text_hash
from ..sources.shared import Epochs, new_path, scratch, settled
from .detection import SPAN

# The fields that a chain's hash covers.
CHAIN_FIELDS = (
    "event_id", "ts", "tenant", "app", "env", "chain_seq", "request_id", "policy", "bundle_seq", "guard_id", "scenario", "detector",
    "direction", "verdict", "score", "action_taken", "latency_ms", "evidence_mode", "spans", "text_hash", "prev_event_hash",
)
KEYS = ["tenant", "app"]
_NUMBERS = {"chain_seq", "bundle_seq", "latency_ms"}


def minimize(events: DataFrame) -> DataFrame:
    """Spans only where the mode stores them; an unknown mode counts as `spans`."""
    mode = F.when(F.col("evidence_mode").isin("none", "spans", "full_text"), F.col("evidence_mode")).otherwise("spans")
    return events.withColumns({"evidence_mode": mode, "spans": F.when(mode != "none", F.col("spans"))})


def _number(c: Column) -> Column:
    """Text of a double; what isn't finite has none and must not enter a hash."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a number of an event is not finite"))).otherwise(canonical_double(c))


def _json(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "double":
        return _number(c)
    if kind in ("bigint", "int"):
        return c.cast("string")
    if kind == "boolean":
        return c.cast("string")
    if kind.startswith("timestamp"):
        return F.concat(F.lit('"'), canonical_ts(c), F.lit('"'))
    if kind.startswith("array"):
        label = lambda s: F.regexp_extract(F.to_json(F.struct(s["label"].alias("x"))), r'^\{"x":(.*)\}$', 1)
        span = lambda s: F.concat(F.lit('{"confidence":'), _number(s["confidence"]), F.lit(',"end":'), s["end"].cast("string"), F.lit(',"label":'), label(s), F.lit(',"start":'), s["start"].cast("string"), F.lit("}"))
        return F.concat(F.lit("["), F.array_join(F.transform(c, span), ","), F.lit("]"))
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def canonical_json(df: DataFrame, fields: tuple[str, ...] = CHAIN_FIELDS, **override: Column) -> Column:
    """Sorted keys, no blanks, nulls kept, integral floats as integers; fields that df lacks are null."""
    kinds = dict(df.dtypes)
    parts = []
    for f in sorted(fields):
        value = override.get(f, _json(f, kinds[f]) if f in kinds else F.lit(None).cast("string"))
        parts.append(F.concat(F.lit(f'"{f}":'), F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def event_hash(df: DataFrame) -> Column:
    return text_hash(canonical_json(df))


#: Rows that are put in order or linked together in one task.
TOGETHER = 1 << 17
_SAME_KEYS = [f"o.`{k}` <=> h.`{k}`" for k in KEYS]


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with the columns of heads (a row for each chain); a null tenant or app is one like any other."""
    return rows.alias("o").join(heads.alias("h"), F.expr(" AND ".join(_SAME_KEYS)), "left").select("o.*", *[F.col(f"h.`{c}`") for c in heads.columns if c not in KEYS])


def sequence_events(events: DataFrame, heads: DataFrame | None = None, together: int | None = None) -> DataFrame:
    """events with chain_seq: their place by (ts, event_id) after the head of their (tenant, app). Events are sorted into
    ranges of at most about `together` rows, however long a chain is; a number is the place in its range and what the
    ranges before hold. The ranges are written once, so that they stay the same where the plan is run again."""
    together = TOGETHER if together is None else together
    order = [*KEYS, "ts", "event_id"]
    n = events.count() // together + 1
    ranges = settled((events.repartitionByRange(n, *order) if n > 1 else events.coalesce(1)).withColumn("__range", F.spark_partition_id()))
    before = W.partitionBy(*KEYS).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.groupBy(*KEYS, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")))
    if heads is not None:
        starts = _with_heads(starts, heads.select(*KEYS, F.col("chain_seq").alias("__head"))).withColumn("__first", F.col("__first") + F.coalesce("__head", F.lit(0).cast("long")))
    own = ranges.repartition(n, *KEYS, "__range").withColumn("__place", F.row_number().over(W.partitionBy(*KEYS, "__range").orderBy("ts", "event_id")))
    same = " AND ".join([*_SAME_KEYS, "o.__range = h.__range"])
    out = own.alias("o").join(starts.alias("h"), F.expr(same))
    return out.select(*[F.col(f"o.`{c}`") for c in events.columns if c != "chain_seq"], (F.col("__first") + F.col("__place")).alias("chain_seq"))


def build_chain(events: DataFrame, heads: DataFrame | None = None, together: int | None = None) -> DataFrame:
    """events with chain_seq, prev_event_hash and event_hash. A hash covers the one before it, so a chain is sequential
    by nature: it is linked in rounds of `together` rows of each chain, which stream through one task in order from the
    head that the round before left. So no task grows with a chain, only the number of rounds does. The canonical text
    without the hash before is made in columns, in parallel."""
    linked = Epochs(events.sparkSession, new_path(events.sparkSession, "chain"))
    with scratch(events.sparkSession):
        # as a table heads are known to be small, so that the rows of a chain aren't brought together to meet theirs
        heads = heads if heads is None else settled(heads.select(*KEYS, "chain_seq", "event_hash"))
        out = _link(events, heads, TOGETHER if together is None else together, linked)
    return linked.all(out)


def _link(events: DataFrame, heads: DataFrame | None, together: int, linked: Epochs) -> str:
    """Writes the rounds of build_chain as epochs of linked; gives their schema."""
    rows = sequence_events(minimize(events), heads, together)
    rows = rows.withColumn("__json", canonical_json(rows, prev_event_hash=F.lit('"\x01"'))).drop("prev_event_hash", "event_hash")
    first = F.lit(0).cast("long")
    if heads is not None:
        heads = heads.select(*KEYS, F.col("chain_seq").alias("__head"), F.col("event_hash").alias("__start"))
        rows = _with_heads(rows, heads.drop("__start"))
        first = F.coalesce("__head", first)
    fields = [n for n in rows.columns if n not in ("__json", "__head")]
    rows = rows.withColumn("__round", F.floor((F.col("chain_seq") - first - 1) / together)).drop("__head")
    spark, path = events.sparkSession, new_path(events.sparkSession, "rounds")
    # rows of one round lie in a few files of its folder
    rows.repartition(events.count() // together + 1, "__round", F.col("chain_seq") % 16).write.partitionBy("__round").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    out = ", ".join(f"`{n}` {t}" for n, t in rows.select(*fields).dtypes) + ", prev_event_hash string, event_hash string"
    sizes = {r["__round"]: r["count"] for r in rows.groupBy("__round").count().collect()}

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key = last = front = None
        for b in batches:
            names = [n for n in b.schema.names if n not in ("__json", "__start")]
            prevs, hashes = [], []
            for t, a, text, start in zip(*(b.column(c).to_pylist() for c in (*KEYS, "__json", "__start"))):
                if (t, a) != key:
                    key, last, front = (t, a), start, json.dumps(start)
                prevs.append(last)
                body = text.replace('"\x01"', front)
                last = "sha256:" + hashlib.sha256(body.encode()).hexdigest()
                front = f'"{last}"'
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], [*names, "prev_event_hash", "event_hash"])

    for k in range(len(sizes)):
        part = rows.where(F.col("__round") == k).drop("__round")
        if heads is None:
            part = part.withColumn("__start", F.lit(None).cast("string"))
        else:
            part = _with_heads(part, heads.drop("__head") if k == 0 else heads)
        # by range, as hashes bring several long chains to one task
        part = part.repartitionByRange(2 * sizes[k] // together + 1, *KEYS).sortWithinPartitions(*KEYS, "chain_seq")
        linked.write(part.select(*fields, "__json", "__start").mapInArrow(link, out), k)
        heads = settled(linked.at(k).groupBy(*KEYS).agg(F.max_by("event_hash", "chain_seq").alias("__start")))
    return out


def chain_heads(chain: DataFrame) -> DataFrame:
    return chain.groupBy(*KEYS).agg(F.max("chain_seq").alias("chain_seq"), F.max_by("event_hash", "chain_seq").alias("event_hash"))


def _parts(chain: DataFrame) -> int:
    """In how many parts a chain's rows meet, so that a task's rows don't grow with them."""
    return 4 * chain.count() // TOGETHER + 1


def chain_faults(chain: DataFrame) -> DataFrame:
    """chain with `reason`: what is wrong at each row with itself or with the row before it, if anything; the first fault of
    a chain is the one that a walk in order stops at. Rows meet the one before by (tenant, app, chain_seq), so that a long
    chain is spread over all tasks, of which there are as many as its rows ask for. A number that is null, below 1, given
    twice or without the one before it is a gap."""
    return _faults(chain, chain.columns)


def _faults(chain: DataFrame, fields: list[str]) -> DataFrame:
    """chain_faults with these fields only, of which chain_seq and both hashes are some: others need not be moved."""
    row = F.struct(*[F.col(f"`{c}`") for c in fields], (F.col("event_hash") != event_hash(chain)).alias("__differs"))
    mine = F.struct(F.col("chain_seq").alias("seq"), row.alias("row"), F.lit(None).cast("string").alias("before"))
    ahead = F.struct((F.col("chain_seq") + 1).alias("seq"), F.when(F.lit(False), row).alias("row"), F.col("event_hash").alias("before"))
    place = W.partitionBy(*KEYS, "seq")
    rows = chain.select(*KEYS, F.inline(F.array(mine, ahead))).repartition(_parts(chain), *KEYS, "seq")
    rows = rows.withColumns({"own": F.count("row").over(place), "all": F.count(F.lit(1)).over(place), "before": F.max("before").over(place)}).where("row is not null")
    gap = F.col("seq").isNull() | (F.col("seq") < 1) | (F.col("own") > 1) | ((F.col("seq") > 1) & (F.col("all") == F.col("own")))
    reason = F.when(gap, "gap").when(~F.col("row.prev_event_hash").eqNullSafe(F.col("before")), "prev_hash").when(F.col("row.__differs"), "event_hash")
    return rows.select("row.*", reason.alias("reason")).drop("__differs")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per (tenant, app): rows checked, ok, the first bad sequence number with its reason, and the head."""
    return _faults(chain, [*KEYS, "chain_seq", "prev_event_hash", "event_hash"]).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("event_hash", "chain_seq").alias("head_hash"), F.min(F.when(F.col("reason").isNotNull(), F.struct("chain_seq", "reason"))).alias("bad")
    ).select(*KEYS, F.when(F.col("bad").isNull(), F.col("rows")).otherwise(F.greatest(F.col("bad.chain_seq") - 1, F.lit(0))).alias("checked"), F.col("bad").isNull().alias("ok"), F.col("bad.chain_seq").alias("first_bad_seq"), F.col("bad.reason").alias("reason"), "head_hash")


def break_context(chain: DataFrame, report: DataFrame, n: int = 2) -> DataFrame:
    """The rows about each chain's break."""
    bad = report.where("not ok").select(*KEYS, "first_bad_seq")
    return chain.join(bad, KEYS).where(F.abs(F.col("chain_seq") - F.col("first_bad_seq")) <= n)


def make_anchors(heads: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The next anchor of each chain that has advanced: from the last anchor's end + 1 to the head."""
    ends = anchors.groupBy(*KEYS).agg(F.max("end_seq").alias("__end")) if anchors is not None else heads.select(*KEYS, F.lit(0).cast("long").alias("__end"))
    rows = heads.join(ends, KEYS, "left").withColumn("start_seq", F.coalesce("__end", F.lit(0)) + 1)
    rows = rows.where("chain_seq >= start_seq").select(*KEYS, "start_seq", F.col("chain_seq").alias("end_seq"), F.col("event_hash").alias("head_hash"))
    return rows.withColumn("payload_hash", F.sha2(F.concat_ws("|", "tenant", "app", "start_seq", "end_seq", "head_hash"), 256))


def verify_anchors(anchors: DataFrame, chain: DataFrame) -> DataFrame:
    """anchors with `ok`: they follow each other without a gap and carry the hash of their last event. Events come to the
    anchors in as many parts as their number asks for."""
    order = W.partitionBy(*KEYS).orderBy("start_seq")
    rows = anchors.withColumn("__follows", F.col("start_seq") == F.coalesce(F.lag("end_seq").over(order), F.lit(0)) + 1)
    ends = chain.select(*KEYS, F.col("chain_seq").alias("end_seq"), F.col("event_hash").alias("__hash")).repartition(_parts(chain), *KEYS, "end_seq")
    joined = rows.join(ends, [*KEYS, "end_seq"], "left")
    return joined.withColumn("ok", F.col("__follows") & F.coalesce(F.col("__hash") == F.col("head_hash"), F.lit(False))).drop("__follows", "__hash")


BLOCK = 4096  # numbers of a chain that are swept together


def anchor_coverage(events: DataFrame, anchors: DataFrame, block: int = BLOCK) -> DataFrame:
    """events with the end of the anchor that covers them, or null: as-of by sorted sweeps of both, so no range is joined.
    A chain is swept in blocks of its numbers, spread over all tasks; what the blocks before leave open is found from one
    row for each block. Anchors don't overlap."""
    of = lambda c: F.floor(F.col(c) / block).alias("__block")
    marks = anchors.select(*KEYS, of("start_seq"), F.col("start_seq").alias("chain_seq"), F.col("end_seq").alias("__end"), F.lit(None).cast("string").alias("event_id"), F.lit(0).alias("__kind"))
    rows = events.select(*KEYS, of("chain_seq"), "chain_seq", F.lit(None).cast("long").alias("__end"), "event_id", F.lit(1).alias("__kind"))
    both = rows.unionByName(marks)
    last = both.groupBy(*KEYS, "__block").agg(F.max_by(F.col("__end"), F.when(F.col("__kind") == 0, F.col("chain_seq"))).alias("__last"))
    earlier = W.partitionBy(*KEYS).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*KEYS, "__block", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    order = W.partitionBy(*KEYS, "__block").orderBy("chain_seq", "__kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = both.withColumn("__end", F.last("__end", ignorenulls=True).over(order)).where("__kind = 1")
    null_safe = [swept[c].eqNullSafe(carried[c]) for c in (*KEYS, "__block")]
    end = F.coalesce(swept["__end"], carried["__carried"])
    return swept.join(carried, null_safe, "left").select(*[swept[c] for c in KEYS], swept["chain_seq"], swept["event_id"], F.when(swept["chain_seq"] <= end, end).alias("anchor_end"))


def export_bundle(chain: DataFrame, anchors: DataFrame, tenant: str, app: str, start, end) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events of an inclusive time range in order, all anchors, and the verification of the whole chain."""
    mine = (F.col("tenant") == tenant) & (F.col("app") == app)
    own = chain.where(mine)
    return own.where(F.col("ts").between(start, end)).orderBy("chain_seq"), anchors.where(mine), verify_chain(own)


__all__ = ["SPAN", "anchor_coverage", "break_context", "build_chain", "canonical_json", "chain_faults", "chain_heads", "event_hash", "export_bundle", "make_anchors", "minimize", "sequence_events", "verify_anchors", "verify_chain"]
