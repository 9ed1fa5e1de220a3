"""Sources and sinks: event batches, JSON lines, golden sets, rule feeds, scans, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.detection import SPAN

EVENT = (
    "event_id string, ts timestamp, tenant string, app string, env string, chain_seq bigint, request_id string, policy string, bundle_seq bigint, guard_id string, scenario string, "
    f"detector string, direction string, verdict string, score double, action_taken string, latency_ms bigint, evidence_mode string, spans {SPAN}, text_hash string, prev_event_hash string, "
    "event_hash string, is_shadow boolean"
)
ENUMS = {"direction": ("input", "output"), "verdict": ("PASS", "FAIL", "ERROR", "NEEDS_ESCALATION"), "evidence_mode": ("none", "spans", "full_text")}
FEED_RULE = "array<struct<id:string,description:string,regex:string,keywords:array<string>,confidence:double>>"


def ingest_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows lack an id, hold a value that an enum doesn't know, or repeat an event id (the first by ts
    stays); their `reason` says so."""
    reason = F.when(F.col("event_id").isNull(), "event_id")
    for c, values in ENUMS.items():
        if c in df.columns:
            reason = reason.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), c)
    rows = df.withColumn("reason", reason)
    # equal ids only: a null id is rejected already and would be one hot key
    order = W.partitionBy("event_id").orderBy(F.col("reason").isNotNull(), "ts")
    ok = rows.where("event_id is not null").withColumn("__n", F.row_number().over(order))
    ok = ok.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__n") > 1), "duplicate").otherwise(F.col("reason"))).drop("__n")
    every = ok.unionByName(rows.where("event_id is null"))
    return every.where("reason is null").drop("reason"), every.where("reason is not null")


def read_events_jsonl(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """DROPMALFORMED skips bad lines (replay), FAILFAST stops at them (audit)."""
    return spark.read.schema(EVENT).option("mode", mode).json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, expected_labels array<string>").json(path)


def rules_of_feed(text: Column) -> Column:
    """Rules of a feed: an object with `rules`, or a bare array; null for anything else."""
    return F.coalesce(F.from_json(text, f"rules {FEED_RULE}")["rules"], F.when(F.trim(text).startswith("["), F.from_json(text, FEED_RULE)))


def read_rule_feed(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).withColumn("rules", rules_of_feed(F.col("value")))
    checked = rows.withColumn("rules", F.when(F.col("rules").isNull(), F.raise_error(F.lit("a rule feed is an object with rules, or an array"))).otherwise(F.col("rules")))
    return checked.select(F.inline("rules"))


def scan_events(chain: DataFrame, tenant: str, app: str, since_seq: int = 0, limit: int = 5000) -> DataFrame:
    """The next page of a chain, by key."""
    rows = chain.where((F.col("tenant") == tenant) & (F.col("app") == app) & (F.col("chain_seq") > since_seq))
    return rows.orderBy("chain_seq").limit(min(limit, 5000))


def scan_feedback(feedback: DataFrame, tenant: str, app: str | None = None, guard: str | None = None, since=None, limit: int | None = None) -> DataFrame:
    rows = feedback.where(F.col("tenant") == tenant)
    for c, v in (("app", app), ("guard_id", guard)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    rows = (rows.where(F.col("at") >= since) if since is not None else rows).orderBy("at", "event_id")
    return rows.limit(limit) if limit else rows


def flatten_conversation(turns: DataFrame) -> DataFrame:
    """conv_id and all its texts, in order of turn, joined by line feeds."""
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def chunk_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Paragraphs (keep, para from 1, chunk): parts between blank lines, stripped, without empty ones."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(trimmed, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select(*keep, F.posexplode(parts).alias("para", "chunk")).withColumn("para", F.col("para") + 1)


def catalog_conflicts(catalog: DataFrame) -> DataFrame:
    """The catalog in order with the number of rows that share a (detector_id, version)."""
    return catalog.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("detector_id", "version"))).orderBy("detector_id", "version")


def policy_versions(policies: DataFrame, tenant: str, policy_id: str | None = None) -> DataFrame:
    rows = policies.where(F.col("tenant") == tenant)
    return (rows.where(F.col("policy_id") == policy_id) if policy_id else rows).orderBy(F.col("created_at").desc(), F.col("policy_key").desc())


def approval_queue(policies: DataFrame) -> DataFrame:
    return policies.where("status = 'in_review'")


def write_events(events: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Appends events, partitioned by tenant, app and day."""
    events.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("tenant", "app", "dt").format(fmt).save(path)


def store_events(events: DataFrame, path: str, batch: str) -> None:
    """Events under their key: folders by tenant, app, day and batch, sorted by chain_seq within, so that a page of a chain
    reads few files and few of their row groups. Rows are dealt by range, a hot chain over many tasks. A batch that is
    written again replaces its own folders, so a retry doubles nothing."""
    rows = events.withColumns({"dt": F.to_date("ts"), "batch": F.lit(batch)})
    rows = rows.repartitionByRange("tenant", "app", "dt", "chain_seq").sortWithinPartitions("tenant", "app", "dt", "chain_seq")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "app", "dt", "batch").parquet(path)


def scan_stored(spark: SparkSession, path: str, tenant: str, app: str, since_seq: int = 0, limit: int = 5000, since=None, until=None) -> DataFrame:
    """The next page of a stored chain, of the days from since until the one given, both included: folders are pruned by
    key and day, row groups by number."""
    rows = spark.read.parquet(path)
    for bound, ok in ((since, F.col("dt") >= F.lit(since)), (until, F.col("dt") <= F.lit(until))):
        rows = rows.where(ok) if bound is not None else rows
    return scan_events(rows, tenant, app, since_seq, limit).drop("dt", "batch")
