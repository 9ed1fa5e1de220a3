"""Queries of file sources, sinks and streams, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, evidence
from ..rules import TOKEN_RULE
from ..sources import records
from ..sources.shared import Epochs, drained, new_path
from ..streaming import streams
from .event_queries import _RATE, LINKS, SEQ, WITH, links, whole_events
from .views import GUARD_EVENTS, table, view

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, whether it is one file or a folder of them: as a pattern, its path need not be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision events as a stream of the events table's files."""
    return spark.sql(GUARD_EVENTS.replace("FROM events\n", "FROM {events}\n"), events=table_stream(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def spool(spark: SparkSession, sf_dir: str) -> str:
    """Decision events as JSON lines, with a broken line for every hundredth event."""
    path = new_path(spark, "spool")
    g = view(spark, sf_dir, "guard_events").drop("on_fail")
    line = F.to_json(F.struct(*g.columns))
    g.select(F.explode(F.when(F.col("event_id").cast("bigint") % 100 == 0, F.array(line, F.lit("{broken"))).otherwise(F.array(line))).alias("value")).write.text(path)
    return path


@query(f"{WITH} SELECT event_id, verdict, score FROM g")
def s2_read_events_jsonl(spark, sf_dir):
    return records.read_events_jsonl(spark, spool(spark, sf_dir)).where("event_id is not null").select("event_id", "verdict", "score")


@query("SELECT text, CASE toxic WHEN 1 THEN 'toxic' ELSE '' END AS labels FROM documents JOIN labels USING (doc_id)")
def s3_read_golden(spark, sf_dir):
    path = new_path(spark, "golden")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    rows.select("text", found.alias("expected_labels")).write.json(path)
    return records.read_golden(spark, path).select("text", F.array_join("expected_labels", ",").alias("labels"))


@query("SELECT p_partkey, CAST(i AS BIGINT) AS n, 'r-' || p_partkey || '-' || i AS id FROM part CROSS JOIN (VALUES (0), (1)) t(i) WHERE p_partkey % 3 < 2")
def s4_rule_feed(spark, sf_dir):
    """Feeds of three shapes: an object, an array, and neither (null)."""
    rule = lambda i: F.concat(F.lit('{"id":"r-'), F.col("p_partkey").cast("string"), F.lit(f'-{i}","regex":"x","confidence":0.9}}'))
    listed = F.concat(F.lit("["), rule(0), F.lit(","), rule(1), F.lit("]"))
    doc = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"rules":'), listed, F.lit("}"))).when(F.col("p_partkey") % 3 == 1, listed).otherwise("{}")
    rows = table(spark, sf_dir, "part").select("p_partkey", records.rules_of_feed(doc).alias("rules"))
    return rows.select("p_partkey", F.posexplode("rules").alias("n", "r")).select("p_partkey", F.col("n").cast("long").alias("n"), "r.id")


@query(f"{WITH} SELECT tenant, app, count(*) AS n FROM g GROUP BY tenant, app")
def s14_write_events(spark, sf_dir):
    path = new_path(spark, "events")
    records.write_events(view(spark, sf_dir, "guard_events"), path)
    return spark.read.parquet(path).groupBy("tenant", "app").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SEQ} SELECT tenant, app, chain_seq, event_id FROM c WHERE tenant = 't1' AND app = 'app2' AND chain_seq > 5 AND ts < TIMESTAMP '2024-01-20' ORDER BY chain_seq LIMIT 500")
def s14_keyed_store(spark, sf_dir):
    """Two batches of events, the first written twice, and a page of one chain."""
    path = new_path(spark, "store")
    rows = evidence.sequence_events(view(spark, sf_dir, "guard_events"))
    for batch in ("a", "b", "a"):
        records.store_events(rows.where((F.col("event_id").cast("bigint") % 2 == 0) == F.lit(batch == "a")), path, batch)
    return records.scan_stored(spark, path, "t1", "app2", 5, 500, until="2024-01-19").select("tenant", "app", "chain_seq", "event_id")


@query(f"SELECT doc_id, regexp_matches(text, '{TOKEN_RULE.regex}') AS hit FROM documents")
def t1_stream_guard(spark, sf_dir):
    rows = table_stream(spark, sf_dir, "documents")
    detection.register("token-rule@1.0.0", lambda df, text: detection.secrets_scan(df, text, rules=[TOKEN_RULE]))
    return drained(streams.stream_guard(rows, "token-rule@1.0.0").select("doc_id", (F.col("verdict") == "FAIL").alias("hit")))


def publish(spark: SparkSession, folder: str, seq: int, created_at: str, guards: tuple[str, ...], broken: bool = False) -> None:
    """A bundle for prod in the folder; a broken one was changed after it was hashed."""
    listed = ",".join(f'{{"guard_id":"{g}","tenant":"{t}"}}' for t in ("t0", "t1", "t2") for g in guards)
    manifest = f'{{"bundle_seq":{seq},"created_at":"{created_at}","env":"prod","policies":[{listed}],"tenant":"all"}}'
    row = spark.range(1).select(F.lit(manifest).alias("manifest"), F.concat(F.lit("sha256:"), F.sha2(F.lit(manifest.replace("g-", "h-") if broken else manifest), 256)).alias("manifest_hash"))
    row.write.mode("append").json(folder)


def apply_bundle(batch: DataFrame, bundles: DataFrame) -> DataFrame:
    """The events whose guard a bundle names for their tenant, with the bundle's number."""
    named = F.from_json("manifest", "policies array<struct<guard_id:string,tenant:string>>")["policies"]
    rules = bundles.select("env", "bundle_seq", F.explode(named).alias("p")).select("env", "bundle_seq", "p.tenant", "p.guard_id")
    return batch.join(rules, ["tenant", "env", "guard_id"]).select("event_id", "guard_id", "bundle_seq")


@query(f"""{WITH} SELECT event_id, guard_id, CASE WHEN CAST(event_id AS BIGINT) % 4 = 0 THEN 1::BIGINT ELSE 2 END AS bundle_seq FROM g
WHERE guard_id = 'g-pii-out' OR (guard_id = 'g-safety-io' AND CAST(event_id AS BIGINT) % 4 <> 0)""")
def t2_policy_swap(spark, sf_dir):
    """Four files of events, each read after a restart: under the first bundle, a newer one, and then, as the next ones are
    broken and stale, under that one still."""
    path = new_path(spark, "swap")
    g = view(spark, sf_dir, "guard_events")
    steps = [(1, "2024-01-01T00:00:00Z", ("g-pii-out",), False), (2, "2024-01-02T00:00:00Z", ("g-pii-out", "g-safety-io"), False), (3, "2024-01-03T00:00:00Z", ("g-secrets-io",), True), (4, "2023-12-01T00:00:00Z", ("g-secrets-io",), False)]
    for k, step in enumerate(steps):
        publish(spark, f"{path}/bundles", *step)
        g.where(F.col("event_id").cast("bigint") % 4 == k).write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema(g.schema).parquet(f"{path}/in")
        writer = streams.with_latest_policies(rows, f"{path}/bundles", path, apply_bundle, lambda df, epoch: Epochs(spark, f"{path}/out").write(df, epoch), now=F.lit("2024-01-04T00:00:00Z").cast("timestamp"))
        writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return Epochs(spark, f"{path}/out").all()


@query(f"{WITH} SELECT event_id, verdict FROM g")
def t3_dedup_stream(spark, sf_dir):
    s = event_stream(spark, sf_dir).select("event_id", "ts", "verdict")
    return drained(streams.dedup_stream(s.unionByName(s), "60 days")).select("event_id", "verdict")


_LINKED = ("tenant", "app", "event_id", "chain_seq", "prev_event_hash", "event_hash")
#: Every seventh event comes in the second file; most of these are late.
_LATE = "CAST(event_id AS BIGINT) % 7 = 3"


def linked(rows: DataFrame, late: str) -> DataFrame:
    return streams.stream_chain(rows, late).select(*_LINKED)


def two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of two batches of as many files each, one of which comes late. The number of files follows
    that of the events, so that no task writes them all."""
    path = new_path(spark, "late")
    rows = whole_events(spark, sf_dir)
    n = rows.count() // evidence.TOGETHER + 1
    for k, part in enumerate((~F.expr(_LATE), F.expr(_LATE))):
        rows.where(part).repartition(n).write.parquet(f"{path}/part={k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", n).parquet(f"{path}/part=*")


@query(f"{LINKS} SELECT {', '.join(_LINKED)} FROM h")
def t4_stream_chain(spark, sf_dir):
    rows = event_stream(spark, sf_dir).drop("on_fail").withColumns({"spans": F.lit(None).cast(evidence.SPAN), "policy": F.concat(F.lit("p-"), "tenant"), "text_hash": F.lit(None).cast("string")})
    return linked(rows, "append")


@query(f"{links(f'SELECT *, row_number() OVER (PARTITION BY tenant, app ORDER BY {_LATE}, ts, event_id) AS chain_seq FROM g')} SELECT {', '.join(_LINKED)} FROM h")
def t5_late_appended(spark, sf_dir):
    return linked(two_files(spark, sf_dir), "append")


@query(f"{links(f'SELECT *, row_number() OVER (PARTITION BY tenant, app ORDER BY {_LATE}, ts, event_id) AS chain_seq FROM g WHERE NOT {_LATE} OR ts >= (SELECT max(ts) FROM g WHERE NOT {_LATE})')} SELECT {', '.join(_LINKED)} FROM h")
def t5_late_dropped(spark, sf_dir):
    return linked(two_files(spark, sf_dir), "drop")


@query(f"{WITH}, {_RATE} SELECT * FROM r")
def t6_stream_rates(spark, sf_dir):
    out = drained(streams.stream_rates(event_stream(spark, sf_dir), ["verdict"]), "complete")
    return out.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query(f"""{WITH}, e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tenant, app, guard_id ORDER BY ts) < INTERVAL 60 minute THEN 0 ELSE 1 END AS new FROM g WHERE verdict = 'ERROR'),
i AS (SELECT *, sum(new) OVER (PARTITION BY tenant, app, guard_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT tenant, app, guard_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_errors FROM i GROUP BY tenant, app, guard_id, run""")
def t7_stream_incidents(spark, sf_dir):
    out = drained(streams.stream_incidents(event_stream(spark, sf_dir), "60 minutes"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query(f"{WITH} SELECT event_id, verdict FROM g")
def t8_replay(spark, sf_dir):
    rows = streams.replay(spark, spool(spark, sf_dir)).where("event_id is not null").select("event_id", "verdict")
    return drained(rows)
