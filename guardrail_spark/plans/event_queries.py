"""Queries over decision events: sources, evidence, metrics, tuning, with the same in DuckDB's SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wilson
from ..operators import evidence, metrics, tuning
from ..sources import records
from .views import CATALOG, FEEDBACK, GUARD_EVENTS, table, view

QUERIES, ORACLES = {}, {}
WITH = f"WITH g AS ({GUARD_EVENTS}), f AS ({FEEDBACK})"
#: Sequence numbers by (tenant, app).
SEQ = f"{WITH}, c AS (SELECT *, row_number() OVER (PARTITION BY tenant, app ORDER BY ts, event_id) AS chain_seq FROM g)"

_S = lambda c: f"""'"{c}":"' || {c} || '",'"""
#: Canonical events without the end of each object: what chain() makes of the view's columns.
_LINK = f"""'{{"action_taken":null,' || {_S("app")} || '"bundle_seq":null,"chain_seq":' || chain_seq || ',"detector":null,' || {_S("direction")} || {_S("env")} || {_S("event_id")} || {_S("evidence_mode")} || {_S("guard_id")}
|| '"latency_ms":' || latency_ms || ',"policy":"p-' || tenant || '","prev_event_hash":'"""
_LINK_END = f"""',' || {_S("request_id")} || {_S("scenario")} || '"score":' || CASE WHEN score = floor(score) THEN CAST(CAST(score AS BIGINT) AS VARCHAR) ELSE CAST(score AS VARCHAR) END || ',"spans":null,' || {_S("tenant")}
|| '"text_hash":null,"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts = date_trunc('second', ts) THEN '' ELSE strftime(ts, '.%f') END || 'Z","verdict":"' || verdict || '"}}'"""


def links(numbered: str) -> str:
    """SQL of the chains h, link by link, of events with chain_seq."""
    return f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, c AS ({numbered}), t AS (SELECT *, {_LINK} AS front, {_LINK_END} AS back FROM c),
h AS (SELECT tenant, app, chain_seq, event_id, ts, NULL::VARCHAR AS prev_event_hash, 'sha256:' || sha256(front || 'null' || back) AS event_hash FROM t WHERE chain_seq = 1
UNION ALL SELECT t.tenant, t.app, t.chain_seq, t.event_id, t.ts, h.event_hash, 'sha256:' || sha256(t.front || '"' || h.event_hash || '"' || t.back) FROM h JOIN t ON t.tenant = h.tenant AND t.app = h.app AND t.chain_seq = h.chain_seq + 1)"""


LINKS = links("SELECT *, row_number() OVER (PARTITION BY tenant, app ORDER BY ts, event_id) AS chain_seq FROM g")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "guard_events")


def fb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "feedback")


def whole_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with all fields that a chain covers, as far as the view has them."""
    rows = ge(spark, sf_dir).withColumns({"spans": F.lit(None).cast(evidence.SPAN), "policy": F.concat(F.lit("p-"), "tenant"), "text_hash": F.lit(None).cast("string")})
    return rows.drop("on_fail")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.build_chain(whole_events(spark, sf_dir))


@query(f"""{WITH}, d AS (SELECT event_id, ts, CASE WHEN CAST(event_id AS BIGINT) % 50 = 0 THEN 'sideways' ELSE direction END AS direction, verdict FROM g UNION ALL SELECT event_id, ts, direction, verdict FROM g WHERE CAST(event_id AS BIGINT) % 10 = 1)
SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM (SELECT CASE WHEN direction = 'sideways' THEN 'direction' WHEN row_number() OVER (PARTITION BY event_id, direction = 'sideways' ORDER BY ts) > 1 THEN 'duplicate' END AS reason FROM d) q GROUP BY 1""")
def s1_ingest_events(spark, sf_dir):
    g = ge(spark, sf_dir).select("event_id", "ts", "direction", "verdict")
    k = F.col("event_id").cast("bigint")
    rows = g.withColumn("direction", F.when(k % 50 == 0, "sideways").otherwise(F.col("direction"))).unionByName(g.where(k % 10 == 1))
    good, bad = records.ingest_events(rows)
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SEQ} SELECT chain_seq, event_id FROM c WHERE tenant = 't1' AND app = 'app2' AND chain_seq > 10 ORDER BY chain_seq LIMIT 100")
def s6_scan_events(spark, sf_dir):
    return records.scan_events(evidence.sequence_events(ge(spark, sf_dir)), "t1", "app2", 10, 100).select("chain_seq", "event_id")


@query(f"""{LINKS}, r AS (SELECT max(chain_seq) AS n, arg_max(event_hash, chain_seq) AS head_hash FROM h WHERE tenant = 't1' AND app = 'app2')
SELECT chain_seq, event_id, event_hash, CAST(1 AS BIGINT) AS anchor_start, n AS anchor_end, sha256('t1|app2|1|' || n || '|' || head_hash) AS payload_hash, n AS checked, true AS ok, r.head_hash
FROM h, r WHERE tenant = 't1' AND app = 'app2' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'""")
def s7_export_bundle(spark, sf_dir):
    """Events of a range, each with the chain's anchors and the verification."""
    c = chain(spark, sf_dir)
    day = lambda n: F.lit(datetime.datetime(2024, 1, n)).cast("timestamp_ntz")
    events, anchors, report = evidence.export_bundle(c, evidence.make_anchors(evidence.chain_heads(c)), "t1", "app2", day(5), day(10))
    anchors = anchors.select("tenant", "app", F.col("start_seq").cast("long").alias("anchor_start"), F.col("end_seq").alias("anchor_end"), "payload_hash")
    # all events are of one chain, so anchors and report (a row each) come to them and not they to one task
    whole = events.select("tenant", "app", "chain_seq", "event_id", "event_hash").join(F.broadcast(anchors), ["tenant", "app"]).join(F.broadcast(report), ["tenant", "app"])
    return whole.select("chain_seq", "event_id", "event_hash", "anchor_start", "anchor_end", "payload_hash", "checked", "ok", "head_hash")


@query(f"{WITH} SELECT event_id, disposition FROM f WHERE tenant = 't0' AND guard_id = 'g-pii-out' AND f.\"at\" >= TIMESTAMP '2024-01-10' ORDER BY f.\"at\", event_id LIMIT 50")
def s8_scan_feedback(spark, sf_dir):
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    return records.scan_feedback(fb(spark, sf_dir), "t0", guard="g-pii-out", since=since, limit=50).select("event_id", "disposition")


@query(f"{WITH} SELECT evidence_mode, count(*) AS n, count(*) FILTER (evidence_mode <> 'none') AS n_spans FROM g GROUP BY evidence_mode")
def e1_minimize(spark, sf_dir):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("X").alias("label"), F.lit(1.0).alias("confidence")))
    rows = evidence.minimize(ge(spark, sf_dir).withColumn("spans", spans.cast(evidence.SPAN)))
    return rows.groupBy("evidence_mode").agg(F.count(F.lit(1)).alias("n"), F.count("spans").alias("n_spans"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS text_hash FROM documents")
def e2_text_hash(spark, sf_dir):
    from ..functions import text_hash

    return table(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"))


@query(f"{SEQ} SELECT event_id, {_LINK} || 'null' || {_LINK_END} AS doc FROM c")
def e3_canonical_json(spark, sf_dir):
    rows = evidence.sequence_events(evidence.minimize(whole_events(spark, sf_dir)))
    return rows.select("event_id", evidence.canonical_json(rows).alias("doc"))


@query(f"{SEQ} SELECT event_id, 'sha256:' || sha256({_LINK} || 'null' || {_LINK_END}) AS event_hash FROM c")
def e4_event_hash(spark, sf_dir):
    rows = evidence.sequence_events(evidence.minimize(whole_events(spark, sf_dir)))
    return rows.select("event_id", evidence.event_hash(rows).alias("event_hash"))


@query(f"{LINKS} SELECT event_id, tenant, app, chain_seq, prev_event_hash, event_hash FROM h")
def e5_build_chain(spark, sf_dir):
    return chain(spark, sf_dir).select("event_id", "tenant", "app", "chain_seq", "prev_event_hash", "event_hash")


@query(f"{LINKS} SELECT tenant, app, max(chain_seq) AS chain_seq, arg_max(event_hash, chain_seq) AS event_hash FROM h GROUP BY tenant, app")
def e6_chain_heads(spark, sf_dir):
    return evidence.chain_heads(chain(spark, sf_dir)).select("tenant", "app", "chain_seq", "event_hash")


@query(f"""{SEQ}, b AS (SELECT tenant, app, count(*) AS n, min(chain_seq) FILTER (CAST(event_id AS BIGINT) % 997 = 5) AS bad FROM c GROUP BY tenant, app)
SELECT tenant, app, coalesce(bad - 1, n) AS checked, bad IS NULL AS ok, bad AS first_bad_seq, CASE WHEN bad IS NOT NULL THEN 'event_hash' END AS reason FROM b""")
def e7_verify_chain(spark, sf_dir):
    """Verification of chains in which some verdicts were changed afterwards."""
    c = chain(spark, sf_dir)
    forged = c.withColumn("verdict", F.when(F.col("event_id").cast("bigint") % 997 == 5, F.concat("verdict", F.lit("?"))).otherwise(F.col("verdict")))
    return evidence.verify_chain(forged).drop("head_hash")


@query(f"{LINKS} SELECT tenant, app, count(*) AS checked, true AS ok, arg_max(event_hash, chain_seq) AS head_hash FROM h GROUP BY tenant, app")
def e8_verify_report(spark, sf_dir):
    return evidence.verify_chain(chain(spark, sf_dir)).select("tenant", "app", "checked", "ok", "head_hash")


@query(f"{SEQ} SELECT tenant, app, 101 AS start_seq, max(chain_seq) AS end_seq FROM c GROUP BY tenant, app HAVING max(chain_seq) > 100")
def e9_make_anchors(spark, sf_dir):
    heads = evidence.chain_heads(chain(spark, sf_dir))
    first = heads.select("tenant", "app", F.lit(100).cast("long").alias("end_seq"))
    return evidence.make_anchors(heads, first).select("tenant", "app", F.col("start_seq").cast("int").alias("start_seq"), "end_seq")


@query(f"{SEQ} SELECT tenant, app, max(chain_seq) AS end_seq, tenant <> 't1' AS ok FROM c GROUP BY tenant, app")
def e10_verify_anchors(spark, sf_dir):
    c = chain(spark, sf_dir)
    anchors = evidence.make_anchors(evidence.chain_heads(c)).withColumn("head_hash", F.when(F.col("tenant") == "t1", "sha256:0").otherwise(F.col("head_hash")))
    return evidence.verify_anchors(anchors, c).select("tenant", "app", "end_seq", "ok")


@query(f"""{SEQ}, b AS (SELECT tenant, app, min(chain_seq) AS bad FROM c WHERE CAST(event_id AS BIGINT) % 997 = 5 GROUP BY tenant, app)
SELECT c.tenant, c.app, c.chain_seq, c.event_id FROM c JOIN b ON c.tenant = b.tenant AND c.app = b.app AND c.chain_seq BETWEEN b.bad - 2 AND b.bad + 2""")
def e11_break_context(spark, sf_dir):
    c = chain(spark, sf_dir)
    forged = c.withColumn("verdict", F.when(F.col("event_id").cast("bigint") % 997 == 5, F.concat("verdict", F.lit("?"))).otherwise(F.col("verdict")))
    return evidence.break_context(forged, evidence.verify_chain(forged)).select("tenant", "app", "chain_seq", "event_id")


@query(f"{SEQ} SELECT tenant, app, chain_seq, event_id, CASE WHEN chain_seq <= 100 THEN 100 WHEN chain_seq BETWEEN 121 AND 200 THEN 200 END AS anchor_end FROM c")
def j20_anchor_coverage(spark, sf_dir):
    c = evidence.sequence_events(ge(spark, sf_dir))
    keys = c.select("tenant", "app").distinct()
    anchors = keys.select("tenant", "app", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(100).alias("b")), F.struct(F.lit(121).alias("a"), F.lit(200).alias("b")))).alias("x"))
    anchors = anchors.select("tenant", "app", F.col("x.a").cast("long").alias("start_seq"), F.col("x.b").cast("long").alias("end_seq"))
    return evidence.anchor_coverage(c, anchors).withColumn("anchor_end", F.col("anchor_end").cast("int"))


_COUNTER = ", ".join(metrics.COUNTER_KEYS)


@query(f"{WITH} SELECT {_COUNTER}, count(*) AS n, count(*) FILTER (is_shadow) AS n_shadow, count(*) FILTER (verdict = 'ERROR') AS n_error FROM g GROUP BY {_COUNTER}")
def g1_guard_counts(spark, sf_dir):
    return metrics.guard_counts(ge(spark, sf_dir))


@query(f"{WITH} SELECT guard_id, count(*) FILTER (is_shadow) AS n_shadow FROM g GROUP BY guard_id")
def g2_shadow_counts(spark, sf_dir):
    return metrics.guard_counts(ge(spark, sf_dir)).groupBy("guard_id").agg(F.sum("n_shadow").alias("n_shadow"))


@query(f"{WITH} SELECT guard_id, count(*) FILTER (verdict = 'ERROR') AS n_error FROM g GROUP BY guard_id")
def g3_error_counts(spark, sf_dir):
    return metrics.guard_counts(ge(spark, sf_dir)).groupBy("guard_id").agg(F.sum("n_error").alias("n_error"))


_LE = ", ".join(f"({b})" for b in metrics.BUCKETS)
_HIST = f"""h AS (SELECT k.guard_id, b.le, count(*) FILTER (g.latency_ms <= coalesce(b.le, 1000000000)) AS n, CAST(sum(g.latency_ms) AS BIGINT) AS latency_sum, count(*) AS latency_count
FROM (SELECT DISTINCT guard_id FROM g) k CROSS JOIN (VALUES {_LE}, (NULL)) b(le) JOIN g ON g.guard_id = k.guard_id GROUP BY k.guard_id, b.le)"""


@query(f"{WITH}, {_HIST} SELECT * FROM h")
def g4_latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(ge(spark, sf_dir), ["guard_id"])


@query(f"{WITH} SELECT guard_id, CAST(sum(latency_ms) AS BIGINT) AS latency_sum, count(*) AS latency_count FROM g GROUP BY guard_id")
def g5_latency_sums(spark, sf_dir):
    return metrics.latency_histogram(ge(spark, sf_dir), ["guard_id"]).where("le is null").select("guard_id", "latency_sum", "latency_count")


@query(f"{WITH} SELECT app, direction, on_fail AS action, count(*) AS n FROM g WHERE verdict = 'FAIL' AND NOT is_shadow GROUP BY ALL")
def g6_action_counts(spark, sf_dir):
    return metrics.action_counts(ge(spark, sf_dir))


_BUNDLES = "SELECT concat('t', CAST(o_custkey % 7 AS STRING)) AS tenant, CASE o_custkey % 2 WHEN 0 THEN 'prod' ELSE 'dev' END AS env, o_orderkey + 1 AS bundle_seq, o_orderdate AS created_at, o_orderkey % 9 AS n_policies FROM orders"


def bundles(spark, sf_dir):
    return spark.sql(_BUNDLES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query(f"""WITH b AS ({_BUNDLES}) SELECT tenant, env, max(bundle_seq) AS bundle_seq, max_by(n_policies, bundle_seq) AS n_policies, count(*) AS installs, CAST(date_diff('second', max_by(created_at, bundle_seq), TIMESTAMP '2005-01-01') AS BIGINT) AS age_seconds FROM b GROUP BY tenant, env""")
def g7_bundle_gauges(spark, sf_dir):
    return metrics.bundle_gauges(bundles(spark, sf_dir), F.lit("2005-01-01").cast("timestamp_ntz"))


@query(f"""WITH b AS ({_BUNDLES}), n AS (SELECT tenant, env, date_diff('second', max_by(created_at, bundle_seq), TIMESTAMP '1998-08-05') AS age FROM b GROUP BY tenant, env),
e AS (SELECT DISTINCT tenant, unnest(['prod', 'dev', 'qa']) AS env FROM b), j AS (SELECT e.tenant, e.env, age FROM e LEFT JOIN n ON e.tenant = n.tenant AND e.env = n.env)
SELECT tenant, env, 'no_bundle_installed' AS alert, 'warning' AS severity FROM j WHERE age IS NULL UNION ALL SELECT tenant, env, 'bundle_stale', 'warning' FROM j WHERE age > 259500 UNION ALL SELECT tenant, env, 'bundle_age_critical', 'critical' FROM j WHERE age > 605100""")
def g11_bundle_alerts(spark, sf_dir):
    b = bundles(spark, sf_dir)
    expected = b.select("tenant", F.explode(F.array(F.lit("prod"), F.lit("dev"), F.lit("qa"))).alias("env"))
    return metrics.bundle_alerts(expected, b, F.lit("1998-08-05").cast("timestamp_ntz"))


_RATE = """r AS (SELECT verdict, w AS window_end, count(*) AS n, count(*) / 300.0::DOUBLE AS rate FROM (SELECT verdict, unnest(generate_series(time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute, time_bucket(INTERVAL 1 minute, ts) + INTERVAL 5 minute, INTERVAL 1 minute)) AS w FROM g) q GROUP BY verdict, w)"""


@query(f"{WITH}, {_RATE} SELECT * FROM r")
def g9_rates(spark, sf_dir):
    return metrics.rates(ge(spark, sf_dir), ["verdict"])


@query(f"""{WITH}, {_HIST}, o AS (SELECT *, coalesce(lag(n) OVER w, 0) AS before, coalesce(lag(le) OVER w, 0) AS low, latency_count * 0.95::DOUBLE AS target FROM h WINDOW w AS (PARTITION BY guard_id ORDER BY le NULLS LAST))
SELECT guard_id, CAST(coalesce(low + (le - low) * (target - before) / (n - before), low) AS DOUBLE) AS value FROM o WHERE n >= target AND before < target""")
def g10_p95_latency(spark, sf_dir):
    return metrics.quantile_from_histogram(metrics.latency_histogram(ge(spark, sf_dir), ["guard_id"]), ["guard_id"], 0.95)


@query(f"{WITH} SELECT guard_id, quantile_cont(latency_ms, 0.95) AS value FROM g GROUP BY guard_id")
def g10_p95_exact(spark, sf_dir):
    return ge(spark, sf_dir).groupBy("guard_id").agg(F.percentile("latency_ms", 0.95).alias("value"))


@query(f"""{WITH}, {_RATE}, m AS (SELECT *, CASE WHEN (rate > 0.003) <> lag(rate > 0.003) OVER (PARTITION BY verdict ORDER BY window_end) THEN 1 WHEN lag(rate) OVER (PARTITION BY verdict ORDER BY window_end) IS NULL THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY verdict ORDER BY window_end) AS run FROM m), s AS (SELECT verdict, min(window_end) AS first_at, max(window_end) AS last_at, count(*) AS n, bool_and(rate > 0.003) AS state FROM i GROUP BY verdict, run)
SELECT verdict, first_at, last_at, n FROM s WHERE state AND last_at - first_at >= INTERVAL 10 minute""")
def g11_alerts(spark, sf_dir):
    return metrics.alerts(metrics.rates(ge(spark, sf_dir), ["verdict"]), ["verdict"], 0.003, "10 minutes")


_PAIRS = "p AS (SELECT request_id, guard_id, arg_min(verdict, (ts, event_id)) FILTER (NOT is_shadow) AS live, arg_min(verdict, (ts, event_id)) FILTER (is_shadow) AS shadow FROM g GROUP BY request_id, guard_id)"


@query(f"{WITH}, {_PAIRS} SELECT * FROM p WHERE live IS NOT NULL AND shadow IS NOT NULL")
def j19_pair_shadow(spark, sf_dir):
    return metrics.pair_shadow(ge(spark, sf_dir))


@query(f"""{WITH}, {_PAIRS}, d AS (SELECT guard_id, count(*) AS pairs, count(*) FILTER (live = 'FAIL') AS live_fail, count(*) FILTER (shadow = 'FAIL') AS shadow_fail, count(*) FILTER (live = shadow) AS agree FROM p WHERE live IS NOT NULL AND shadow IS NOT NULL GROUP BY guard_id)
SELECT *, pairs - agree AS diverge, 100.0::DOUBLE * agree / pairs AS agree_pct, 100.0::DOUBLE * live_fail / pairs AS live_fail_pct, 100.0::DOUBLE * shadow_fail / pairs AS shadow_fail_pct FROM d""")
def g12_shadow_delta(spark, sf_dir):
    return metrics.shadow_delta(ge(spark, sf_dir))


@query(f"{WITH} SELECT scenario, count(*) AS total, count(*) FILTER (verdict = 'FAIL') AS fail, count(*) FILTER (is_shadow) AS shadow FROM g GROUP BY ROLLUP (scenario)")
def g13_evidence_summary(spark, sf_dir):
    return metrics.evidence_summary(ge(spark, sf_dir))


@query(f"""{WITH}, k AS (SELECT guard_id, count(*) FILTER (verdict = 'FAIL') AS k, count(*) AS n FROM g GROUP BY guard_id), p AS (SELECT *, k / n::DOUBLE AS p, 1.96 * 1.96 / n AS zz FROM k)
SELECT guard_id, round(greatest(0.0, (p + zz / 2 - 1.96 * sqrt(p * (1 - p) / n + zz / 4 / n)) / (1 + zz)), 9)::DOUBLE AS low, round(least(1.0, (p + zz / 2 + 1.96 * sqrt(p * (1 - p) / n + zz / 4 / n)) / (1 + zz)), 9)::DOUBLE AS high FROM p""")
def g14_wilson(spark, sf_dir):
    k = ge(spark, sf_dir).groupBy("guard_id").agg(F.count_if(F.col("verdict") == "FAIL").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return k.select("guard_id", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_SAMPLES = "s AS (SELECT f.event_id, f.guard_id, g.score, f.disposition IN ('true_positive', 'false_negative') AS positive FROM f JOIN g ON f.event_id = g.event_id)"


@query(f"{WITH}, {_SAMPLES} SELECT * FROM s")
def j7_labelled_samples(spark, sf_dir):
    return tuning.labelled_samples(ge(spark, sf_dir), fb(spark, sf_dir))


@query(f"{WITH} SELECT event_id, disposition FROM f WHERE CAST(event_id AS BIGINT) % 2 = 1")
def j8_orphan_feedback(spark, sf_dir):
    return tuning.orphan_feedback(ge(spark, sf_dir).where("not is_shadow"), fb(spark, sf_dir)).select("event_id", "disposition")


@query(f"""{WITH}, {_SAMPLES} SELECT guard_id, count(*) FILTER (score >= 0.7 AND positive) AS tp, count(*) FILTER (score >= 0.7 AND NOT positive) AS fp, count(*) FILTER (score < 0.7 AND positive) AS fn, count(*) FILTER (score < 0.7 AND NOT positive) AS tn FROM s GROUP BY guard_id""")
def g15_confusion_at(spark, sf_dir):
    s = tuning.labelled_samples(ge(spark, sf_dir), fb(spark, sf_dir))
    return tuning.confusion_at(s, F.array(F.lit(0.7))).select("guard_id", "tp", "fp", "fn", "tn")


_GRID = tuning.grid(0.7)
_GRID_SQL = "t(i, t) AS (VALUES " + ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(_GRID)) + ")"


@query(f"""{WITH}, {_SAMPLES}, {_GRID_SQL} SELECT guard_id, i, t, count(*) FILTER (score >= t AND positive) AS tp, count(*) FILTER (score >= t AND NOT positive) AS fp, count(*) FILTER (score < t AND positive) AS fn, count(*) FILTER (score < t AND NOT positive) AS tn FROM s CROSS JOIN t GROUP BY guard_id, i, t""")
def g16_threshold_grid(spark, sf_dir):
    s = tuning.labelled_samples(ge(spark, sf_dir), fb(spark, sf_dir))
    return tuning.confusion_at(s, F.array(*[F.lit(t) for t in _GRID])).select("guard_id", "i", "t", "tp", "fp", "fn", "tn")


@query(f"""{WITH}, {_SAMPLES}, {_GRID_SQL}, c AS (SELECT guard_id, i, t, count(*) FILTER (score >= t AND positive) AS tp, count(*) FILTER (score >= t AND NOT positive) AS fp, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg,
  count(*) FILTER (score >= 0.7 AND NOT positive) / nullif(count(*) FILTER (NOT positive), 0)::DOUBLE AS was FROM s CROSS JOIN t GROUP BY guard_id, i, t),
r AS (SELECT *, fp / neg::DOUBLE AS fp_rate, (pos - tp) / pos::DOUBLE AS fn_rate, 1.96 * 1.96 / neg AS zz FROM c WHERE pos >= 10 AND neg >= 10),
o AS (SELECT *, row_number() OVER (PARTITION BY guard_id ORDER BY fp_rate, i) AS rn FROM r WHERE fp_rate < was AND fn_rate <= 0.005 AND least(1.0, (fp_rate + zz / 2 + 1.96 * sqrt(fp_rate * (1 - fp_rate) / neg + zz / 4 / neg)) / (1 + zz)) < was)
SELECT guard_id, 0.7::DOUBLE AS before, round(t, 3) AS after, fp_rate, fn_rate FROM o WHERE rn = 1 AND abs(t - 0.7) >= 0.005""")
def g17_recommend_thresholds(spark, sf_dir):
    s = tuning.labelled_samples(ge(spark, sf_dir), fb(spark, sf_dir))
    return tuning.recommend_thresholds(s, s.select("guard_id").distinct().withColumn("threshold", F.lit(0.7)))


_LABELS = "l AS (SELECT label, count(*) FILTER (e AND d) AS tp, count(*) FILTER (d AND NOT e) AS fp, count(*) FILTER (e AND NOT d) AS fn FROM (SELECT CASE WHEN lang = 'en' THEN 'toxic_en' ELSE 'toxic_xx' END AS label, toxic = 1 AS e, regexp_matches(text, 'idiot|moron|trash|scum') AS d FROM documents JOIN labels USING (doc_id)) q GROUP BY label HAVING tp + fp + fn > 0)"


def _confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("lang") == "en", "toxic_en").otherwise("toxic_xx")
    one = lambda hit: F.when(hit, F.array(label)).otherwise(F.array().cast("array<string>"))
    return tuning.label_confusion(rows.select(one(F.col("toxic") == 1).alias("e"), one(F.col("text").rlike("idiot|moron|trash|scum")).alias("d")), "e", "d")


@query(f"WITH {_LABELS} SELECT * FROM l")
def j18_label_confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


_PRF = f"""WITH {_LABELS}, t AS (SELECT * FROM l UNION ALL SELECT 'TOTAL', sum(tp), sum(fp), sum(fn) FROM l),
r AS (SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1.0 END AS recall FROM t)"""


@query(f"{_PRF} SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1 FROM r")
def g19_prf(spark, sf_dir):
    return tuning.prf(_confusion(spark, sf_dir))


@query(f"{_PRF} SELECT precision::DOUBLE AS precision, precision >= 0.95 AS passed FROM r WHERE label = 'TOTAL'")
def g20_gate(spark, sf_dir):
    return tuning.gate(tuning.prf(_confusion(spark, sf_dir)))


_BENCH = "SELECT concat('det', CAST(CAST(event_id AS BIGINT) % 40 AS STRING)) AS detector_id, concat('1.', CAST(CAST(event_id AS BIGINT) % 40 % 3 AS STRING), '.0') AS version, latency_ms, CASE WHEN verdict = 'FAIL' AND score >= 0.8 THEN 1 ELSE 0 END AS tp, CASE WHEN verdict = 'FAIL' AND score < 0.8 THEN 1 ELSE 0 END AS fp, CASE WHEN verdict <> 'FAIL' AND score >= 0.8 THEN 1 ELSE 0 END AS fn, 1 AS cases FROM g"


@query(f"""{WITH}, c AS ({CATALOG}), e AS ({_BENCH}), b AS (SELECT detector_id, version, CAST(sum(cases) AS BIGINT) AS cases, CASE WHEN sum(tp + fp) > 0 THEN sum(tp) / sum(tp + fp)::DOUBLE ELSE 1.0::DOUBLE END AS precision, CASE WHEN sum(tp + fn) > 0 THEN sum(tp) / sum(tp + fn)::DOUBLE ELSE 1.0::DOUBLE END AS recall, quantile_cont(latency_ms, 0.95) AS latency_ms_p95 FROM e GROUP BY detector_id, version)
SELECT c.detector_id, c.version, cases, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision IS NULL THEN NULL ELSE 0.0 END::DOUBLE AS f1, latency_ms_p95, cases IS NOT NULL AS selectable FROM c LEFT JOIN b ON c.detector_id = b.detector_id AND c.version = b.version""")
def g21_benchmark_catalog(spark, sf_dir):
    e = spark.sql(_BENCH.replace("FROM g", "FROM {g}"), g=ge(spark, sf_dir))
    return tuning.benchmark_catalog(view(spark, sf_dir, "catalog"), e, e).drop("image_digest")


@query(f"""{WITH}, e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tenant, app, guard_id ORDER BY ts) < INTERVAL 60 minute THEN 0 ELSE 1 END AS new FROM g WHERE verdict = 'ERROR'),
i AS (SELECT *, sum(new) OVER (PARTITION BY tenant, app, guard_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT tenant, app, guard_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_errors, count(DISTINCT request_id) AS n_requests FROM i GROUP BY tenant, app, guard_id, run""")
def g23_incident_windows(spark, sf_dir):
    return metrics.incident_windows(ge(spark, sf_dir), "60 minutes")


@query(f"""{WITH}, m AS (SELECT *, sum(CASE WHEN verdict <> 'ERROR' THEN 1 ELSE 0 END) OVER (PARTITION BY guard_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
n AS (SELECT *, min(CASE WHEN verdict <> 'ERROR' THEN ts END) OVER (PARTITION BY guard_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reset FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY guard_id, run ORDER BY ts, event_id) AS k FROM n WHERE verdict = 'ERROR')
SELECT guard_id, ts AS opened_at, least(ts + INTERVAL 15 second, reset) AS closes_at, k AS failures FROM k WHERE k >= 2""")
def g24_breaker_windows(spark, sf_dir):
    return metrics.breaker_windows(ge(spark, sf_dir), ["guard_id"], failures=2).withColumn("failures", F.col("failures").cast("long"))


@query(f"{WITH} SELECT guard_id, count(latency_ms) AS n, true AS close, true AS as_at_once FROM g GROUP BY guard_id")
def g10_p95_sketches(spark, sf_dir):
    """The 95th percentile from sketches of days: its rank lies within 2 % of 95 %, as it does from one sketch of all."""
    g = ge(spark, sf_dir)
    keys = ["guard_id"]
    days = metrics.latency_sketches(g.withColumn("dt", F.to_date("ts")), [*keys, "dt"])
    merged = metrics.quantile_of_sketches(days, keys, 0.95)
    at_once = metrics.quantile_of_sketches(metrics.latency_sketches(g, keys), keys, 0.95)
    rank = lambda name: F.count_if(F.col("latency_ms") <= F.col(name)) / F.count("latency_ms")
    close = lambda name: (rank(name) >= 0.93) & ((F.count_if(F.col("latency_ms") < F.col(name)) / F.count("latency_ms")) <= 0.97)
    met = g.join(merged.select("guard_id", "n", F.col("value").alias("__days")), "guard_id").join(at_once.select("guard_id", F.col("value").alias("__once")), "guard_id")
    return met.groupBy("guard_id", "n").agg(close("__days").alias("close"), close("__once").alias("as_at_once"))
