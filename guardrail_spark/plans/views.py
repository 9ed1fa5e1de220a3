"""Views over the given tables in the shape of guard records. The same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Decision events: pairs (2k, 2k + 1) are the live and the shadow evaluation of one request.
GUARD_EVENTS = """
SELECT CAST(event_id AS STRING) AS event_id, ts,
  CASE (event_id - event_id % 2) % 6 WHEN 0 THEN 't0' WHEN 2 THEN 't1' ELSE 't2' END AS tenant,
  CASE (event_id - event_id % 2) % 10 WHEN 0 THEN 'app0' WHEN 2 THEN 'app1' ELSE 'app2' END AS app, 'prod' AS env,
  concat('r-', CAST(event_id - event_id % 2 AS STRING)) AS request_id,
  CASE (event_id - event_id % 2) % 8 WHEN 0 THEN 'g-pii-out' WHEN 2 THEN 'g-secrets-io' WHEN 4 THEN 'g-safety-io' ELSE 'g-halluc-out' END AS guard_id,
  CASE (event_id - event_id % 2) % 8 WHEN 0 THEN 'pii' WHEN 2 THEN 'secrets' WHEN 4 THEN 'content_safety' ELSE 'hallucination' END AS scenario,
  CASE WHEN event_id % 3 = 0 THEN 'input' ELSE 'output' END AS direction,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN (event_id * 7919) % 1000 >= 700 THEN 'FAIL' ELSE 'PASS' END AS verdict,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score, CAST(floor(value) AS BIGINT) AS latency_ms,
  event_id % 2 = 1 AS is_shadow,
  CASE event_id % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'redact' WHEN 2 THEN 'mask' ELSE 'flag' END AS on_fail,
  CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'spans' ELSE 'full_text' END AS evidence_mode
FROM events
"""

#: Reviewers' labels of every third event.
FEEDBACK = f"""
SELECT event_id, guard_id, tenant, app, ts AS at, CASE WHEN truth AND score >= 0.7 THEN 'true_positive' WHEN truth THEN 'false_negative'
  WHEN score >= 0.7 THEN 'false_positive' ELSE 'true_negative' END AS disposition
FROM (SELECT *, score >= 0.8 OR (guard_id = 'g-halluc-out' AND CAST(event_id AS BIGINT) % 21 = 0) AS truth
      FROM ({GUARD_EVENTS}) g WHERE CAST(event_id AS BIGINT) % 3 = 0) q
"""

#: Policy versions: every order is one; a customer's orders are the versions of one policy.
POLICIES = """
SELECT concat('t', CAST(o_custkey % 7 AS STRING)) AS tenant, concat('p-', CAST(o_custkey AS STRING)) AS policy_id,
  concat('1.', CAST(o_orderkey % 5 AS STRING), '.', CAST(o_orderkey % 13 AS STRING)) AS version, o_orderkey AS policy_key,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'in_review' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' WHEN 2 THEN 'dev' ELSE '*' END AS env,
  concat('app', CAST(o_custkey % 5 AS STRING)) AS app, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS approved_at,
  CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' END AS default_fail_mode,
  CASE o_orderkey % 5 WHEN 0 THEN 'feed' WHEN 1 THEN 'autotuner' WHEN 2 THEN 'synthesizer' ELSE 'manual' END AS origin,
  CASE o_orderkey % 3 WHEN 0 THEN 'monotonic_add' WHEN 1 THEN 'scope_change' ELSE 'threshold_change' END AS change_class,
  concat('u', CAST(o_orderkey % 11 AS STRING)) AS author, concat('u', CAST(o_orderkey % 4 AS STRING)) AS approver
FROM orders
"""

#: Guards of these versions: every line item is one, in order of line number.
GUARDS = """
SELECT l_orderkey AS policy_key, l_linenumber AS pos, concat('g-', CAST(l_partkey % 50 AS STRING)) AS guard_id,
  CASE l_partkey % 4 WHEN 0 THEN 'pii' WHEN 1 THEN 'secrets' WHEN 2 THEN 'content_safety' ELSE 'hallucination' END AS scenario,
  concat('det', CAST(l_suppkey AS STRING), '@1.', CAST(l_suppkey % 3 AS STRING), '.0') AS detector,
  CASE l_returnflag WHEN 'A' THEN 'input' WHEN 'N' THEN 'output' ELSE 'both' END AS direction,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 10 END AS threshold,
  CASE l_linenumber % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'redact' WHEN 2 THEN 'mask' WHEN 3 THEN 'flag' ELSE 'block_and_explain' END AS on_fail,
  CASE l_suppkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' END AS fail_mode,
  CASE l_linenumber % 4 WHEN 0 THEN 'full_text' WHEN 1 THEN 'spans' ELSE 'none' END AS evidence,
  l_linestatus = 'O' AS shadow, l_tax > 0.06 AS verify_live
FROM lineitem
"""

#: The detector catalog: every supplier is one; a third has no image digest.
CATALOG = """
SELECT concat('det', CAST(s_suppkey AS STRING)) AS detector_id, concat('1.', CAST(s_suppkey % 3 AS STRING), '.0') AS version,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('sha256:', CAST(s_suppkey AS STRING)) END AS image_digest
FROM supplier WHERE s_suppkey % 10 <> 9
"""

VIEWS = {"guard_events": GUARD_EVENTS, "feedback": FEEDBACK, "policies": POLICIES, "guards": GUARDS, "catalog": CATALOG}
_SOURCES = {"guard_events": ("events",), "feedback": ("events",), "policies": ("orders",), "guards": ("lineitem",), "catalog": ("supplier",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    sql = VIEWS[name]
    for t in _SOURCES[name]:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t} ", f"FROM {{{t}}} ")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _SOURCES[name]})
