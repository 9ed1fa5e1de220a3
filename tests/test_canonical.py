from __future__ import annotations

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from guardrail_spark.functions.columns import canonical_double, canonical_json_text, last_key_counts
from guardrail_spark.operators import evidence, policies


def plain(v):
    """The same rules on parsed JSON, the plain way."""
    if isinstance(v, dict):
        return {k: plain(v[k]) for k in sorted(v)}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, float):
        if not math.isfinite(v):
            raise ValueError
        return int(v) if v.is_integer() and abs(v) <= 1e15 else v
    return v


def text(v):
    return json.dumps(plain(v), ensure_ascii=False, separators=(",", ":"))


def test_numbers(spark):
    rng = random.Random(8)
    some = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(6000)]
    values = [v for v in some if math.isfinite(v) and not 1e17 < abs(v) < 1e26] + [rng.random() for _ in range(4000)] + [round(rng.uniform(-1e4, 1e4), rng.randrange(9)) for _ in range(2000)]
    values += [2.0**k for k in (-1074, -1022, -44, -1, 0, 10, 53, 56)] + [k * 5e-324 for k in range(1, 200)] + [0.1234567890123456, 1e-13, 1e-5, 1e-4, 1e15, 1e15 + 2, 1e16, 1e22, 1e23, -0.0, -1.5]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", canonical_double(F.col("v")).alias("t"))
    assert [(r.v, r.t) for r in df.collect() if r.t != text(r.v)] == []
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in odd.select(canonical_double(F.col("v"))).collect()] == [None] * 3


def test_documents(spark):
    docs = [
        '{"b":1.0,"a":[1e-7,1E5,-0,-0.0,0.1234567890123456789,123456789012345678901234567890123456789012],"c":{"z":"x 1.0 \\" 2","y":"n5","k":"s\\u001f\\u000B\\n\\u00e9\\\\u001F"}}',
        ' [1, 2.50 , "a-1", true, null] ', "3.0", '"x"', '{"a":1,"a":2.0}', '{"é":true,"Z":null,"a b":[]}', "{}", "[]",
    ]
    broken = ['{"a":01}', '{"a":1e400}', "nope", "", '{"a":-}', '{"a":1.}', "[1-2]"]
    with last_key_counts(spark):
        got = spark.createDataFrame([(d,) for d in docs + broken], "d string").select(canonical_json_text(F.col("d"))).collect()
    assert [r[0] for r in got] == [text(json.loads(d)) for d in docs] + [None] * len(broken)
    rows = spark.createDataFrame([("p", "1.0.0", '{"a":1,"a":1e-5}')], "policy_id string, version string, document string")
    assert policies.document_hashes(rows).first().document_hash is not None
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_a_change_of_the_last_digit_is_found(spark):
    events = spark.createDataFrame([(f"e{i}", "t", "a", 0.1234567890123456 + i) for i in range(5)], "event_id string, tenant string, app string, score double")
    events = events.withColumns({"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "evidence_mode": F.lit("none"), "spans": F.lit(None).cast(evidence.SPAN)})
    chain = evidence.build_chain(events)
    assert evidence.verify_chain(chain).first().ok
    changed = chain.withColumn("score", F.when(F.col("event_id") == "e0", F.lit(0.12345678901234562)).otherwise(F.col("score")))
    report = evidence.verify_chain(changed).first()
    assert (report.ok, report.first_bad_seq, report.reason) == (False, 1, "event_hash")


def test_what_is_not_finite_has_no_hash(spark):
    rows = spark.createDataFrame([("e", float("nan"))], "event_id string, score double")
    with pytest.raises(Exception, match="not finite"):
        rows.select(evidence.event_hash(rows)).collect()
