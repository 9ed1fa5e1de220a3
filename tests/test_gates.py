from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from guardrail_spark.operators import detection
from guardrail_spark.rules import PII, SECRETS

SAMPLES = [
    "ssn 123-45-6789", "123456789", "078 05 1120 x", "card 4111 1111 1111 1111", "visa 4111-1111-1111-1111.", "routing 021000021", "account 12345678", "acct# 123456",
    "iban GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "me.you+x@example.co.uk", "@ @", "call (212) 555-0187", "+1 212.555.0187", "2125550187", "phone 212 5550187",
    "key " + "aB3" * 12, "x" * 24, "tok_" + "Zq9-_/+=" * 5, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U", "AKIA" + "A1" * 8, "İ ACCOUNT 1234567 ß",
]


def test_gates_change_nothing(spark):
    """Every rule finds the same with and without its gate."""
    df = spark.createDataFrame([(f"{a} {b}",) for a in SAMPLES for b in SAMPLES], "text string")
    t = F.col("text")
    for rule in [*PII, *SECRETS]:
        with_gate, without = detection.rule_spans(t, rule), detection.rule_spans(t, replace(rule, gate=""))
        assert df.where(~with_gate.eqNullSafe(without)).count() == 0, rule.id
    assert all(df.select(F.max(F.size(detection.rule_spans(t, r)))).first()[0] > 0 for r in PII)
