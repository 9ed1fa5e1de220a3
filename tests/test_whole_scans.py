"""The whole rule packs over whole texts, against the same rules walked in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from guardrail_spark.operators import actions, detection
from guardrail_spark.rules import FEED_RULES, PII, SECRETS

SF = "/root/testdata/sf0.001"
EXTRA = [
    "ssn 123-45-6789 and 078051120, card 4111 1111 1111 1111", "routing number 021000021 acct# 123456789012", "IBAN GB82 WEST 1234 5698 7654 32 me.you+x@example.co.uk",
    "call (212) 555-0187 or +1 212.555.0187", "key = ghp_" + "aB3d" * 9 + " and sk_live_" + "Zz9" * 9, "AKIA" + "A1" * 8 + " xoxb-1234567890-abcdef", "ch_" + "a1B2" * 9 + " lin_api_" + "q" * 44,
    "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U", "aws_secret_access_key = 'wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY'", "", None,
]


def luhn(s):
    d = [int(x) for x in re.sub(r"\D", "", s)][::-1]
    return len(d) >= 13 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def aba(s):
    d = [int(x) for x in re.sub(r"\D", "", s)]
    return len(d) == 9 and sum(x * (3, 7, 1)[i % 3] for i, x in enumerate(d)) % 10 == 0


def iban(s):
    s = re.sub(r"\s", "", s).upper()
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def jwt(s):
    parts = s.split(".")
    return len(parts) == 3 and all(len(p) >= 4 for p in parts)


def entropy(s):
    data = s.encode()
    return -sum(k / len(data) * math.log2(k / len(data)) for k in Counter(data).values())


VALID = {"luhn": luhn, "aba_checksum": aba, "iban_checksum": iban, "jwt_structural": jwt}


def spans(text, rules, kind, threshold=0.0):
    found = []
    for r in rules:
        if r.keywords and not any(k.lower() in text.lower() for k in r.keywords):
            continue
        for m in re.finditer(r.regex, text, re.ASCII):
            if not all(VALID[v](m[0]) for v in r.validators) or r.entropy_min and entropy(m[0]) < r.entropy_min:
                continue
            near = any(w in text[max(0, m.start() - 40) : m.end() + 40].lower() for w in r.context_words)
            if r.requires_context and not near:
                continue
            conf = min(1.0, r.confidence + 0.1 * (entropy(m[0]) - r.entropy_min)) if r.entropy_min else r.confidence
            conf = min(1.0, conf + 0.2) if near else conf
            if conf >= threshold:
                found.append((m.start(), m.end(), r.id, round(conf, 9)))
    found.sort(key=lambda s: (s[0], -s[3], *((-(s[1] - s[0]), s[2]) if kind == "pii" else (s[2],))))
    out = []
    for s in found:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[3] > out[-1][3]:
            out[-1] = s
    return out


def texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string"))


def test_all_personal_data(spark):
    got = {r.doc_id: (r.text, [(s.start, s.end, s.label, round(s.confidence, 9)) for s in r.spans]) for r in detection.pii_scan(texts(spark)).collect()}
    assert {d: found for d, (_, found) in got.items()} == {d: spans(t or "", PII, "pii") for d, (t, _) in got.items()}
    assert {s[2] for _, found in got.values() for s in found} == {r.id for r in PII}


def test_all_secrets(spark):
    rules = [*SECRETS, *FEED_RULES]
    got = {r.doc_id: (r.text, [(s.start, s.end, s.label, round(s.confidence, 9)) for s in r.spans]) for r in detection.secrets_scan(texts(spark), rules=rules).collect()}
    assert {d: found for d, (_, found) in got.items()} == {d: spans(t or "", rules, "secrets", 0.5) for d, (t, _) in got.items()}


def test_two_policies_in_order(spark):
    """Redaction by the first policy, masks by the second on what is left, as a8 does."""

    def edited(text, found, new):
        for a, e, label, _ in reversed(found):
            text = text[:a] + new(label, text[a:e]) + text[e:]
        return text

    first = [{"detector": "pii-regex@1.0.0", "direction": ["input"], "on_fail": "redact"}]
    second = [{"detector": "secrets-core@0.1.0", "direction": ["input", "output"], "on_fail": "mask"}]
    rows = texts(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("input").alias("direction"))
    got = {r.doc_id: (r.text, r.actions) for r in actions.enforce(rows, [first, second], detection.scan, ["doc_id"]).collect()}
    for r in rows.collect():
        pii = spans(r.text, PII, "pii")
        left = edited(r.text, pii, lambda label, _: f"[{label}-REDACTED]")
        secrets = spans(left, SECRETS, "secrets", 0.5)
        mask = lambda _, m: "*" * (len(m) - 4) + m[-4:]
        assert got[r.doc_id] == (edited(left, secrets, mask), ["redact"] * bool(pii) + ["mask"] * bool(secrets))
