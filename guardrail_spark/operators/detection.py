"""Span detection: patterns, validators, context, entropy and overlap resolution, all in column expressions.

Spans are array<struct<start, end, label, confidence>>, in code points, end exclusive, in text order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import VALIDATORS, let, shannon_entropy
from ..rules import PII, PII_PACK, SECRETS, Rule

SPAN = "array<struct<start:int,end:int,label:string,confidence:double>>"
FOUND = "array<struct<start:int,end:int,match:string>>"
CONTEXT = 40  # characters on either side of a span
CONTEXT_BONUS = 0.20


def matches(text: Column, regex: str) -> Column:
    """All non-overlapping matches with their offsets: gaps and matches alternate, so offsets are running lengths."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, regex, -1), 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(FOUND).alias("out"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def may_match(text: Column, low: Column, rule: Rule) -> Column:
    """Whether a rule can match at all: a keyword occurs (in any case; rules without keywords always run), a context word
    does where one is required, and the rule's gate. low: the text in lower case. Cheapest tests first."""
    tests = []
    if rule.keywords:
        tests.append(reduce(or_, [F.contains(low, F.lit(k)) for k in sorted({k.lower() for k in rule.keywords})]))
    if rule.gate:
        tests.append(text.rlike(rule.gate) if re.search(r"\W", rule.gate.replace("@", "")) else F.contains(text, F.lit(rule.gate)))
    if rule.requires_context:
        tests.append(reduce(or_, [F.contains(low, F.lit(w)) for w in rule.context_words]))
    return reduce(and_, tests, F.lit(True))


def _valid(name: str) -> Callable[[Column], Column]:
    return lambda s: VALIDATORS[name](s["match"])


def rule_spans(text: Column, rule: Rule, threshold: float = 0.0, low: Column | None = None) -> Column:
    """Spans of one rule: its pattern runs only where keywords, gate and context allow it; validators, context and entropy
    then decide. low: the text in lower case, if it is at hand."""
    low = F.lower(text) if low is None else low
    if rule.confidence < threshold and not rule.entropy_min:
        return F.array().cast(SPAN)
    found = matches(text, rule.regex)
    for v in rule.validators:
        found = F.filter(found, _valid(v))
    if rule.entropy_min:
        found = F.filter(found, lambda s: shannon_entropy(s["match"]) >= rule.entropy_min)

    def near(s: Column) -> Column:
        start = F.greatest(s["start"] - CONTEXT, F.lit(0))
        window = F.lower(F.substring(text, start + 1, s["end"] + CONTEXT - start))  # lower case may change lengths: not of low
        return F.exists(F.array(*[F.lit(w) for w in rule.context_words]), lambda w: F.contains(window, w))

    if rule.requires_context:
        found = F.filter(found, near)

    def span(s: Column) -> Column:
        conf = F.lit(rule.confidence)
        if rule.entropy_min:
            conf = F.least(F.lit(1.0), conf + 0.1 * (shannon_entropy(s["match"]) - rule.entropy_min))
        if rule.context_words:
            conf = F.when(near(s), F.least(F.lit(1.0), conf + CONTEXT_BONUS)).otherwise(conf)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.id).alias("label"), conf.alias("confidence"))

    spans = F.filter(F.transform(found, span), lambda s: s["confidence"] >= threshold)
    return F.when(may_match(text, low, rule), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def resolve_overlaps(spans: Column, kind: str) -> Column:
    """Spans apart from each other: of two that overlap the more confident stays, the first of equals. Order: start, then
    confidence; then length for pii, label for secrets."""

    def order(a: Column, b: Column) -> Column:
        def by(x: Column, y: Column, rest: Column) -> Column:
            return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(rest)

        last = by(a["label"], b["label"], F.lit(0))
        last = by(b["end"] - b["start"], a["end"] - a["start"], last) if kind == "pii" else last
        return by(a["start"], b["start"], by(b["confidence"], a["confidence"], last))

    def step(acc: Column, s: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        apart = F.coalesce(s["start"] >= top["end"], F.lit(True))
        better = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(s))
        return F.when(apart, F.concat(acc, F.array(s))).when(s["confidence"] > top["confidence"], better).otherwise(acc)

    return F.aggregate(F.array_sort(spans, order), F.array().cast(SPAN), step)


def score(spans: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(spans, lambda s: s["confidence"])), F.lit(0.0))


def labels_of(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))


def extract_spans(df: DataFrame, text: str, rules: list[Rule], kind: str, threshold: float = 0.0) -> DataFrame:
    """df with `spans`. The text in lower case is bound within one expression, so that it is made once for all rules even
    where a filter on the spans is pushed below them."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = let(F.lower(t), lambda low: F.concat(*[rule_spans(t, r, threshold, low) for r in rules]))
    return df.withColumn("spans", resolve_overlaps(found, kind))


def pii_scan(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, enforce_threshold: float | None = None) -> DataFrame:
    """df with spans, score, verdict and explanation. The verdict fails with any span; a threshold is opt-in."""
    out = extract_spans(df, text, PII if rules is None else rules, "pii").withColumn("score", score(F.col("spans")))
    bad = F.col("score") > 0 if enforce_threshold is None else F.col("score") >= enforce_threshold
    said = F.concat(F.lit(f"pack={PII_PACK} matched: "), F.array_join(labels_of(F.col("spans")), ", "))
    return out.withColumns({"verdict": F.when(bad, "FAIL").otherwise("PASS"), "explanation": F.when(F.size("spans") > 0, said).otherwise("no matches")})


def secrets_scan(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """df with spans of the threshold or more, score and verdict (fails with any)."""
    out = extract_spans(df, text, SECRETS if rules is None else rules, "secrets", threshold).withColumn("score", score(F.col("spans")))
    return out.withColumn("verdict", F.when(F.size("spans") > 0, "FAIL").otherwise("PASS"))


#: Detectors by `id@version`; users add their own.
REGISTRY: dict[str, Callable[[DataFrame, str], DataFrame]] = {"pii-regex@1.0.0": pii_scan, "secrets-core@0.1.0": secrets_scan}


def register(name: str, detector: Callable[[DataFrame, str], DataFrame]) -> None:
    REGISTRY[name] = detector


def scan(df: DataFrame, detector: str, text: str = "text") -> DataFrame:
    """df with what the registered detector adds; an unknown one gives an error verdict."""
    run = REGISTRY.get(detector)
    if run is None:
        return df.withColumns({"spans": F.array().cast(SPAN), "score": F.lit(0.0), "verdict": F.lit("ERROR"), "explanation": F.lit(f"detector not registered: {detector}")})
    return run(df, text)
