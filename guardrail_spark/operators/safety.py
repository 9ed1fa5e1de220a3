"""Safety layers, judge replies and groundedness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text_hash
from ..rules import ABBREVIATIONS, AUXILIARIES, HARD_SCORE, HARD_SIGNALS, SAFETY_CODES
from .detection import SPAN


def hard_signals(df: DataFrame, text: str = "text", table: dict[str, list[str]] | None = None) -> DataFrame:
    """df with category (the first with a needle in the text), score and the whole text as span."""
    low, category = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(None).cast("string")
    for name, needles in reversed((HARD_SIGNALS if table is None else table).items()):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(low, F.lit(n))
        category = F.when(hit, name).otherwise(category)
    out = df.withColumn("category", category)
    span = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.col("category").alias("label"), F.lit(HARD_SCORE).alias("confidence"))).cast(SPAN)
    hit = F.col("category").isNotNull()
    return out.withColumns({"score": F.when(hit, HARD_SCORE).otherwise(0.0), "spans": F.when(hit, span).otherwise(F.array().cast(SPAN))})


def gate_categories(df: DataFrame, scores: str, thresholds: dict[str, float], judged: str, text: str) -> DataFrame:
    """df with failing categories, verdict and one whole-text span for each: a category fails at its threshold (0.5 by
    default); without any the judge's verdict stands, PASS if unknown."""
    table = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]) if thresholds else F.create_map().cast("map<string,double>")
    bad = F.map_filter(scores, lambda k, v: v >= F.coalesce(F.try_element_at(table, k), F.lit(0.5)))
    out = df.withColumn("failing", F.array_sort(F.map_keys(bad)))
    verdict = F.when(F.size("failing") > 0, "FAIL").when(F.col(judged).isin("PASS", "FAIL", "NEEDS_ESCALATION"), F.col(judged)).otherwise("PASS")
    span = F.transform("failing", lambda c: F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), c.alias("label"), F.element_at(F.col(scores), c).alias("confidence"))).cast(SPAN)
    return out.withColumns({"verdict": verdict, "spans": span})


def parse_llamaguard(reply: Column) -> Column:
    """struct<verdict, score, categories> of `safe`, or `unsafe` and a line of codes; 0.5 for unsafe without codes."""
    lines = F.filter(F.transform(F.split(F.trim(F.coalesce(reply, F.lit(""))), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.lower(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    codes = F.filter(F.transform(F.split(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    unsafe = head.startswith("unsafe")
    score = F.when(~unsafe, 0.0).when(F.size(codes) > 0, 1.0).otherwise(0.5)
    named = F.array_distinct(F.when(unsafe, codes).otherwise(F.array().cast("array<string>")))
    return F.struct(F.when(unsafe, "FAIL").otherwise("PASS").alias("verdict"), score.alias("score"), F.map_from_arrays(named, F.transform(named, lambda _: F.lit(1.0))).alias("categories"))


def named_categories(categories: Column, names: dict[str, str] = SAFETY_CODES) -> Column:
    """The labels of the codes in a map of categories, in order of the taxonomy; codes that it lacks stand last, as they
    are, in their own order."""
    keys = F.map_keys(categories)
    known = F.array(*[F.lit(k) for k in names])
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    listed = F.transform(F.filter(known, lambda k: F.array_contains(keys, k)), lambda k: F.element_at(table, k))
    return F.concat(listed, F.array_sort(F.array_except(keys, known)))


def json_in_reply(reply: Column) -> Column:
    """The text from the first `{` to the last `}`, null if there is none: code fences and prose fall away."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_json_lenient(reply: Column, schema: str) -> Column:
    return F.from_json(json_in_reply(reply), schema)


def sentences(text: Column) -> Column:
    """Sentences: cuts after . ! or ? and blanks before a capital, digit, quote or bracket, unless the sentence so far ends
    with an abbreviation."""
    parts = F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), lambda p: F.trim(p)), lambda p: p != "")

    def step(acc: Column, s: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        word = F.lower(F.regexp_extract(top, r"(\S+)$", 1))
        short = F.coalesce(word.isin(*ABBREVIATIONS), F.lit(False))
        return F.when(short, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", top, s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def claims(text: Column) -> Column:
    """Claims: sentences, cut at `, and` or `, but` where all parts look like clauses; three words or more."""
    clause = rf"(?i)\b({AUXILIARIES})\b"

    def cut(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, r"(?i),\s+(?:and|but)\s+"), lambda p: F.trim(p)), lambda p: p != "")
        good = F.forall(parts, lambda p: p.rlike(clause) | p.rlike(r"\b\w+(?:ed|ing|s)\b"))
        return F.when((F.size(parts) > 1) & good, parts).otherwise(F.array(F.trim(s)))

    return F.filter(F.flatten(F.transform(sentences(text), cut)), lambda c: F.size(F.split(c, r"\s+")) >= 3)


def locate_claims(text: Column, claimed: Column) -> Column:
    """Spans of claims: each is looked for after the one before, else from the start; those not found are left out."""

    def step(acc: Column, c: Column) -> Column:
        after = F.call_function("locate", c, text, acc["pos"] + 1)
        at = F.when(after > 0, after).otherwise(F.call_function("locate", c, text, F.lit(1)))
        found = F.array(F.struct((at - 1).alias("start"), (at - 1 + F.length(c)).alias("end"), F.lit("claim").alias("label"), F.lit(1.0).alias("confidence"))).cast(SPAN)
        return F.when(at > 0, F.struct((at - 1 + F.length(c)).alias("pos"), F.concat(acc["out"], found).alias("out"))).otherwise(acc)

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(claimed, zero, step, lambda a: a["out"])


def assemble_context(contexts: DataFrame, key: str) -> DataFrame:
    """key and its context documents (pos, id, text) as `[id] text` with blank lines between."""
    piece = F.struct("pos", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("t"))
    return contexts.groupBy(key).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "\n\n")).alias("context"))


def attach_judge(df: DataFrame, text: str, rubric: str, scores: DataFrame) -> DataFrame:
    """df with the judge's score: scores (text_hash, rubric, score) are made beforehand; the join is by the text's hash."""
    mine = scores.where(F.col("rubric") == rubric).select("text_hash", F.col("score").alias("judge_score"))
    return df.withColumn("text_hash", text_hash(F.col(text))).join(mine, "text_hash", "left")


def attach_model(df: DataFrame, text: str, model: Callable) -> DataFrame:
    """df with `judge_score` by a user's function of a pandas Series of texts, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    return df.withColumn("judge_score", pandas_udf(model, "double")(F.col(text)))


def groundedness(answers: DataFrame, claim_scores: DataFrame, key: str, threshold: float = 0.5, requires_context: bool = True) -> DataFrame:
    """Per answer (key, has_context): score (least of its claims), verdict and explanation; claim_scores: (key, supported,
    score)."""
    s = claim_scores.groupBy(key).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("supported")).alias("k"))
    rows = answers.join(s, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0))})
    verdict = F.when(~F.col("has_context"), "NEEDS_ESCALATION" if requires_context else "PASS").when(F.col("n") == 0, "PASS").when((F.col("k") > 0) | (F.col("least") < threshold), "FAIL").otherwise("PASS")
    return rows.select(key, F.when(~F.col("has_context") | (F.col("n") == 0), 1.0).otherwise(F.col("least")).alias("score"), verdict.alias("verdict"), F.concat("k", F.lit("/"), "n", F.lit(" unsupported")).alias("explanation"))
