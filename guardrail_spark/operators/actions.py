"""Actions on guard outcomes: redact, mask, block, flag; reports of requests under a plan of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import meet

EDIT = "array<struct<start:int,end:int,label:string,action:string>>"
DEFERRED = ("reask", "rewrite")
BLOCKING = ("block", "block_and_explain")


def edits_of(spans: Column, action: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(action).alias("action"))).cast(EDIT)


def apply_edits(text: Column, edits: Column) -> Column:
    """text with its edits in order of start; one that starts before the last one's end is left out."""

    def replacement(e: Column) -> Column:
        seg = F.substring(text, e["start"] + 1, e["end"] - e["start"])
        n = F.length(seg)
        masked = F.when(n > 4, F.concat(F.repeat(F.lit("*"), n - 4), F.right(seg, F.lit(4)))).otherwise(F.repeat(F.lit("*"), n))
        return F.when(e["action"] == "redact", F.concat(F.lit("["), e["label"], F.lit("-REDACTED]"))).otherwise(masked)

    def step(acc: Column, e: Column) -> Column:
        made = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, e["start"] - acc["pos"]), replacement(e))
        return F.when(e["start"] < acc["pos"], acc).otherwise(F.struct(e["end"].alias("pos"), made.alias("out")))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(edits), zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1)))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with `mutated`: every span replaced by [LABEL-REDACTED]."""
    return df.withColumn("mutated", apply_edits(F.col(text), edits_of(F.col(spans), "redact")))


def mask(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with `mutated`: every span starred but for its last four characters."""
    return df.withColumn("mutated", apply_edits(F.col(text), edits_of(F.col(spans), "mask")))


def apply_actions(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each text (keys, text) of guard outcomes (pos, on_fail, shadow, verdict, spans): block, actions, mutated.
    Only failed guards that aren't in shadow act; blocking leaves the text alone."""
    acts = (F.col("verdict") == "FAIL") & ~F.col("shadow")
    name = F.when(F.col("on_fail").isin(*DEFERRED), F.concat("on_fail", F.lit(":deferred"))).otherwise(F.col("on_fail"))
    edits = F.when(acts & (F.col("on_fail") == "redact"), edits_of(F.col("spans"), "redact")).when(acts & (F.col("on_fail") == "mask"), edits_of(F.col("spans"), "mask"))
    rows = df.withColumns({"__act": F.when(acts, name), "__edits": F.coalesce(edits, F.array().cast(EDIT))})
    grouped = rows.groupBy(*keys).agg(
        F.first("text").alias("text"),
        F.coalesce(F.bool_or(acts & F.col("on_fail").isin(*BLOCKING)), F.lit(False)).alias("block"),
        F.array_sort(F.collect_list(F.when(F.col("__act").isNotNull(), F.struct("pos", "__act")))).alias("a"),
        F.flatten(F.collect_list("__edits")).alias("e"),
    )
    out = grouped.withColumn("actions", F.array_distinct(F.transform("a", lambda x: x["__act"])))
    return out.withColumn("mutated", F.when(F.col("block") | (F.size("e") == 0), F.col("text")).otherwise(apply_edits(F.col("text"), F.col("e")))).drop("a", "e")


def enforce(requests: DataFrame, policies: list[list[dict]], scan, keys: list[str]) -> DataFrame:
    """requests (keys, text, direction) after all policies in order; each sees what the last one left, and a blocked
    text is left alone. A policy is a list of guards {detector, direction, on_fail, shadow}; policies on one path are
    few, so the loop is over them, never over rows."""
    state = requests.withColumns({"blocked": F.lit(False), "actions": F.array().cast("array<string>")})
    for guards in policies:
        for pos, g in enumerate(guards):
            seen = scan(state.withColumnRenamed("actions", "__before"), g["detector"], "text")
            on = F.array_contains(F.array(*[F.lit(d) for d in g["direction"]]), F.col("direction")) & ~F.col("blocked")
            bad = on & (F.col("verdict") == "FAIL") & F.lit(not g.get("shadow", False))
            seen = seen.withColumn(f"__bad{pos}", bad).withColumn(f"__e{pos}", F.when(bad & F.lit(g["on_fail"] in ("redact", "mask")), edits_of(F.col("spans"), g["on_fail"])).otherwise(F.array().cast(EDIT)))
            state = seen.withColumnRenamed("__before", "actions").drop("spans", "score", "verdict", "explanation")
        n = len(guards)
        stops = F.lit(False)
        for p, g in enumerate(guards):
            stops = stops | (F.col(f"__bad{p}") & F.lit(g["on_fail"] in BLOCKING))
        taken = F.array_compact(F.array(*[F.when(F.col(f"__bad{p}"), F.lit(g["on_fail"] + (":deferred" if g["on_fail"] in DEFERRED else ""))) for p, g in enumerate(guards)]))
        edits = F.concat(*[F.col(f"__e{p}") for p in range(n)])
        state = state.withColumns({"__stop": stops, "__edits": edits, "actions": F.array_distinct(F.concat("actions", taken))})
        state = state.withColumn("text", F.when(F.col("__stop") | (F.size("__edits") == 0), F.col("text")).otherwise(apply_edits(F.col("text"), F.col("__edits"))))
        state = state.withColumn("blocked", F.col("blocked") | F.col("__stop")).drop("__stop", "__edits", *[f"__bad{p}" for p in range(n)], *[f"__e{p}" for p in range(n)])
    return state


REPORTED = "array<struct<policy:string,guard_id:string,scenario:string,detector:string,verdict:string,score:double,on_fail:string,spans:array<struct<start:int,end:int,label:string,confidence:double>>>>"


def check(requests: DataFrame, plan: DataFrame, scan, keys: list[str], text: str = "text", blocked: Column | None = None) -> DataFrame:
    """The report of each request (keys, app, env, direction, text): verdict, blocked, actions, guards in order, the final
    text `current`, and `mutated`, the same only where it changed.

    plan: policies.guard_plan. Policies run in order of `step`, each on what the last one left, up to the first that blocks;
    guards in shadow are reported and count for the verdict, but do not act. A failed detector counts by its guard's
    fail mode. A plan meets requests as one array for each (app, env), so no request is multiplied; a step whose guards,
    counted first, are few enough is broadcast, so that no request is shuffled either. A detector's rules see the texts
    alone that one of its guards watches. The loop is over a plan's steps and detectors, which its catalog bounds, never
    over rows."""
    first = F.lit(False) if blocked is None else F.coalesce(blocked, F.lit(False))
    state = requests.select(
        *keys, "app", "env", "direction", F.col(text).alias("text"), F.col(text).alias("current"), first.alias("blocked"),
        F.array().cast("array<string>").alias("actions"), F.array().cast(REPORTED).alias("guards"),
    )
    found = plan.groupBy("step", "detector").agg(F.count(F.lit(1)).alias("n")).orderBy("step", "detector").collect()
    each = F.struct("pos", *[c for c in plan.columns if c not in ("app", "env", "step", "pos")])
    for step in sorted({r.step for r in found}):
        names = [r.detector for r in found if r.step == step]
        mine = plan.where(F.col("step") == step).groupBy("app", "env").agg(F.array_sort(F.collect_list(each)).alias("__gs"))
        state = meet(state, mine, ["app", "env"], sum(r.n for r in found if r.step == step), "left")
        state = state.withColumn("__gs", F.when(F.col("blocked") | F.col("__gs").isNull(), F.array().cast(mine.schema["__gs"].dataType)).otherwise(F.filter("__gs", lambda g: F.array_contains(g["guard_direction"], F.col("direction")))))
        for i, name in enumerate(names):
            watched = F.array_contains(F.transform("__gs", lambda g: g["detector"]), name)
            seen = scan(state.withColumn("__text", F.when(watched, F.coalesce("current", F.lit(""))).otherwise("")), name, "__text")
            state = seen.withColumn(f"__found{i}", F.struct("verdict", F.col("score").cast("double").alias("score"), "spans")).drop("spans", "score", "verdict", "explanation", "__text")
        state = _acted(state, names)
    return state.select(
        *keys, "app", "env", "direction", F.when(F.col("blocked") | F.exists("guards", lambda g: g["verdict"] == "FAIL"), "FAIL").otherwise("PASS").alias("verdict"), "blocked",
        "actions", "guards", "current", F.when(~F.col("current").eqNullSafe(F.col("text")), F.col("current")).alias("mutated"),
    )


def _acted(state: DataFrame, names: list[str]) -> DataFrame:
    """state after the guards __gs of one policy, whose detectors' results stand in __found0, __found1, ..."""

    def outcome(g: Column) -> Column:
        result = F.col("__found0")
        for i, name in enumerate(names[1:], 1):
            result = F.when(g["detector"] == name, F.col(f"__found{i}")).otherwise(result)
        mode = F.coalesce(F.nullif(g["fail_mode"], F.lit("")), F.nullif(g["default_fail_mode"], F.lit("")), F.lit("closed"))
        return F.struct(g.alias("g"), result.alias("r"), F.when(result["verdict"] != "ERROR", result["verdict"]).when(mode == "open", "PASS").otherwise("FAIL").alias("verdict"))

    def edits(o: Column) -> Column:
        return F.transform(o["r"]["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), o["g"]["on_fail"].alias("action")))

    def reported(o: Column) -> Column:
        g = o["g"]
        return F.struct(g["policy"].alias("policy"), g["guard_id"].alias("guard_id"), g["scenario"].alias("scenario"), g["detector"].alias("detector"), o["verdict"].alias("verdict"), o["r"]["score"].alias("score"), g["on_fail"].alias("on_fail"), o["r"]["spans"].alias("spans"))

    state = state.withColumn("__o", F.transform("__gs", outcome))
    state = state.withColumn("__act", F.filter("__o", lambda o: (o["verdict"] == "FAIL") & ~F.coalesce(o["g"]["shadow"], F.lit(False))))
    taken = F.transform("__act", lambda o: F.when(o["g"]["on_fail"].isin(*DEFERRED), F.concat(o["g"]["on_fail"], F.lit(":deferred"))).otherwise(o["g"]["on_fail"]))
    made = F.flatten(F.transform(F.filter("__act", lambda o: o["g"]["on_fail"].isin("redact", "mask")), edits)).cast(EDIT)
    state = state.withColumns({
        "__stop": F.exists("__act", lambda o: o["g"]["on_fail"].isin(*BLOCKING)), "__edits": made,
        "actions": F.concat("actions", F.array_distinct(taken)), "guards": F.concat("guards", F.transform("__o", reported).cast(REPORTED)),
    })
    current = F.when(F.col("__stop") | (F.size("__edits") == 0), F.col("current")).otherwise(apply_edits(F.col("current"), F.col("__edits")))
    state = state.withColumns({"current": current, "blocked": F.col("blocked") | F.col("__stop")})
    return state.drop("__gs", "__o", "__act", "__stop", "__edits", *[f"__found{i}" for i in range(len(names))])


def direction_of(role: Column) -> Column:
    """Assistants' turns are output, all others input."""
    return F.when(role == "assistant", "output").otherwise("input")


def guard_conversations(turns: DataFrame, plan: DataFrame, scan, app: Column, env: Column) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text): the reports of its input and of its output. The
    turns of a direction are checked as one text, in order and with line breaks between; where the input is blocked there
    is no output phase and no output report. Turns are gathered by conversation, as a request is."""
    way = direction_of(F.col("role"))
    said = lambda d: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(way == d, F.struct("turn", "text")))), lambda t: F.coalesce(t["text"], F.lit(""))), "\n")
    texts = turns.groupBy("conv_id").agg(said("input").alias("__in"), said("output").alias("__out")).withColumns({"app": app, "env": env})
    report = lambda name: F.struct("verdict", "blocked", "actions", "guards", "mutated").alias(name)
    inner = check(texts.withColumn("direction", F.lit("input")), plan, scan, ["conv_id", "__out"], text="__in")
    inner = inner.select("conv_id", "app", "env", "__out", report("input"))
    outer = check(inner.withColumn("direction", F.lit("output")), plan, scan, ["conv_id", "input"], text="__out", blocked=F.col("input.blocked"))
    return outer.select("conv_id", "app", "env", "input", F.when(~F.col("input.blocked"), F.struct("verdict", "blocked", "actions", "guards", "mutated")).alias("output"))


def writeback(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """turns with the texts that guard_conversations' reports changed: that of the input in the last input turn, that of
    the output in the first output turn. A blocked direction is left alone."""
    way = direction_of(F.col("role"))
    of_all = W.partitionBy("conv_id")
    place = F.struct("turn", "text")
    ends = turns.withColumns({"__last": F.max(F.when(way == "input", place)).over(of_all), "__first": F.min(F.when(way == "output", place)).over(of_all)})
    new = reports.select("conv_id", F.when(~F.col("input.blocked"), F.col("input.mutated")).alias("__in"), F.when(~F.col("output.blocked"), F.col("output.mutated")).alias("__out"))
    text = F.when((way == "input") & (place == F.col("__last")), F.coalesce("__in", "text")).when((way == "output") & (place == F.col("__first")), F.coalesce("__out", "text")).otherwise(F.col("text"))
    return ends.join(new, "conv_id", "left").withColumn("text", text).drop("__last", "__first", "__in", "__out")
