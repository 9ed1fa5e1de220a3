"""Counters, histograms, rates, quantiles and alerts over decision events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Upper bounds of the latency buckets in milliseconds.
BUCKETS = (5, 10, 25, 50, 75, 100, 150, 200, 300, 500, 1000, 2000)
COUNTER_KEYS = ["tenant", "env", "app", "scenario", "guard_id", "direction", "verdict"]


def guard_counts(events: DataFrame) -> DataFrame:
    """Evaluations, shadow evaluations and errors of each counter."""
    return events.groupBy(*COUNTER_KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_shadow").alias("n_shadow"), F.count_if(F.col("verdict") == "ERROR").alias("n_error"))


def latency_histogram(events: DataFrame, keys: list[str], buckets: tuple[int, ...] = BUCKETS) -> DataFrame:
    """keys, le (null: +Inf), cumulative count, and _sum and _count. Events are counted by bucket first, so what the
    bucket spine multiplies is one row for each key and bucket."""
    at = F.coalesce(F.array_min(F.filter(F.array(*[F.lit(b) for b in buckets]), lambda b: F.col("latency_ms") <= b)), F.lit(1 << 30))
    counted = events.where("latency_ms is not null").groupBy(*keys, at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("s"))
    spine = F.explode(F.array(*[F.lit(b) for b in (*buckets, 1 << 30)])).alias("le")
    wide = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.sum("s").alias("latency_sum"), F.sum("n").alias("latency_count")).select("*", spine)
    cumulative = F.sum(F.coalesce(F.try_element_at("m", "le"), F.lit(0))).over(W.partitionBy(*keys).orderBy("le").rowsBetween(W.unboundedPreceding, W.currentRow))
    return wide.select(*keys, F.when(F.col("le") < 1 << 30, F.col("le")).alias("le"), cumulative.cast("long").alias("n"), "latency_sum", "latency_count")


def quantile_from_histogram(histogram: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys and the quantile by linear interpolation within its bucket; beyond the last bound that bound."""
    order = W.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    rows = histogram.withColumns({"before": F.coalesce(F.lag("n").over(order), F.lit(0)), "low": F.coalesce(F.lag("le").over(order), F.lit(0)), "target": F.col("latency_count") * q})
    hit = rows.where((F.col("n") >= F.col("target")) & (F.col("before") < F.col("target")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("target") - F.col("before")) / (F.col("n") - F.col("before"))
    return hit.select(*keys, F.coalesce(inside, F.col("low").cast("double")).alias("value"))


def latency_sketches(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a mergeable sketch of their latencies, a few kilobytes each: kept by day, say, they answer later for any
    span of days without the events."""
    return events.where("latency_ms is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr("kll_sketch_agg_bigint(cast(latency_ms as bigint))").alias("sketch"))


def quantile_of_sketches(sketches: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys, the number of latencies and their quantile, from sketches of any finer keys merged; its rank is off by about
    1.5 % of them, whatever their number."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_bigint(sketch)").alias("sketch"))
    return merged.select(*keys, "n", F.expr(f"kll_sketch_get_quantile_bigint(sketch, {q!r}D)").alias("value"))


def action_counts(events: DataFrame) -> DataFrame:
    """Actions taken by live failed guards, counted once each."""
    return events.where("verdict = 'FAIL' and not is_shadow").groupBy("app", "direction", F.col("on_fail").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def rates(events: DataFrame, keys: list[str], window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """keys, the window's end, events in it and events a second."""
    seconds = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    grouped = events.groupBy(*keys, F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, F.col("w.end").alias("window_end"), "n", (F.col("n") / seconds).alias("rate"))


def islands(rows: DataFrame, keys: list[str], at: Column, state: Column) -> DataFrame:
    """keys, state, first and last time and number of rows of each run of one state."""
    order = W.partitionBy(*keys).orderBy("__at")
    marked = rows.withColumns({"__at": at, "__state": state})
    marked = marked.withColumn("__new", F.coalesce(F.col("__state") != F.lag("__state").over(order), F.lit(True)).cast("int"))
    marked = marked.withColumn("__run", F.sum("__new").over(order))
    return marked.groupBy(*keys, "__run").agg(F.first("__state").alias("state"), F.min("__at").alias("first_at"), F.max("__at").alias("last_at"), F.count(F.lit(1)).alias("n")).drop("__run")


def alerts(rated: DataFrame, keys: list[str], threshold: float, hold: str) -> DataFrame:
    """Runs of windows whose rate exceeds the threshold for the holding time or longer."""
    runs = islands(rated, keys, F.col("window_end"), F.col("rate") > threshold)
    return runs.where(F.col("state") & (F.col("last_at") - F.col("first_at") >= F.expr(f"interval {hold}"))).drop("state")


def pair_shadow(events: DataFrame) -> DataFrame:
    """First live and first shadow verdict of each (request, guard) that has both."""
    first = lambda shadow: F.min_by(F.when(F.col("is_shadow") == shadow, F.col("verdict")), F.when(F.col("is_shadow") == shadow, F.struct("ts", "event_id")))
    pairs = events.groupBy("request_id", "guard_id").agg(first(False).alias("live"), first(True).alias("shadow"))
    return pairs.where("live is not null and shadow is not null")


def shadow_delta(events: DataFrame) -> DataFrame:
    """Per guard: pairs, failures of either side, agreements and divergences, shares in percent."""
    g = pair_shadow(events).groupBy("guard_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("live") == "FAIL").alias("live_fail"), F.count_if(F.col("shadow") == "FAIL").alias("shadow_fail"),
        F.count_if(F.col("live") == F.col("shadow")).alias("agree"),
    )
    return g.withColumns({"diverge": F.col("pairs") - F.col("agree"), "agree_pct": 100.0 * F.col("agree") / F.col("pairs"), "live_fail_pct": 100.0 * F.col("live_fail") / F.col("pairs"), "shadow_fail_pct": 100.0 * F.col("shadow_fail") / F.col("pairs")})


def evidence_summary(events: DataFrame, hide_shadow: bool = False) -> DataFrame:
    """Totals for each scenario and overall (null) in one pass."""
    rows = events.where("not is_shadow") if hide_shadow else events
    return rows.rollup("scenario").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "FAIL").alias("fail"), F.count_if("is_shadow").alias("shadow"))


def incident_windows(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Sessions of errors of each (tenant, app, guard): first and last error and requests affected."""
    errors = events.where("verdict = 'ERROR'").groupBy("tenant", "app", "guard_id", F.session_window("ts", gap).alias("w"))
    return errors.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n_errors"), F.count_distinct("request_id").alias("n_requests")).drop("w")


def breaker_windows(events: DataFrame, keys: list[str], failures: int = 5, open_seconds: int = 15, block_seconds: int = 3600) -> DataFrame:
    """Where a breaker opens: at the failure that completes a run of so many and at every later failure of the run, each
    for so many seconds or until the success that ends the run, whichever comes first. Each stretch of block_seconds is
    walked by itself, so that the events of one guard are spread over all tasks; a stretch sums up to whether it has a
    success, when its first was, and how many failures follow its last, and these few rows of a guard are composed to the
    run that each stretch begins with and the success that comes after it. Events without a verdict don't count."""
    at = W.partitionBy(*keys, "__block").orderBy("ts", "event_id")
    good = F.col("verdict") != "ERROR"
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = events.where("verdict is not null").select(*keys, "ts", "event_id", good.alias("__good"), F.floor(seconds / block_seconds).alias("__block"))
    rows = rows.withColumn("__fails", F.count_if(~F.col("__good")).over(at))
    rows = rows.withColumns({"__base": F.last(F.when(F.col("__good"), F.col("__fails")), ignorenulls=True).over(at), "__reset": F.first(F.when(F.col("__good"), F.col("ts")), ignorenulls=True).over(at.rowsBetween(1, W.unboundedFollowing))})
    rows = rows.withColumn("__run", F.col("__fails") - F.coalesce("__base", F.lit(0)))
    blocks = rows.groupBy(*keys, "__block").agg(F.bool_or("__good").alias("__any"), F.min(F.when(F.col("__good"), F.col("ts"))).alias("__first"), F.max_by("__run", F.struct("ts", "event_id")).alias("__tail"))
    by_key = W.partitionBy(*keys).orderBy("__block")
    blocks = blocks.withColumn("__sum", F.sum("__tail").over(by_key))
    blocks = blocks.withColumn("__open", F.col("__sum") - F.coalesce(F.last(F.when(F.col("__any"), F.col("__sum") - F.col("__tail")), ignorenulls=True).over(by_key), F.lit(0)))
    blocks = blocks.select(*keys, "__block", F.coalesce(F.lag("__open").over(by_key), F.lit(0)).alias("__carried"), F.first("__first", ignorenulls=True).over(by_key.rowsBetween(1, W.unboundedFollowing)).alias("__later"))
    met = rows.where(~F.col("__good")).alias("r").join(blocks.alias("b"), [F.col(f"r.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in (*keys, "__block")], "left")
    run = F.col("__run") + F.when(F.col("__base").isNull(), F.col("__carried")).otherwise(0)
    late = F.col("ts") + F.expr(f"interval {open_seconds} seconds")
    return met.where(run >= failures).select(*[F.col(f"r.`{c}`") for c in keys], F.col("ts").alias("opened_at"), F.least(late, F.coalesce("__reset", "__later")).alias("closes_at"), run.alias("failures"))


def bundle_gauges(bundles: DataFrame, now: Column) -> DataFrame:
    """Per (tenant, env): the installed bundle's number and policies, how many were installed, and its age in seconds;
    bundles: (tenant, env, bundle_seq, created_at, n_policies)."""
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    newest = F.max_by(F.struct("created_at", "n_policies"), "bundle_seq").alias("b")
    g = bundles.groupBy("tenant", "env").agg(F.max("bundle_seq").alias("bundle_seq"), F.count(F.lit(1)).alias("installs"), newest)
    return g.select("tenant", "env", "bundle_seq", F.col("b.n_policies").alias("n_policies"), "installs", (seconds(now) - seconds(F.col("b.created_at"))).alias("age_seconds"))


# The alert rules on the age of bundles: name, seconds, severity.
BUNDLE_ALERTS = (("bundle_stale", 259_200, "warning"), ("bundle_age_critical", 604_800, "critical"))


def bundle_alerts(expected: DataFrame, bundles: DataFrame, now: Column, hold: int = 300) -> DataFrame:
    """(tenant, env, alert, severity): bundles older than a rule allows for `hold` seconds or longer, and gateways
    (expected: tenant, env) without any bundle or with number 0."""
    g = expected.select("tenant", "env").distinct().join(bundle_gauges(bundles, now), ["tenant", "env"], "left")
    missing = F.col("bundle_seq").isNull() | (F.col("bundle_seq") == 0)
    found = [F.when(missing, F.struct(F.lit("no_bundle_installed").alias("alert"), F.lit("warning").alias("severity")))]
    found += [F.when(~missing & (F.col("age_seconds") > limit + hold), F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"))) for name, limit, severity in BUNDLE_ALERTS]
    return g.select("tenant", "env", F.explode(F.array_compact(F.array(*found))).alias("a")).select("tenant", "env", "a.alert", "a.severity")
