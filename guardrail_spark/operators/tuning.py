"""Threshold tuning from labelled feedback, and detector evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wilson

POSITIVE, NEGATIVE = ("true_positive", "false_negative"), ("false_positive", "true_negative")
# Fixed values of the tuner.
MIN_SAMPLES, MIN_CLASS, MAX_FN_RATE, MIN_MOVE = 20, 10, 0.005, 0.005
LOW_BY, HIGH_BY, FLOOR, CEILING, STEPS = 0.2, 0.15, 0.05, 0.99, 40


def labelled_samples(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """guard_id, score and positive of each feedback row that has its event, a score and a guard."""
    f = feedback.select("event_id", F.col("guard_id").alias("f_guard"), "disposition")
    e = events.select("event_id", F.col("guard_id").alias("e_guard"), "score")
    rows = f.join(e, "event_id").where("score is not null").withColumn("guard_id", F.coalesce(F.nullif("f_guard", F.lit("")), "e_guard"))
    positive = F.when(F.col("disposition").isin(*POSITIVE), True).when(F.col("disposition").isin(*NEGATIVE), False)
    return rows.withColumn("positive", positive).where("positive is not null and guard_id <> ''").select("event_id", "guard_id", "score", "positive")


def orphan_feedback(events: DataFrame, feedback: DataFrame) -> DataFrame:
    return feedback.join(events.select("event_id"), "event_id", "left_anti")


def grid(current: float) -> list[float]:
    """Candidate thresholds about the current one, in accumulated steps."""
    low, high = max(FLOOR, current - LOW_BY), min(CEILING, current + HIGH_BY)
    step, t, out = (high - low) / STEPS, low, []
    while t <= high:
        out.append(t)
        t += step
    return out


def grid_of(current: Column) -> Column:
    """The same of a column: steps are added up one by one, so the last one is subject to the same rounding."""
    low, high = F.greatest(F.lit(FLOOR), current - LOW_BY), F.least(F.lit(CEILING), current + HIGH_BY)
    ends = F.struct(low.alias("low"), ((high - low) / STEPS).alias("step"))
    more = lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + ends["step"]))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array(low), more)
    return F.filter(steps, lambda t: t <= high)


def confusion_over(samples: DataFrame, grids: DataFrame) -> DataFrame:
    """guard_id, i, t and the four counts at each threshold of the guards' grids (guard_id, ts: ascending). A sample adds to
    the last threshold that it reaches; sums from the end give what each threshold catches, so the cost doesn't grow with
    the grid. Samples are counted by guard and place alone; the grids join them, and then the counts, once."""
    grids = grids.where("guard_id is not null and ts is not null")
    rows = samples.select("guard_id", "score", "positive").join(grids, "guard_id")
    reached = F.size(F.filter("ts", lambda t: F.col("score") >= t))
    binned = rows.groupBy("guard_id", reached.alias("k")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    per = binned.groupBy("guard_id").agg(F.collect_list(F.struct("k", "p", "n")).alias("bins"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    flat = per.join(grids, "guard_id").select("guard_id", "bins", "pos", "neg", F.posexplode("ts").alias("i", "t"))
    caught = lambda f: F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(b["k"] > F.col("i"), b[f]).otherwise(0))
    c = flat.withColumns({"tp": caught("p"), "fp": caught("n")})
    c = c.withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")})
    rate = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0)
    return c.select("guard_id", "i", "t", "tp", "fp", "fn", "tn", rate("fp", "neg").alias("fp_rate"), rate("fn", "pos").alias("fn_rate"))


def confusion_at(samples: DataFrame, thresholds: Column) -> DataFrame:
    """The same at one array of thresholds for all guards."""
    return confusion_over(samples, samples.select("guard_id").distinct().withColumn("ts", thresholds))


def recommend_thresholds(samples: DataFrame, current: DataFrame) -> DataFrame:
    """guard_id, before, after (3 decimals) and its rates for the guards that a move improves; current: (guard_id,
    threshold), one for each guard, numeric ones only."""
    now = current.where("threshold is not null").select("guard_id", F.col("threshold").cast("double").alias("__now"))
    tried = confusion_over(samples, now.select("guard_id", grid_of(F.col("__now")).alias("ts"))).withColumn("low_high", F.struct(*wilson(F.col("fp"), F.col("fp") + F.col("tn"))))
    base = confusion_over(samples, now.select("guard_id", F.array("__now").alias("ts"))).select("guard_id", F.col("t").alias("before"), F.col("fp_rate").alias("was"), (F.col("tp") + F.col("fn")).alias("pos"), (F.col("fp") + F.col("tn")).alias("neg"))
    ok = tried.join(base, "guard_id").where((F.col("pos") + F.col("neg") >= MIN_SAMPLES) & (F.col("pos") >= MIN_CLASS) & (F.col("neg") >= MIN_CLASS))
    ok = ok.where((F.col("fp_rate") < F.col("was")) & (F.col("fn_rate") <= MAX_FN_RATE) & (F.col("low_high.col2") < F.col("was")))
    best = ok.groupBy("guard_id").agg(F.min_by(F.struct("before", "t", "fp_rate", "fn_rate"), F.struct("fp_rate", "i")).alias("b"))
    best = best.where(F.abs(F.col("b.t") - F.col("b.before")) >= MIN_MOVE)
    return best.select("guard_id", "b.before", F.round("b.t", 3).alias("after"), "b.fp_rate", "b.fn_rate")


def label_confusion(rows: DataFrame, expected: str, detected: str) -> DataFrame:
    """label, tp, fp, fn over rows of two arrays of labels."""
    both = rows.select(F.array_distinct(expected).alias("e"), F.array_distinct(detected).alias("d"))
    marks = lambda c, kind: F.transform(c, lambda x: F.struct(x.alias("label"), F.lit(kind).alias("kind")))
    flat = both.select(F.explode(F.concat(marks(F.array_intersect("e", "d"), "tp"), marks(F.array_except("d", "e"), "fp"), marks(F.array_except("e", "d"), "fn"))).alias("x"))
    return flat.groupBy("x.label").agg(*[F.count_if(F.col("x.kind") == k).alias(k) for k in ("tp", "fp", "fn")])


def prf(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label and, as label TOTAL, of all: 1 where nothing can be missed, F1 0 at 0 + 0."""
    sums = confusion.rollup("label").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")]).withColumn("label", F.coalesce("label", F.lit("TOTAL")))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(1.0)
    out = sums.withColumns({"precision": share("fp"), "recall": share("fn")})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def benchmark_catalog(catalog: DataFrame, confusion: DataFrame, latencies: DataFrame) -> DataFrame:
    """catalog (detector_id, version) with its benchmark: cases, precision, recall, F1 and the 95th percentile of latency;
    selectable only with one. confusion: (detector_id, version, tp, fp, fn, cases) counts, in any number of rows;
    latencies: (detector_id, version, latency_ms)."""
    keys = ["detector_id", "version"]
    sums = confusion.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "cases")])
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(1.0)
    sums = sums.withColumns({"precision": share("fp"), "recall": share("fn")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    p95 = latencies.groupBy(*keys).agg(F.percentile("latency_ms", 0.95).alias("latency_ms_p95"))
    out = catalog.join(sums.withColumn("f1", f1).drop("tp", "fp", "fn"), keys, "left").join(p95, keys, "left")
    return out.withColumn("selectable", F.col("cases").isNotNull() & F.col("latency_ms_p95").isNotNull())


def gate(scores: DataFrame, least: float = 0.95) -> DataFrame:
    """The micro precision and whether it reaches the promotion gate."""
    return scores.where("label = 'TOTAL'").select("precision", (F.col("precision") >= least).alias("passed"))
