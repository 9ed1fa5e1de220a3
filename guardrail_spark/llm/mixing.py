"""Mixing sources to target weights with soft memberships.

A naive Bayes classifier with normal features, learnt by SQL aggregates from all labelled rows, gives each document a
posterior over the domains of the labelled table. Then document rates are fitted: with n tokens and posterior p of a
document, the sums of rate * n * p over all documents, one for each domain, shall match the targets. Projected gradient
descent on the squared errors, scaled by tokens and by the overlap of the domains in the documents whose rates are free to
move: each step adds the domains' scaled errors, weighted by the document's posterior, and projects on [0, most]. A step's sums are one distributed aggregate; the driver holds the
domains' errors alone, a few numbers a step, and a document's rate is the fold of its posterior over them.

Rows are emitted by rate: floor(rate + u) copies with u uniform in [0, 1) from a hash of the id.

Defined cases: null text is empty and has no tokens; labels that are null don't count; a domain without labelled rows has
no share and no target; without labelled rows every rate is 1; ids that are null are hashed as null; repeated labels
count once each; labels of domains without a target don't count; a domain whose target can't be reached gets as near as the
rates allow; very long texts are read whole; other columns are ignored by `mix`, and `mixed_rows` keeps them, whatever
their names.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

STEPS, ENOUGH, LEAST_VARIANCE = 60, 1e-6, 1e-4
DOMAINS = ("low", "good")
#: Production targets as shares of all tokens.
TARGETS = {"low": 0.05, "good": 0.95}


def domain_of_labels() -> Column:
    return F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with id, n (tokens) and x (features): length, word length, variety of words, signs, marks, lines."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], t.alias("__t"), words.alias("__w"))
    chars, n = F.length("__t"), F.size("__w")
    share = lambda c: (chars - F.length(F.replace("__t", F.lit(c), F.lit("")))) / F.greatest(chars, F.lit(1))
    signs = sum((share(c) for c in "#$%*&"), F.lit(0.0))
    x = F.array(
        F.log1p(chars.cast("double")), chars / F.greatest(n, F.lit(1)), F.size(F.array_distinct("__w")) / F.greatest(n, F.lit(1)),
        F.sqrt(signs), F.sqrt(share("|")), F.sqrt(share("!")), F.sqrt(share("\n")),
    )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("id", "n", "x")], F.col(f"`{id_col}`").alias("id"), n.cast("long").alias("n"), x.alias("x"))


def fit_classifier(rows: DataFrame, labels: DataFrame, id_col: str, domain: Column, domains: tuple[str, ...]) -> list[tuple[float, list[float], list[float]]]:
    """For each domain ln prior, means and variances of the features over the labelled rows; empty without any."""
    # a repeated label counts once
    known = labels.select(F.col(f"`{id_col}`").alias("id"), domain.alias("domain")).where(F.col("domain").isin(*domains)).distinct()
    size = 7
    moments = [f(F.col("x")[i]).alias(f"{m}{i}") for i in range(size) for m, f in (("mean", F.mean), ("var", F.var_pop))]
    got = {r.domain: r for r in rows.join(known, "id").groupBy("domain").agg(F.count(F.lit(1)).alias("m"), *moments).collect()}
    total = sum(r.m for r in got.values())
    out = []
    for d in domains:
        r = got.get(d)
        out.append((float(r.m) / total, [r[f"mean{i}"] for i in range(size)], [max(r[f"var{i}"], LEAST_VARIANCE) for i in range(size)]) if r else (0.0, [0.0] * size, [1.0] * size))
    return out if total else []


def posteriors(rows: DataFrame, model: list[tuple[float, list[float], list[float]]]) -> DataFrame:
    """rows with p, the posterior over the domains."""
    logs = []
    for prior, means, variances in model:
        if not prior:
            logs.append(F.lit(float("-inf")))
            continue
        terms = [-(F.col("x")[i] - m) * (F.col("x")[i] - m) / (2 * v) - 0.5 * math.log(v) for i, (m, v) in enumerate(zip(means, variances))]
        logs.append(sum(terms, F.lit(math.log(prior))))
    p = rows.withColumn("l", F.array(*logs))
    p = p.withColumn("e", F.expr("transform(l, v -> exp(v - array_max(l)))"))
    return p.withColumn("p", F.expr("transform(e, v -> v / aggregate(e, 0D, (a, b) -> a + b))")).drop("x", "l", "e")


def _rate(errors: list[list[float]], size: int, most: float) -> Column:
    """1, moved by each step's errors in turn and kept in [0, most]."""
    if not errors:
        return F.lit(1.0)
    steps = "array(" + ", ".join("array(" + ", ".join(f"{e!r}D" for e in step) + ")" for step in errors) + ")"
    dot = " + ".join(f"q[{i}] * s[{i}]" for i in range(size))
    # q binds the posterior, so that a pushed-down filter computes it once and not in every step
    return F.expr(f"get(transform(array(p), q -> aggregate({steps}, 1D, (w, s) -> least({most!r}D, greatest(0D, w - ({dot}))))), 0)")


def fit_rates(known: DataFrame, targets: list[float], most: float, relative: bool) -> list[list[float]]:
    """The scaled errors of all steps for rows (n, p); `_rate` folds a posterior over them. Errors are scaled by the inverse
    of the sum of n p p' over the rows whose rate is free to move, which meets reachable targets in a few steps; where such a
    step doesn't lessen the error, it is taken back for one scaled by the sum over all rows, which always does."""
    size = len(targets)
    sums_of = lambda value: [F.sum(value * F.col("p")[i]) for i in range(size)]
    squares_of = lambda value: [F.sum(value * F.col("p")[i] * F.col("p")[j]) for i in range(size) for j in range(size)]
    numbers = lambda row: np.array([x or 0.0 for x in row], float)
    first = known.agg(F.sum("n"), *sums_of(F.col("n")), *squares_of(F.col("n"))).first()
    total, has = first[0] or 0, numbers(first[1 : size + 1])
    every = np.linalg.pinv(numbers(first[size + 1 :]).reshape(size, size))
    goal = np.array(targets) * (has if relative else total)
    share_of = lambda error: np.divide(np.abs(error), has, out=np.zeros(size), where=has > 0)
    if total and ((has == 0) & (goal > 0)).any():
        warnings.warn(f"domains without tokens can't be reached: {np.flatnonzero((has == 0) & (goal > 0)).tolist()}", RuntimeWarning, stacklevel=2)
    steps: list[list[float]] = []
    best, error, free = np.inf, np.zeros(size), every
    careful = beyond = done = False
    while total:
        # of the last step's direction also the least that any rates can reach along it: if that lies beyond the goal, the
        # targets are proved out of reach, and what is still to gain is bounded by the difference
        last = steps[-1] if steps else [0.0] * size
        along = sum((F.col("p")[i] * e for i, e in enumerate(last)), F.lit(0.0))
        inside = F.when((F.col("w") > 0) & (F.col("w") < most), F.col("n")).otherwise(0)
        found = known.select("n", "p", _rate(steps, size, most).alias("w")).agg(*sums_of(F.col("n") * F.col("w")), *squares_of(inside), F.sum(F.col("n") * most * F.least(F.lit(0.0), along))).first()
        new, squares, least = numbers(found[:size]) - goal, numbers(found[size:-1]).reshape(size, size), found[-1] or 0.0
        left = float(new @ every @ new)
        if left >= best and not careful and steps:
            steps[-1], careful = [float(x) for x in every @ error], True
            continue
        stalled = left >= best * (1 - 1e-9)
        error, best, free = new, left, np.linalg.pinv(squares)
        if steps:
            bound = least - float(np.dot(last, goal))
            beyond = beyond or bound > 0
            done = beyond and float(np.dot(last, error)) - bound <= ENOUGH * float(np.dot(np.abs(last), has))
        if share_of(error).max() < ENOUGH or done or stalled or len(steps) == STEPS:
            break
        careful = beyond or not squares.any()
        steps.append([float(x) for x in (every if careful else free) @ error])
    if total and share_of(error).max() >= ENOUGH:
        said = "came as near as it can" if done or beyond else f"ended after {len(steps)} steps"
        warnings.warn(f"the fit of rates {said}: {share_of(error).max():.3g} of a domain's tokens" + " from targets that are out of reach" * beyond, RuntimeWarning, stacklevel=2)
    return steps


@dataclass(frozen=True)
class Fitted:
    """A few numbers for each domain and step; `domains` is empty without labelled rows."""

    domains: tuple[str, ...]
    model: list[tuple[float, list[float], list[float]]]
    errors: list[list[float]]
    most: float

    def columns(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep, n_tokens, posteriors, rate and copies of rows that have id, n and x."""
        if not self.model:
            out = rows.select(*keep, "id", F.col("n").alias("n_tokens"), *[F.lit(None).cast("double").alias(f"p_{d}") for d in self.domains], F.lit(1.0).alias("rate"))
        else:
            rate = F.round(_rate(self.errors, len(self.domains), self.most), 6)
            ps = [F.round(F.col("p")[i], 6).alias(f"p_{d}") for i, d in enumerate(self.domains)]
            out = posteriors(rows, self.model).select(*keep, "id", F.col("n").alias("n_tokens"), *ps, rate.alias("rate"))
        u = F.pmod(F.xxhash64(F.lit("mix"), "id"), F.lit(1 << 30)) / float(1 << 30)
        return out.withColumn("copies", F.floor(F.col("rate") + u)).drop("id")


def fit(rows: DataFrame, labels: DataFrame, targets: dict[str, float], most: float = 1e9, relative: bool = False, id_col: str = "doc_id", domain: Column | None = None) -> Fitted:
    """Learns the classifier and the rates over rows of features(). Targets are shares of all tokens, or with `relative`
    multiples of what each domain has."""
    domains = tuple(targets)
    model = fit_classifier(rows, labels, id_col, domain_of_labels() if domain is None else domain, domains)
    if not model:
        return Fitted(domains, [], [], most)
    known = settled(posteriors(rows, model).select("n", "p"))
    return Fitted(domains, model, fit_rates(known, list(targets.values()), most, relative), most)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most: float = 1e9, relative: bool = False, id_col: str = "doc_id", text: str = "text", domain: Column | None = None) -> DataFrame:
    """id, n_tokens, one posterior column for each domain, rate and copies of every row."""
    rows = settled(features(docs, id_col, text).select("id", "n", "x"))
    fitted = fit(rows, labels, targets, most, relative, id_col, domain)
    return fitted.columns(rows.withColumn(id_col, F.col("id")), [f"`{id_col}`"])


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most: float = 1.0, relative: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, each as often as its copies say."""
    # whole rows travel in one column, so that none of theirs clashes with the features
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    rows = settled(features(whole, id_col, text).select("__row", "id", "n", "x"))
    kept = fit(rows, labels, targets, most, relative, id_col).columns(rows, ["__row"]).where("copies > 0")
    if most > 1:
        kept = kept.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return kept.select("__row.*")
