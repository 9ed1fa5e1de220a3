"""Policies: resolution onto requests, bundles, corpus checks and lifecycles.

policies: (policy_key, tenant, policy_id, version, status, env, app, created_at, approved_at, default_fail_mode, origin,
change_class, author, approver); guards: (policy_key, pos, guard_id, scenario, detector, direction, threshold, on_fail,
fail_mode, evidence, shadow, verify_live). policies_of_documents and guards_of_documents make them from JSON documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import bump_patch, canonical_json_text, canonical_value, last_key_counts, text_hash
from ..sources.shared import meet, settled

DOCUMENT = (
    "apiVersion string, kind string, metadata struct<id:string,version:string,tenant:string,status:string,parent:string,origin:string,labels:map<string,string>>,"
    "spec struct<applies_to:struct<apps:array<string>,environments:array<string>>,defaults:struct<fail_mode:string,timeout_ms:int>,"
    "guards:array<struct<id:string,scenario:string,detector:string,direction:array<string>,threshold:string,on_fail:string,"
    "config:map<string,string>,evidence:string,fail_mode:string,shadow:boolean>>>"
)
BLOCKING = ("block", "block_and_explain")
SCENARIOS = ("pii", "secrets", "content_safety", "hallucination")


def policy_index(documents: DataFrame, document: str = "document", wildcard: bool = False) -> DataFrame:
    """One row for each (app, env) of each parsed policy document; documents without targets drop out. `*` is a name like
    any other unless wildcard, when it stays null to match all."""
    rows = documents.withColumn("doc", F.from_json(document, DOCUMENT)).where("doc.spec.applies_to is not null")
    rows = rows.withColumn("app", F.explode("doc.spec.applies_to.apps")).withColumn("env", F.explode("doc.spec.applies_to.environments"))
    if wildcard:
        rows = rows.withColumns({c: F.nullif(c, F.lit("*")) for c in ("app", "env")})
    return rows.select("app", "env", F.col("doc.metadata.id").alias("policy_id"), F.col("doc.metadata.version").alias("version"), "doc")


def guards_of_documents(documents: DataFrame, document: str = "document") -> DataFrame:
    """The guards of parsed documents in order of execution, with defaults for what is missing."""
    rows = documents.select("*", F.from_json(document, DOCUMENT).alias("doc")).select("*", F.posexplode("doc.spec.guards").alias("pos", "g"))
    text = lambda c: F.coalesce(F.col(f"g.{c}"), F.lit("")).alias(c)
    return rows.select(
        F.col("doc.metadata.id").alias("policy_id"), F.col("doc.metadata.version").alias("version"), "pos", F.coalesce("g.id", F.lit("")).alias("guard_id"), text("scenario"), text("detector"),
        F.filter("g.direction", lambda d: d.isNotNull()).alias("direction"), F.col("g.threshold").try_cast("double").alias("threshold"), text("on_fail"), text("fail_mode"), text("evidence"), F.coalesce("g.shadow", F.lit(False)).alias("shadow"),
    )


def guard_plan(documents: DataFrame, document: str = "document") -> DataFrame:
    """(app, env, step, pos, policy, guard_id, ...) of JSON policy documents: the guards that a request of an (app, env)
    meets, policies in order of id and version."""
    modes = documents.select(F.from_json(document, DOCUMENT).alias("doc")).select(F.col("doc.metadata.id").alias("policy_id"), F.col("doc.metadata.version").alias("version"), F.coalesce("doc.spec.defaults.fail_mode", F.lit("")).alias("default_fail_mode"))
    guards = guards_of_documents(documents, document).withColumnRenamed("direction", "guard_direction").join(modes, ["policy_id", "version"])
    ranked = policy_index(documents, document).drop("doc").withColumn("step", F.dense_rank().over(W.partitionBy("app", "env").orderBy("policy_id", "version")))
    rows = ranked.join(guards, ["policy_id", "version"])
    return rows.select("app", "env", "step", "pos", F.concat_ws("@", "policy_id", "version").alias("policy"), "guard_id", "scenario", "detector", "guard_direction", "on_fail", "fail_mode", "default_fail_mode", "shadow")


def fan_out(requests: DataFrame, policies: DataFrame, guards: DataFrame) -> DataFrame:
    """Each request with the guards of the policies for its (app, env) that watch its direction. The guards are counted first:
    a few are broadcast, many meet each (app, env) in parts."""
    plan = policies.select("policy_key", "policy_id", "app", "env", "default_fail_mode").join(guards, "policy_key")
    return meet(requests, plan, ["app", "env"], plan.count()).where((F.col("direction") == F.col("guard_direction")) | (F.col("guard_direction") == "both"))


def fan_out_counts(requests: DataFrame, policies: DataFrame, guards: DataFrame) -> DataFrame:
    """(app, policy_id, scenario, n): the rows of fan_out counted, without making them: both sides are counted first."""
    asked = requests.groupBy("app", "env", "direction").agg(F.count(F.lit(1)).alias("n_requests"))
    plan = policies.select("policy_key", "policy_id", "app", "env").join(guards, "policy_key")
    plan = plan.groupBy("app", "env", "policy_id", "scenario", "guard_direction").agg(F.count(F.lit(1)).alias("n_guards"))
    met = asked.join(plan, ["app", "env"]).where((F.col("direction") == F.col("guard_direction")) | (F.col("guard_direction") == "both"))
    return met.groupBy("app", "policy_id", "scenario").agg(F.sum(F.col("n_requests") * F.col("n_guards")).alias("n"))


def with_detector(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows with the catalog's digest and whether their detector is unknown."""
    known = catalog.select(F.concat_ws("@", "detector_id", "version").alias("detector"), "image_digest")
    return rows.join(known, "detector", "left").withColumn("missing", F.col("image_digest").isNull())


def apply_fail_mode(rows: DataFrame) -> DataFrame:
    """rows (verdict, fail_mode, default_fail_mode) with the mode in force and the effective verdict."""
    mode = F.coalesce(F.nullif("fail_mode", F.lit("")), F.nullif("default_fail_mode", F.lit("")), F.lit("closed"))
    verdict = F.when(F.col("verdict") != "ERROR", F.col("verdict")).when(mode == "open", "PASS").otherwise("FAIL")
    return rows.withColumns({"mode": mode, "effective": verdict})


def escalate(tier1: DataFrame, tier2: DataFrame, floor: float = 0.5) -> DataFrame:
    """tier1 (id, verdict, score, threshold) with the second tier's result where the score lies in [floor, threshold)."""
    second = tier2.select("id", F.col("verdict").alias("v2"), F.col("score").alias("s2"))
    # only the borderline band needs the second tier
    band = (F.col("score") >= floor) & (F.col("score") < F.coalesce("threshold", F.lit(1.0)))
    borderline = tier1.where(band).join(second, "id", "left")
    take = F.col("v2").isNotNull() & (F.col("v2") != "ERROR")
    up = borderline.select("id", F.when(take, F.col("v2")).otherwise(F.col("verdict")).alias("verdict"), F.when(take, F.col("s2")).otherwise(F.col("score")).alias("score"), take.alias("escalated"))
    return up.unionByName(tier1.where(~F.coalesce(band, F.lit(False))).select("id", "verdict", "score", F.lit(False).alias("escalated")))


def latest_approved(policies: DataFrame) -> DataFrame:
    """Versions approved last; ties all stay."""
    order = W.partitionBy("tenant", "policy_id").orderBy(F.col("approved_at").desc())
    return policies.where("status = 'approved' and approved_at is not null").withColumn("rank", F.rank().over(order)).where("rank = 1").drop("rank")


def current_version(policies: DataFrame) -> DataFrame:
    """The newest approved version of each policy."""
    order = W.partitionBy("tenant", "policy_id").orderBy(F.col("created_at").desc(), F.col("policy_key").desc())
    return policies.where("status = 'approved'").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def scope_env(policies: DataFrame, env: str) -> DataFrame:
    """Policies for an environment: `env` names one, or lists several."""
    listed = policies.schema["env"].dataType.typeName() == "array"
    return policies.where(F.array_contains("env", env) if listed else F.col("env") == env)


def detector_refs(guards: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct detectors of the guards with their digest, empty when the catalog lacks them, in order."""
    refs = guards.select(F.split("detector", "@", 2)[0].alias("detector_id"), F.get(F.split("detector", "@", 2), F.lit(1)).alias("version")).distinct()
    return refs.join(catalog, ["detector_id", "version"], "left").withColumn("image_digest", F.coalesce("image_digest", F.lit(""))).orderBy("detector_id", "version")


def unpinned_detectors(guards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Detectors that the manifest lacks or has without a digest."""
    return detector_refs(guards, manifest).where("image_digest = ''").select("detector_id", "version")


def build_manifest(policies: DataFrame, guards: DataFrame, catalog: DataFrame, bundles: DataFrame, env: str) -> DataFrame:
    """Per tenant: the next bundle number, the manifest (canonical JSON: policies with the hashes of their documents, and
    the detectors that they pin) and its hash. policies may have a `document` (JSON text); without one a version's own
    columns make its document."""
    chosen = scope_env(latest_approved(policies), env)
    pinned = chosen.join(guards.select("policy_key", "detector"), "policy_key")
    refs = pinned.select("tenant", F.split("detector", "@", 2)[0].alias("detector_id"), F.get(F.split("detector", "@", 2), F.lit(1)).alias("version")).distinct()
    refs = refs.join(catalog, ["detector_id", "version"], "left")
    refs = refs.withColumn("image_digest", F.coalesce("image_digest", F.lit("")))
    listed = refs.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_detectors"), F.array_sort(F.collect_list(F.struct("detector_id", "version", "image_digest"))).alias("detectors"))
    with last_key_counts(chosen.sparkSession):
        hashed = chosen.withColumn("document_hash", document_hash(chosen))
    docs = hashed.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_policies"), F.array_sort(F.collect_list(F.struct("policy_id", "version", "document_hash"))).alias("policies"))
    seqs = bundles.where(F.col("env") == env).groupBy("tenant").agg(F.max("bundle_seq").alias("last"))
    out = docs.join(listed, "tenant", "left").join(seqs, "tenant", "left").withColumn("bundle_seq", F.coalesce("last", F.lit(0)) + 1)
    none = F.array().cast(out.schema["detectors"].dataType)
    out = out.withColumn("m", F.struct("tenant", F.lit(env).alias("env"), "bundle_seq", "policies", F.coalesce("detectors", none).alias("detectors")))
    out = out.withColumn("manifest", canonical_value(F.col("m"), out.schema["m"].dataType))
    return out.select("tenant", F.lit(env).alias("env"), "bundle_seq", "n_policies", F.coalesce("n_detectors", F.lit(0)).alias("n_detectors"), "manifest", text_hash(F.col("manifest")).alias("manifest_hash"))


MANIFEST = "bundle_seq long, detectors array<struct<detector_id:string,version:string,image_digest:string>>, env string, policies array<struct<policy_id:string,version:string,document_hash:string>>, tenant string"


def verify_manifest(manifests: DataFrame, policies: DataFrame) -> DataFrame:
    """(tenant, env, bundle_seq, hash_ok, n_bad): whether the manifest's hash is its own, and how many policies it lists
    whose documents (policies) are missing or hash otherwise."""
    doc = F.from_json("manifest", MANIFEST)
    rows = manifests.withColumn("doc", doc).withColumn("hash_ok", F.coalesce(text_hash(canonical_value(F.col("doc"), T._parse_datatype_string(MANIFEST))) == F.col("manifest_hash"), F.lit(False)))
    listed = rows.select("tenant", "env", "bundle_seq", "hash_ok", F.explode_outer("doc.policies").alias("p"))
    with last_key_counts(policies.sparkSession):
        stored = policies.select("tenant", "policy_id", "version", document_hash(policies).alias("stored")).distinct()
    met = listed.select("*", F.col("p.policy_id").alias("policy_id"), F.col("p.version").alias("version")).join(stored, ["tenant", "policy_id", "version"], "left")
    # of several documents under one version one must fit
    each = met.groupBy("tenant", "env", "bundle_seq", "hash_ok", "policy_id", "version", "p").agg(F.max(F.coalesce(F.col("stored") == F.col("p.document_hash"), F.lit(False))).alias("fits"))
    return each.groupBy("tenant", "env", "bundle_seq", "hash_ok").agg(F.count_if(F.col("p").isNotNull() & ~F.col("fits")).alias("n_bad"))


def verify_hashes(rows: DataFrame, content: str, stored: str) -> DataFrame:
    """rows with `ok`: the stored hash is that of the content."""
    return rows.withColumn("ok", F.sha2(F.col(content), 256) == F.col(stored))


def latest_bundle(bundles: DataFrame, since: int = 0) -> DataFrame:
    """The newest bundle of each (tenant, env), if newer than since."""
    return bundles.groupBy("tenant", "env").agg(F.max("bundle_seq").alias("bundle_seq"), F.max_by("created_at", "bundle_seq").alias("created_at")).where(F.col("bundle_seq") > since)


def stale_bundles(bundles: DataFrame, now: Column, max_age_hours: int = 72) -> DataFrame:
    """Bundles older than allowed; zero or less allows any age."""
    if max_age_hours <= 0:
        return bundles.where("false")
    return bundles.where(now - F.expr(f"interval {max_age_hours} hours") > F.col("created_at"))


def diff_rules(existing: DataFrame, feed: DataFrame) -> DataFrame:
    """(id, regex, change, signature) of feed rules that are new or differ: one changed pattern makes a scope change."""
    new = feed.join(existing.select("id"), "id", "left_anti").select("id", "regex", F.lit("monotonic_add").alias("change"))
    changed = feed.join(existing.select("id", F.col("regex").alias("old")), "id").where("regex <> old").select("id", "regex", F.lit("scope_change").alias("change"))
    return new.unionByName(changed).withColumn("signature", F.substring(F.sha2(F.concat_ws("\x00", "id", "regex"), 256), 1, 16))


#: Lines that meet in one task.
LINES = 1 << 19


def diff_versions(lines: DataFrame, together: int | None = None) -> DataFrame:
    """Lines (policy_id, side, line) that the other side of their policy lacks. All lines meet by one shuffle, in as many
    parts as `together` lines each take, so that no task grows with the table. A null equals nothing."""
    n = lines.count() // (LINES if together is None else together) + 1
    rows = lines.where(F.col("side").isin("a", "b")).repartition(n, "policy_id", "line")
    same = W.partitionBy("policy_id", "line")
    alone = F.col("policy_id").isNull() | F.col("line").isNull() | (F.min("side").over(same) == F.max("side").over(same))
    return rows.withColumn("__alone", alone).where("__alone").drop("__alone")


def pretty_lines(json: Column) -> Column:
    """The lines of JSON text with sorted keys and two blanks for each level; null where it is no JSON."""
    tokens = F.regexp_extract_all(canonical_json_text(json), F.lit(r'("(?:[^"\\]|\\.)*"|\{\}|\[\]|[{}\[\],:]|[^{}\[\],:"]+)'), F.lit(1))
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def step(acc: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        text = F.when(opens | (t == ","), F.concat(t, line(depth))).when(closes, F.concat(line(depth), t)).when(t == ":", ": ").otherwise(t)
        return F.struct(depth.alias("depth"), F.concat(acc["parts"], F.array(text)).alias("parts"))

    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"))
    return F.split(F.array_join(F.aggregate(tokens, zero, step, lambda acc: acc["parts"]), ""), "\n", -1)


def diff_documents(versions: DataFrame, older: str = "older", newer: str = "newer") -> DataFrame:
    """The other columns of versions, side (a: older, b: newer), n and line of every line of a version's document (JSON text)
    that the other one has nowhere. Two documents meet in their own row, so nothing is shuffled. Null documents have no
    lines, and what is no JSON has none."""
    with last_key_counts(versions.sparkSession):
        rows = versions.select(*[F.col(f"`{c}`") for c in versions.columns if c not in (older, newer)], pretty_lines(F.col(f"`{older}`")).alias("__a"), pretty_lines(F.col(f"`{newer}`")).alias("__b"))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("__a", "__b")})

    def only(side: str, mine: str, other: str) -> Column:
        numbered = F.transform(mine, lambda l, i: F.struct(F.lit(side).alias("side"), (i + 1).cast("long").alias("n"), l.alias("line")))
        return F.filter(numbered, lambda x: ~F.array_contains(F.col(other), x["line"]))

    return rows.select("*", F.inline(F.concat(only("a", "__a", "__b"), only("b", "__b", "__a")))).drop("__a", "__b")


def fail_open_exposure(events: DataFrame, guards: DataFrame) -> DataFrame:
    """Errors of guards that fail open, by guard."""
    open_guards = guards.where("fail_mode = 'open'").select("guard_id").distinct()
    return events.where("verdict = 'ERROR'").join(open_guards, "guard_id", "left_semi").groupBy("tenant", "app", "guard_id").agg(F.count(F.lit(1)).alias("n"))


def current_thresholds(guards: DataFrame) -> DataFrame:
    return guards.withColumn("threshold", F.col("threshold").try_cast("double")).where("threshold is not null").select("policy_key", "guard_id", "threshold")


def apply_thresholds(policies: DataFrame, guards: DataFrame, recommended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions of the policies whose guards move: patch raised, parent set, a draft of the tuner without approval."""
    moved = guards.join(recommended.select("guard_id", "after"), "guard_id", "left")
    touched = moved.where("after is not null").select("policy_key").distinct()
    rows = moved.join(touched, "policy_key", "left_semi").withColumn("threshold", F.coalesce("after", "threshold")).drop("after")
    new = policies.join(touched, "policy_key", "left_semi").withColumn("parent", F.col("version"))
    new = new.withColumns({"version": bump_patch(F.col("version")), "status": F.lit("draft"), "origin": F.lit("autotuner"), "approved_at": F.lit(None).cast("timestamp_ntz")})
    return new, rows


# What the policy schema allows.
STATUSES = ("draft", "in_review", "approved", "deprecated", "revoked")
ORIGINS = ("manual", "feed", "synthesizer", "autotuner")
ACTIONS = ("block", "redact", "rewrite", "flag", "reask", "block_and_explain", "mask")
FAIL_MODES, DIRECTIONS, EVIDENCE = ("open", "closed"), ("input", "output"), ("none", "spans", "full_text")
API_VERSION_KIND = "Policy"
PATTERNS = {"id": r"^[a-z0-9][a-z0-9-]{1,62}[a-z0-9]$", "version": r"^\d+\.\d+\.\d+$", "guard": r"^g-[a-z0-9][a-z0-9-]*$", "detector": r"^[a-z0-9][a-z0-9-]*@\d+\.\d+\.\d+$"}


def _issue(bad: Column, code: str, path: str | Column, message: str | Column) -> Column:
    as_text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), as_text(path).alias("path"), as_text(message).alias("message")))


def _missing(c: Column) -> Column:
    return c.isNull()


def _outside(c: Column, allowed: tuple[str, ...]) -> Column:
    return c.isNotNull() & ~c.isin(*allowed)


def guard_issues(g: Callable[[str], Column], path: Column) -> list[Column]:
    """What the schema finds wrong with a guard; g gives its fields: guard_id, scenario, detector, direction (an array or one
    of input, output, both), threshold (number or text), on_fail, fail_mode, evidence."""
    at = lambda f: F.concat(path, F.lit(f".{f}"))
    out = [_issue(_missing(g(f)), "schema.required", path, f"{name} is a required property") for f, name in (("guard_id", "id"), ("scenario", "scenario"), ("detector", "detector"), ("direction", "direction"), ("on_fail", "on_fail"))]
    for f, name, pattern in (("guard_id", "id", "guard"), ("detector", "detector", "detector")):
        out.append(_issue(~g(f).rlike(PATTERNS[pattern]), "schema.pattern", at(name), F.concat(g(f), F.lit(f" does not match {PATTERNS[pattern]}"))))
    for f, allowed in (("scenario", SCENARIOS), ("on_fail", ACTIONS), ("fail_mode", FAIL_MODES), ("evidence", EVIDENCE)):
        out.append(_issue(_outside(g(f), allowed), "schema.enum", at(f), F.concat(g(f), F.lit(f" is not one of {', '.join(allowed)}"))))
    t = g("threshold").cast("string")
    number = t.try_cast("double")
    wrong = t.isNotNull() & (t != "default") & (number.isNull() | (number < 0) | (number > 1))
    out.append(_issue(wrong, "schema.threshold", at("threshold"), F.concat(t, F.lit(" is neither default nor within 0 and 1"))))
    d = g("direction")
    out.append(_issue(F.size(d) == 0, "schema.minItems", at("direction"), "no direction"))
    out.append(_issue(F.size(F.array_distinct(d)) < F.size(d), "schema.uniqueItems", at("direction"), "a direction stands twice"))
    out.append(_issue(F.exists(d, lambda x: ~x.isin(*DIRECTIONS)), "schema.enum", at("direction"), f"a direction is not one of {', '.join(DIRECTIONS)}"))
    return out


def document_issues(documents: DataFrame, document: str = "document", api_version: str | None = None) -> DataFrame:
    """documents with (code, path, message) of each structural error of policy documents (JSON text): required fields,
    constants, patterns, enumerations, ranges, least numbers of items, items that repeat. Text that is no object gives one
    error. A document's issues are made in its own row; nothing is shuffled."""
    keep = documents.columns
    rows = documents.withColumns({"doc": F.from_json(document, DOCUMENT), "raw": F.try_parse_json(document)})
    has = lambda p: F.expr(f"variant_get(raw, '$.{p}') is not null")
    c = lambda p: F.col(f"doc.{p}")
    no_object = F.col("raw").isNull() | ~F.coalesce(F.expr("schema_of_variant(raw)").startswith("OBJECT"), F.lit(False))
    found = [_issue(~has(p), "schema.required", p.rpartition(".")[0], f"{p.rpartition('.')[2]} is a required property") for p in ("apiVersion", "kind", "metadata", "spec")]
    for parent, names in (("metadata", ("id", "version", "tenant", "status")), ("spec", ("applies_to", "guards")), ("spec.applies_to", ("apps", "environments"))):
        found += [_issue(has(parent) & ~has(f"{parent}.{n}"), "schema.required", parent, f"{n} is a required property") for n in names]
    found.append(_issue(c("kind") != API_VERSION_KIND, "schema.const", "kind", f"{API_VERSION_KIND} was expected"))
    if api_version:
        found.append(_issue(c("apiVersion") != api_version, "schema.const", "apiVersion", f"{api_version} was expected"))
    for n in ("id", "version"):
        found.append(_issue(~c(f"metadata.{n}").rlike(PATTERNS[n]), "schema.pattern", f"metadata.{n}", F.concat(c(f"metadata.{n}"), F.lit(f" does not match {PATTERNS[n]}"))))
    found.append(_issue(c("metadata.tenant") == "", "schema.minLength", "metadata.tenant", "the tenant is empty"))
    for p, allowed in (("metadata.status", STATUSES), ("metadata.origin", ORIGINS), ("spec.defaults.fail_mode", FAIL_MODES)):
        found.append(_issue(_outside(c(p), allowed), "schema.enum", p, F.concat(c(p), F.lit(f" is not one of {', '.join(allowed)}"))))
    for n in ("apps", "environments"):
        p = f"spec.applies_to.{n}"
        found.append(_issue(F.size(c(p)) == 0, "schema.minItems", p, f"no {n}"))
        found.append(_issue(F.exists(c(p), lambda x: x == ""), "schema.minLength", p, f"one of {n} is empty"))
    timeout = c("spec.defaults.timeout_ms")
    found.append(_issue((timeout < 1) | (timeout > 60_000), "schema.range", "spec.defaults.timeout_ms", F.concat(timeout.cast("string"), F.lit(" is not within 1 and 60000"))))
    found.append(_issue(F.size(c("spec.guards")) == 0, "schema.minItems", "spec.guards", "no guards"))

    def of_guard(g: Column, i: Column) -> Column:
        field = lambda f: g["id" if f == "guard_id" else f]
        return F.array_compact(F.array(*guard_issues(field, F.concat(F.lit("spec.guards."), i.cast("string")))))

    guards = F.coalesce(F.flatten(F.transform(c("spec.guards"), of_guard)), F.array().cast("array<struct<code:string,path:string,message:string>>"))
    every = F.when(no_object, F.array(F.struct(F.lit("schema.type").alias("code"), F.lit("").alias("path"), F.lit("the document is no object").alias("message")))).otherwise(F.concat(F.array_compact(F.array(*found)), guards))
    return rows.select(*[F.col(f"`{k}`") for k in keep], F.inline(every))


def schema_issues(policies: DataFrame, guards: DataFrame) -> DataFrame:
    """The same for policies and guards as tables: (policy_key, code, path, message)."""
    g = guards.withColumn("direction", F.when(F.col("direction") == "both", F.array(F.lit("input"), F.lit("output"))).when(F.col("direction").isNotNull(), F.array("direction"))) if guards.schema["direction"].dataType.typeName() == "string" else guards
    of_guards = g.select("policy_key", F.inline(F.array_compact(F.array(*guard_issues(F.col, F.concat(F.lit("spec.guards."), F.col("guard_id")))))))
    p = [_issue(_missing(F.col(n)), "schema.required", "metadata", f"{name} is a required property") for n, name in (("policy_id", "id"), ("version", "version"), ("tenant", "tenant"), ("status", "status"))]
    p += [_issue(~F.col(n).rlike(PATTERNS[name]), "schema.pattern", f"metadata.{name}", F.concat(n, F.lit(f" does not match {PATTERNS[name]}"))) for n, name in (("policy_id", "id"), ("version", "version"))]
    p += [_issue(_outside(F.col("status"), STATUSES), "schema.enum", "metadata.status", F.concat("status", F.lit(f" is not one of {', '.join(STATUSES)}")))]
    p += [_issue(_outside(F.col("origin"), ORIGINS), "schema.enum", "metadata.origin", F.concat("origin", F.lit(f" is not one of {', '.join(ORIGINS)}")))] if "origin" in policies.columns else []
    p += [_issue(_outside(F.col("default_fail_mode"), FAIL_MODES), "schema.enum", "spec.defaults.fail_mode", F.concat("default_fail_mode", F.lit(f" is not one of {', '.join(FAIL_MODES)}")))]
    empty = policies.join(guards.select("policy_key").distinct(), "policy_key", "left_anti").select("policy_key", F.lit("schema.minItems").alias("code"), F.lit("spec.guards").alias("path"), F.lit("no guards").alias("message"))
    return policies.select("policy_key", F.inline(F.array_compact(F.array(*p)))).unionByName(of_guards).unionByName(empty)


def lint(policies: DataFrame, guards: DataFrame, schema_gate: bool = True) -> DataFrame:
    """Issues (policy_key, code, severity, path, message) of five rules; policies with structural errors get only those,
    unless schema_gate is off. The rule on streaming needs policies.streaming."""
    # read twice: to report them, and to know the policies that have none
    structural = settled(schema_issues(policies, guards).withColumn("severity", F.lit("error"))) if schema_gate else None
    rows = guards.join(policies.select("policy_key", "env", "default_fail_mode", *(["streaming"] if "streaming" in policies.columns else [])), "policy_key")
    if schema_gate:
        rows = rows.join(structural.select("policy_key").distinct(), "policy_key", "left_anti")
    path = lambda end="": F.concat(F.lit("spec.guards."), "guard_id", F.lit(end))
    named = lambda rest: F.concat(F.lit("guard "), "guard_id", F.lit(rest))
    in_prod = F.array_contains("env", "prod") if policies.schema["env"].dataType.typeName() == "array" else F.col("env") == "prod"
    rules = [
        (F.col("fail_mode").isNull() & F.col("default_fail_mode").isNull(), "fail_mode.missing", "error", "", " has no fail_mode and the policy has no default"),
        (in_prod & (F.col("scenario") == "secrets") & F.col("verify_live"), "secrets.verify_live_prod", "error", ".config.verify_live", ": live verification is not allowed in prod"),
        ((F.col("scenario") == "pii") & (F.col("evidence") == "full_text"), "pii.full_text_evidence", "error", ".evidence", ": full text must not be kept as evidence of personal data"),
    ]
    if "streaming" in policies.columns:
        rules.append((F.col("streaming") & (F.col("on_fail") == "block_and_explain"), "streaming.block_and_explain", "warn", ".on_fail", ": block_and_explain on a stream comes only at its end"))
    each_rule = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), path(end).alias("path"), F.lit(severity).alias("severity"), named(said).alias("message"))) for bad, code, severity, end, said in rules]
    found = rows.select("policy_key", F.inline(F.array_compact(F.array(*each_rule))))
    each = rows.withColumn("d", F.explode(F.when(F.col("direction") == "both", F.array(F.lit("input"), F.lit("output"))).otherwise(F.array("direction"))))
    stops = F.col("on_fail").isin(*BLOCKING)
    clash = each.groupBy("policy_key", "scenario", "d").agg(F.bool_or(stops).alias("a"), F.bool_or(~stops).alias("b"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("guard_id")).alias("ids")).where("a and b and n > 1")
    said = F.concat(F.lit("guards on "), "scenario", F.lit(" and "), "d", F.lit(" have conflicting actions: "), F.array_join("ids", ", "))
    found = found.unionByName(clash.select("policy_key", F.lit("guards.contradictory").alias("code"), F.lit("spec.guards").alias("path"), F.lit("warn").alias("severity"), said.alias("message")))
    return found.unionByName(structural.select(*found.columns)) if schema_gate else found


LEGAL = {("draft", "submit"): "in_review", ("in_review", "approve"): "approved", ("in_review", "reject"): "draft", ("approved", "revoke"): "revoked"}


STATES = ("draft", "in_review", "approved", "revoked")


def replay_lifecycle(audit: DataFrame, block: int = 1000) -> DataFrame:
    """audit (key, at, action) with the state before and after each action and whether it was legal; illegal ones change
    nothing. The rows are dealt by range of (key, at), so that a long history lies in many tasks, and cut into blocks. A
    block is a function from the state that it is entered in to the one that it is left in; these functions are composed
    over a key's blocks, and each block is walked from its own first state."""
    pairs = F.create_map(*[F.lit(x) for (s, a), t in LEGAL.items() for x in (f"{s}>{a}", t)])
    to = lambda state, action: F.try_element_at(pairs, F.concat(state, F.lit(">"), action))
    ranged = audit.select("key", "at", "action").repartitionByRange("key", "at", "action").sortWithinPartitions("key", "at", "action")
    ranged = settled(ranged.withColumn("__part", F.spark_partition_id()))
    place = F.row_number().over(W.partitionBy("key", "__part").orderBy("at", "action"))
    blocks = ranged.withColumn("__cut", F.floor((place - 1) / block)).groupBy("key", "__part", "__cut").agg(F.array_sort(F.collect_list(F.struct("at", "action"))).alias("l"))
    every = F.array(*[F.lit(s) for s in STATES])
    blocks = settled(blocks.withColumn("f", F.aggregate("l", every, lambda ends, x: F.transform(ends, lambda s: F.coalesce(to(s, x["action"]), s)))))

    def enter(acc: Column, x: Column) -> Column:
        after = F.element_at(x["f"], F.array_position(every, acc["state"]).cast("int"))
        return F.struct(after.alias("state"), F.concat(acc["entered"], F.array(F.struct(x["__part"], x["__cut"], acc["state"].alias("state")))).alias("entered"))

    listed = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("__part", "__cut", "f"))).alias("l"))
    first = F.struct(F.lit("draft").alias("state"), F.array().cast("array<struct<__part:int,__cut:bigint,state:string>>").alias("entered"))
    entered = listed.select("key", F.inline(F.aggregate("l", first, enter)["entered"]))

    def step(acc: Column, x: Column) -> Column:
        state = F.coalesce(F.try_element_at(acc, F.lit(-1))["after"], F.col("state"))
        new = to(state, x["action"])
        return F.concat(acc, F.array(F.struct(x["at"].alias("at"), x["action"].alias("action"), state.alias("before"), F.coalesce(new, state).alias("after"), new.isNotNull().alias("legal"))))

    at = audit.schema["at"].dataType.simpleString()
    kind = f"array<struct<at:{at},action:string,before:string,after:string,legal:boolean>>"
    met = blocks.alias("b").join(entered.alias("e"), [F.col(f"b.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("key", "__part", "__cut")])
    return met.select("b.key", "b.l", "e.state").select("key", F.inline(F.aggregate("l", F.array().cast(kind), step)))


def sod_violations(policies: DataFrame, admins: tuple[str, ...] = ()) -> DataFrame:
    """Approved versions whose approver wrote them and is no admin."""
    return policies.where((F.col("status") == "approved") & (F.col("approver") == F.col("author")) & ~F.col("approver").isin(*admins, ""))


def triage_proposals(policies: DataFrame) -> DataFrame:
    """Proposals with their decision: additions from a feed are approved by rule AA-1, the rest are drafts; manual ones
    are no proposals."""
    auto = (F.col("origin") == "feed") & (F.col("change_class") == "monotonic_add")
    return policies.where("origin <> 'manual'").withColumns({"decision": F.when(auto, "approved").otherwise("draft"), "rule": F.when(auto, "AA-1")})


def stale_drafts(policies: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    return policies.where((F.col("status") == "draft") & (F.col("created_at") < now - F.expr(f"interval {hours} hours")))


def document_hash(policies: DataFrame, document: str = "document") -> Column:
    """Hash of each policy's canonical document: of the JSON text in `document` (plan it within last_key_counts), or where
    there is none of the version's own columns."""
    if document not in policies.columns:
        kept = [c for c in sorted(policies.columns)]
        return text_hash(canonical_value(F.struct(*kept), T.StructType([policies.schema[c] for c in kept])))
    return text_hash(canonical_json_text(F.col(document)))


def document_hashes(policies: DataFrame, document: str = "document") -> DataFrame:
    """policies with document_hash and how many rows share their (policy_id, version)."""
    with last_key_counts(policies.sparkSession):
        hashed = policies.withColumn("document_hash", document_hash(policies, document))
    return hashed.withColumns({"n_versions": F.count(F.lit(1)).over(W.partitionBy("policy_id", "version"))})


def list_packs(packs: DataFrame) -> DataFrame:
    """(id, version, parent, labels, path) of profile packs (path, document as JSON text), in order of path; what is no
    document is left out."""
    doc = packs.select("path", F.from_json("document", "metadata struct<id:string,version:string,parent:string,labels:map<string,string>>").alias("d"), F.try_parse_json("document").alias("v"))
    m = doc.where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    none = F.create_map().cast("map<string,string>")
    return m.select(F.coalesce("d.metadata.id", F.lit("")).alias("id"), F.coalesce("d.metadata.version", F.lit("")).alias("version"), F.col("d.metadata.parent").alias("parent"), F.coalesce("d.metadata.labels", none).alias("labels"), "path").orderBy("path")


def resolve_chains(profiles: DataFrame) -> DataFrame:
    """(id, path from the root, cycle, missing) of profiles (id, parent), of any depth. Paths double: each round puts before
    a row's path the path of its next ancestor, so a chain of n profiles takes log2(n) rounds; rounds end when no row has
    an ancestor left. A path that meets itself ends there: cycle. `missing` names a parent that no profile has."""
    state = settled(profiles.select("id", F.array("id").alias("path"), (F.nullif("parent", F.lit("")) if profiles.schema["parent"].dataType.typeName() == "string" else F.col("parent")).alias("next"), F.lit(False).alias("cycle"), F.lit(None).cast(profiles.schema["id"].dataType).alias("missing")))
    while not state.where("next is not null").isEmpty():
        up = state.select(F.col("id").alias("__id"), F.col("path").alias("__path"), F.col("next").alias("__next"), F.col("cycle").alias("__cycle"), F.col("missing").alias("__missing"))
        # a path of repeated ids only meets itself anew: it is cut before the first ancestor that it has already
        joined = state.join(up, F.col("next") == F.col("__id"), "left")
        own = F.col("next").isNotNull() & F.col("__id").isNotNull()
        kept = F.expr("aggregate(reverse(coalesce(__path, array())), named_struct('p', path, 'c', false), (a, x) -> if(a.c, a, if(array_contains(a.p, x), named_struct('p', a.p, 'c', true), named_struct('p', concat(array(x), a.p), 'c', false))))")
        step = joined.withColumn("__k", F.when(own, kept))
        state = settled(step.select(
            "id", F.when(own, F.col("__k.p")).otherwise(F.col("path")).alias("path"), F.when(own & ~F.col("__k.c"), F.col("__next")).alias("next"),
            F.when(own, F.col("__k.c") | F.col("__cycle")).otherwise(F.col("cycle")).alias("cycle"),
            F.when(own, F.when(~F.col("__k.c"), F.col("__missing"))).otherwise(F.coalesce("missing", F.when(F.col("__id").isNull(), F.col("next")))).alias("missing"),
        ))
    return state.select("id", "path", "cycle", "missing")


def merge_layers(leaves: DataFrame) -> DataFrame:
    """(key, path, value, layer) of the last layer that sets each path; leaves: (key, path, value, layer)."""
    return leaves.groupBy("key", "path").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))


def override_trace(leaves: DataFrame) -> DataFrame:
    """Each change of a path's value from layer to layer: ADDED, REPLACED or REMOVED (value null)."""
    order = W.partitionBy("key", "path").orderBy("layer")
    rows = leaves.withColumns({"before": F.lag("value").over(order), "n": F.row_number().over(order)})
    rows = rows.where((F.col("n") == 1) | ~F.col("value").eqNullSafe(F.col("before")))
    return rows.select("key", "path", "layer", "before", "value", F.when(F.col("value").isNull(), "REMOVED").when(F.col("before").isNull(), "ADDED").otherwise("REPLACED").alias("change"))


def merge_guards(layers: DataFrame) -> DataFrame:
    """Guards merged by id, layer by layer. layers: (key, guard_id, layer, pos, remove, leaves), where leaves maps the paths
    that a layer sets in its guard to their JSON texts. A layer's leaves replace those of the layers before, path by path:
    one that sets a path replaces what stood there, above and below it. A guard keeps its place; one that a layer removes
    is gone, and when a later layer names it again it is a new guard at the end. Of a guard that one layer names twice the
    last counts. Returns (key, guard_id, place, layer, pos, leaves) with places from 1 in order."""
    last = layers.groupBy("key", "guard_id", "layer").agg(F.max_by(F.struct("pos", "remove", "leaves"), "pos").alias("g"), F.min("pos").alias("first"))
    gone = F.max(F.when(F.col("g.remove"), F.col("layer"))).over(W.partitionBy("key", "guard_id"))
    live = last.withColumn("gone", gone).where("gone is null or layer > gone")
    under = lambda a, b: (a == b) | F.startswith(a, F.concat(b, F.lit("."))) | F.startswith(b, F.concat(a, F.lit(".")))

    def over(acc: Column, new: Column) -> Column:
        kept = F.map_filter(acc, lambda k, _: ~F.exists(F.map_keys(new), lambda n: under(k, n)))
        return F.map_concat(kept, new)

    g = live.groupBy("key", "guard_id").agg(F.min(F.struct("layer", F.col("first").alias("pos"))).alias("at"), F.sort_array(F.collect_list(F.struct("layer", F.map_entries("g.leaves").alias("e")))).alias("l"))
    merged = F.aggregate(F.transform("l", lambda x: F.map_from_entries(x["e"])), F.create_map().cast("map<string,string>"), over)
    place = F.row_number().over(W.partitionBy("key").orderBy("at.layer", "at.pos", "guard_id"))
    return g.select("key", "guard_id", place.alias("place"), F.col("at.layer").alias("layer"), F.col("at.pos").alias("pos"), merged.alias("leaves"))


def compile_policies(policies: DataFrame, tenant: str) -> DataFrame:
    """Stamped copies: kind, tenant, no parent, a status."""
    return policies.withColumns({"kind": F.lit("Policy"), "tenant": F.lit(tenant), "parent": F.lit(None).cast("string"), "status": F.coalesce("status", F.lit("draft"))})


# Thresholds and actions by severity.
SEVERITY = {"low": (0, 0.85, None), "medium": (1, 0.75, None), "high": (2, 0.65, "block")}


def synthesize_guards(candidates: DataFrame) -> DataFrame:
    """Guards of candidates (key, pos, scenario, directions, severity, on_fail): one for each (scenario, directions) of a key,
    as severe as the severest; unmapped scenarios drop out. Ids count within (key, scenario). Where candidates have anchor,
    rule_text and notes, `provenance` lists those of a guard's candidates in order of pos: why it exists."""
    why = [c for c in ("anchor", "rule_text", "notes") if c in candidates.columns]
    rank = F.create_map(*[F.lit(x) for s, (r, _, _) in SEVERITY.items() for x in (s, r)])
    rows = candidates.where(F.col("scenario").isin(*SCENARIOS)).withColumns({"d": F.array_join(F.array_sort("directions"), "+"), "r": F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(1))})
    g = rows.groupBy("key", "scenario", "d").agg(F.max("r").alias("r"), F.max_by("on_fail", F.struct("r", F.negative("pos"))).alias("own"), F.count(F.lit(1)).alias("n_rules"), F.min("pos").alias("first"), *([F.array_sort(F.collect_list(F.struct("pos", F.struct(*why).alias("why")))).alias("l")] if why else []))
    n = F.row_number().over(W.partitionBy("key", "scenario").orderBy("first", "d"))
    threshold = F.element_at(F.array(*[F.lit(t) for _, t, _ in SEVERITY.values()]), F.col("r") + 1)
    name = F.concat(F.lit("g-synth-"), F.replace("scenario", F.lit("_"), F.lit("-")), F.lit("-"), F.lpad(n.cast("string"), 2, "0"))
    return g.select("key", name.alias("guard_id"), "scenario", F.col("d").alias("direction"), threshold.alias("threshold"), F.when(F.col("r") == 2, "block").otherwise(F.col("own")).alias("on_fail"), "n_rules", *([F.transform("l", lambda x: x["why"]).alias("provenance")] if why else []))


def triage(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with a known scenario, and those for people."""
    known = F.coalesce(F.col("scenario").isin(*SCENARIOS), F.lit(False))
    return candidates.where(known), candidates.where(~known)
