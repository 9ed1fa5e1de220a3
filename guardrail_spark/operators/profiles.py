"""Compilation of policy documents from layers: a baseline, the packs of a profile from its root on, the app's own policy.

layers: (key, layer, name, document): JSON objects as text, in order of the number `layer` within a key. Objects merge key by
key; anything else replaces what earlier layers have at its path, above it or below it. A list of objects at spec.guards is
no value but an object by guard id (step `[id]`): guards merge by id, keep their place, and go where a layer says
`__remove__`; one that a later layer names again is a new guard at the end. Of guards of one id in one layer the last
counts, and one that is removed before any layer has it is not there.

Spark reads each document once (a pack's before it meets the apps), groups the layers by key and spreads the keys; the few
documents of one key are then merged in their row. Layers that many keys share can come apart, as stacks (stack, layers): each
key then lies over the stack that it names, without a shuffle, and what a stack is in itself is found once, not for each key.
A text that is no JSON object is a layer that sets nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from json.encoder import encode_basestring as _quoted

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import last_key_counts
from ..sources.shared import meet, settled
from .policies import resolve_chains

GUARDS = ("spec", "guards")
REMOVED = "\x00removed"  # no JSON text begins so
BASELINE, APP = "baseline@1.0.0", "app-policy"
#: Strings and numbers of JSON text. Marked, both are strings, which begin with a colon or end with one, so that numbers keep
#: their digits where they are parsed; what is no JSON stays none.
_MARKED = r'(?s)"((?:[^"\\]++|\\.)*+)"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+-])'
_read = json.JSONDecoder().decode


class _Guards(dict):
    """Nodes of guards by `[id]`, in their order. Other objects are plain dicts, and what is no object its canonical text."""


def _number(text: str) -> str:
    """Canonical text of a JSON number (see canonical_double)."""
    if text.lstrip("-").isdigit():
        return "0" if text == "-0" else text
    v = float(text)
    if math.isinf(v):
        raise ValueError(text)
    return str(int(v)) if v.is_integer() and abs(v) <= 1e15 else repr(v)


def _text(v) -> str:
    """Canonical text of a marked value (see marked_documents)."""
    if isinstance(v, str):
        return _quoted(v[1:]) if v.startswith(":") else _number(v[:-1])
    if isinstance(v, dict):
        return "{" + ",".join([f"{_quoted(k[1:])}:{_text(x)}" for k, x in v.items()]) + "}"
    return "[" + ",".join([_text(x) for x in v]) + "]" if isinstance(v, list) else json.dumps(v)


def _node(v, left: tuple | None = GUARDS):
    """The node of a marked value, from which the steps `left` lead to the guards (none: none do); guards that a layer removes
    are REMOVED."""
    if isinstance(v, dict) and left != ():
        if left is None:
            return {k[1:]: _node(x, None) if isinstance(x, dict) else _text(x) for k, x in v.items()}
        return {k[1:]: _node(x, left[1:] if k[1:] == left[0] else None) if isinstance(x, (dict, list)) else _text(x) for k, x in v.items()}
    if left != () or not isinstance(v, list) or not all(isinstance(g, dict) for g in v):
        return _text(v)
    found = _Guards()
    for g in v:
        name, gone = g.get(":id"), g.get(":__remove__")
        name = f"[{(name[1:] if name.startswith(':') else _text(name)) if isinstance(name, str) else ''}]"
        found.pop(name, None)
        found[name] = REMOVED if gone not in (None, False, {}, []) and _text(gone) not in ("0", '""') else _node(g, None)
    return found


@lru_cache(256)
def _document(marked: str | None) -> dict | None:
    if not marked or not marked.startswith("{"):
        return None
    try:
        return _node(_read(marked))
    except ValueError:  # a number that isn't finite
        return None


@lru_cache(256)
def _stack(documents: str) -> dict | None:
    """The node of a stack's documents, which are given as one JSON text."""
    return _merged(json.loads(documents))[0]


def _kept(node):
    """A node without the guards that it removes."""
    return type(node)((k, _kept(x)) for k, x in node.items() if x != REMOVED) if isinstance(node, dict) else node


def _over(old: dict, new: dict, at: str | None, said: list) -> dict:
    """The node of object new over object old at the path `at`, which both stay as they are; said gets (path, change, before,
    value) of each departure."""
    out = type(old)(old)
    front = "" if at is None else at if isinstance(old, _Guards) else f"{at}."
    for k, v in new.items():
        was, plain = out.get(k), isinstance(v, str)
        if was is None:
            if v != REMOVED:
                said.append((front + k, "ADDED", None, v if plain else None))
                out[k] = v if plain else _kept(v)
        elif v == REMOVED:
            said.append((front + k, "REMOVED", None if isinstance(was, dict) else was, None))
            del out[k]
        elif plain or isinstance(was, str):
            if was != v:
                said.append((front + k, "REPLACED", was if isinstance(was, str) else None, v if plain else None))
                out[k] = v if plain else _kept(v)
        else:
            out[k] = _over(was, v, front + k, said)
    return out


def _merged(documents: list, stack: str | None = None) -> tuple[dict | None, list]:
    """The node of all documents of a key over its stack, and (number, departures) of each that meets earlier ones."""
    whole, steps = _stack(stack) if stack else None, []
    for i, marked in enumerate(documents):
        new = _document(marked)
        if new is not None and whole is None:
            whole = _kept(new)
        elif new is not None:
            said: list = []
            whole = _over(whole, new, None, said)
            steps.append((i, said))
    return whole, steps


def _written(node) -> str:
    """Canonical JSON text of a node."""
    if isinstance(node, _Guards):
        return "[" + ",".join([_written(g) for g in node.values()]) + "]"
    if isinstance(node, dict):
        return "{" + ",".join([f"{_quoted(k)}:{_written(node[k])}" for k in sorted(node)]) + "}"
    return node


def _stamped(node: dict, found: bool, tenant: str | None, profile: str | None) -> dict:
    """The node as a policy: kind, tenant and profile are the stamp's alone, and so is a status where there is none."""
    out, meta = {k: v for k, v in node.items() if k != "kind"}, node.get("metadata")
    # a metadata that is no object gives way to one
    meta = {k: v for k, v in meta.items() if k not in ("tenant", "profile", "parent")} if isinstance(meta, dict) else {}
    if found:
        out["kind"] = '"Policy"'
        meta = {"status": '"draft"', **meta, "tenant": json.dumps(tenant, ensure_ascii=False), "profile": _quoted(profile or "")}
    return {**out, "metadata": meta} if meta else {k: v for k, v in out.items() if k != "metadata"}


def marked_documents(rows: DataFrame) -> DataFrame:
    """rows with `marked`: their document as marked JSON with sorted keys, null where it is none."""
    with last_key_counts(rows.sparkSession):
        return rows.withColumn("marked", F.to_json(F.try_parse_json(F.regexp_replace("document", _MARKED, '"$2:$1"'))))


def _by_key(layers: DataFrame) -> DataFrame:
    """(key, layers): the layers of each key in order, as (layer, name, marked)."""
    rows = layers if "marked" in layers.columns else marked_documents(layers)
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("layer", "name", "marked"))).alias("layers"))


def _documents(layers: DataFrame, stacks: DataFrame | None) -> DataFrame:
    """(key, d, stack): the marked documents of each key in order, and those of the stack below as one text."""
    if stacks is None:
        return _by_key(layers).select("key", F.col("layers.marked").alias("d"), F.lit(None).cast("string").alias("stack"))
    texts = stacks.select("stack", F.to_json("layers.marked").alias("text"))
    return meet(layers, texts, ["stack"], _size(stacks)).select("key", F.array("marked").alias("d"), F.col("text").alias("stack"))


def _size(stacks: DataFrame) -> int:
    """The number of layers of all stacks, each stack counted as one more."""
    return stacks.agg(F.coalesce(F.sum(F.size("layers") + 1), F.lit(0))).first()[0]


def _each_key(rows: DataFrame, make: Callable[..., list[tuple]], out: list[T.StructField], kept: int = 1) -> DataFrame:
    """Columns of rows, of which the first ones are kept, with out: the tuples that make gives for the others of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields, names = [(f.name, to_arrow_type(f.dataType)) for f in out], rows.columns[:kept]

    def values(c) -> list:
        import pyarrow as pa

        return c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) else c.to_pylist()  # of texts the faster way

    def run(batches: Iterator) -> Iterator:
        import sys

        import pyarrow as pa

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # documents may be a thousand levels deep
        for b in batches:
            place, made = [], []
            for i, row in enumerate(zip(*map(values, b.columns[kept:]))):
                new = make(*row)
                place += [i] * len(new)
                made += new
            columns = [pa.array(v, t) for v, (_, t) in zip(zip(*made) if made else [()] * len(fields), fields)]
            at = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:kept]), *columns], [*names, *(n for n, _ in fields)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:kept], *out]))


def merge_documents(layers: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """(key, document): the layers of each key merged, as canonical JSON text. With stacks, layers are the rows beside them that
    profile_stacks gives."""

    def make(documents: list, stack: str | None) -> list[tuple]:
        whole, _ = _merged(documents, stack)
        return [(_written(whole),)] if whole else []

    return _each_key(_documents(layers, stacks), make, [T.StructField("document", T.StringType())])


def compile_documents(layers: DataFrame, stamps: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """(key, document) of the merged layers (see merge_documents) as policies: kind, the tenant and the profile of stamps (key,
    tenant, profile), no parent, and the status draft if there is none. Keys without a sound layer have none."""

    def make(documents: list, stack: str | None, found: bool | None, tenant: str | None, profile: str | None) -> list[tuple]:
        whole, _ = _merged(documents, stack)
        node = None if whole is None else _stamped(whole, bool(found), tenant, profile)
        return [(_written(node),)] if node else []

    rows = _documents(layers, stacks).join(stamps.select("key", F.lit(True).alias("found"), "tenant", "profile"), "key", "left")
    return _each_key(rows.select("key", "d", "stack", "found", "tenant", "profile"), make, [T.StructField("document", T.StringType())])


def document_trace(layers: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """(key, layer, name, path, change, before, value, replaced): where each layer departs from what the layers before it make
    up: ADDED for what is new at its highest path, REPLACED for another value (before, value: canonical JSON, null for
    objects), REMOVED for guards; replaced names the layer before, for the last two. With stacks (see merge_documents), the
    departures within a stack are found once and joined to its keys."""
    text = lambda *names: [T.StructField(c, T.StringType()) for c in names]
    if stacks is None:

        def make(numbers: list, names: list, documents: list) -> list[tuple]:
            _, steps = _merged(documents)
            return [(numbers[i], names[i], *d, None if d[1] == "ADDED" else names[i - 1]) for i, said in steps for d in said]

        rows = _by_key(layers).select("key", *[F.col(f"layers.{c}").alias(c) for c in ("layer", "name", "marked")])
        return _each_key(rows, make, [layers.schema["layer"], *text("name", "path", "change", "before", "value", "replaced")])

    def own(marked: str | None, stack: str) -> list[tuple]:
        _, steps = _merged([marked], stack)
        return steps[0][1] if steps else []

    within = document_trace(stacks.select(F.col("stack").alias("key"), F.inline("layers")))
    told = within.groupBy(F.col("key").alias("stack")).agg(F.collect_list(F.struct(*within.columns[1:])).alias("told"))
    below, n = F.try_element_at("layers", F.lit(-1)), _size(stacks)
    texts = stacks.select("stack", (F.coalesce(below["layer"], F.lit(0)) + 1).alias("layer"), below["name"].alias("below"), F.to_json("layers.marked").alias("text"))
    rows = meet(layers, texts, ["stack"], n).select("key", "layer", "below", "marked", "text")
    new = _each_key(rows, own, text("path", "change", "before", "value"), kept=3)
    new = new.select("key", "layer", F.lit(APP).alias("name"), "path", "change", "before", "value", F.when(F.col("change") != "ADDED", F.col("below")).alias("replaced"))
    old = meet(layers.select("key", "stack"), told, ["stack"], n).select("key", F.inline("told"))
    return old.unionByName(new)


def _chains(packs: DataFrame, baseline: str) -> tuple[DataFrame, DataFrame]:
    """(name, document) of packs by id@version, and (profile, path) of those without a fault: packs from the root on, the
    baseline not among them."""
    known = settled(packs.select(F.concat_ws("@", "id", "version").alias("name"), "document", F.trim(F.coalesce(F.get_json_object("document", "$.metadata.parent"), F.lit(""))).alias("parent")))
    chains = resolve_chains(known.select(F.col("name").alias("id"), "parent"))
    return known, chains.where("not cycle and missing is null").select(F.col("id").alias("profile"), F.filter("path", lambda p: p != baseline).alias("path"))


def profile_layers(apps: DataFrame, packs: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """(key, layer, name, document, marked) of apps (key, profile, document): the baseline, the packs of the profile from its root on
    (the baseline not again), the app's document if it has one. packs: (id, version, document). Apps whose profile or one of
    its ancestors is unknown, or whose profile meets itself, have no layers."""
    known, sound = _chains(packs, baseline)
    wanted = apps.select("key", "document", F.coalesce("profile", F.lit("")).alias("profile"))
    plain = wanted.where(F.col("profile").isin("", baseline)).withColumn("path", F.array().cast("array<string>"))
    met = plain.unionByName(wanted.where(~F.col("profile").isin("", baseline)).join(sound, "profile").select(*plain.columns))
    read = marked_documents(known.select("name", "document"))  # once for each pack, not for each app
    listed = meet(met.select("key", F.posexplode(F.concat(F.array(F.lit(baseline)), "path")).alias("layer", "name")), read, ["name"], known.count())
    own = met.where("document is not null").select("key", (F.size("path") + 1).alias("layer"), F.lit(APP).alias("name"), "document")
    return listed.select("key", "layer", "name", "document", "marked").unionByName(marked_documents(own.repartition("key")))


def profile_stacks(apps: DataFrame, packs: DataFrame, baseline: str = BASELINE) -> tuple[DataFrame, DataFrame]:
    """The layers of profile_layers apart: (key, stack, marked) of the apps, whose keys are unique, and the stacks (stack, layers)
    below their documents, one for each profile, with layers as (layer, name, marked) in order. An app without a document
    has a null, one without layers a stack that there isn't."""
    known, sound = _chains(packs, baseline)
    plain = known.sparkSession.range(1).select(F.lit("").alias("profile"), F.array().cast("array<string>").alias("path"))
    names = plain.unionByName(sound.where(~F.col("profile").isin("", baseline))).select(F.col("profile").alias("stack"), F.posexplode(F.concat(F.array(F.lit(baseline)), "path")).alias("layer", "name"))
    met = meet(names, marked_documents(known.select("name", "document")).select("name", "marked", F.lit(True).alias("found")), ["name"], known.count(), "left")
    stacks = met.groupBy("stack").agg(F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("layer", "name", "marked")))).alias("layers"))
    profile = F.coalesce("profile", F.lit(""))
    rows = apps.select("key", F.when(profile == baseline, "").otherwise(profile).alias("stack"), "document")
    return marked_documents(rows).drop("document"), settled(stacks)
