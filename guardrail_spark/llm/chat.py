"""Chat formatting with schema fingerprints.

Records of many layouts become canonical turns. A record's layout is known by its fingerprint: the hash of its nested
field paths, sorted. MAPPINGS declares for each known set of paths how turns are read: which fields hold them and how
roles are named. Fingerprints come from the schema of a table (`schema_fingerprint`) or, for JSON records, of each row
(`record_fingerprint`, by Spark's variant type); a record with further fields is known by its paths that mappings name.

The template writes a turn as <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>. In roles and texts a backslash is doubled and
`<|` becomes `<\\|`, so control strings in them are plain text; `unescaped` undoes that exactly. The loss mask is a list
of spans, in code points of the formatted text, over what assistants say.

Defined cases: null role or text is empty; turns are sorted by turn number (nulls first), then role and text, so ties have
one order; repeated rows are repeated turns; the null conversation is a conversation; records of an unknown layout raise
(tables) or give a row with null turns (JSON records; `unknown_records` lists them whole); other columns make another layout and are named by the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNT = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """How turns are read from records with these field paths. `turns`: SQL for array<struct<role, text>>; or, for one
    row a turn, the SQL of `role` and `text` with `key` and `order`."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    key: str = ""
    order: str = ""


_ROLE = "case {0} when 'human' then 'user' when 'prompter' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' when 'model' then 'assistant' else {0} end"


def _pair(user: str, assistant: str, system: str = "") -> str:
    turns = [("system", system)] * bool(system) + [("user", user), ("assistant", assistant)]
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', {t})" for r, t in turns) + ")"


# Layouts in use for prompts, instructions and messages.
MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), role="role", text="text", key="conv_id", order="turn"),
    Mapping("message rows", ("content", "conversation_id", "index", "role"), role="role", text="content", key="conversation_id", order="index"),
    Mapping("messages", ("messages", "messages.content", "messages.role"), turns="transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Mapping("named messages", ("messages", "messages.content", "messages.name", "messages.role"), turns="transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Mapping("conversations", ("conversations", "conversations.from", "conversations.value"), turns=f"transform(conversations, m -> named_struct('role', {_ROLE.format('m.from')}, 'text', m.value))"),
    Mapping("prompt and response", ("prompt", "response"), turns=_pair("prompt", "response")),
    Mapping("prompt and completion", ("completion", "prompt"), turns=_pair("prompt", "completion")),
    Mapping("question and answer", ("answer", "question"), turns=_pair("question", "answer")),
    Mapping("instruction", ("instruction", "output"), turns=_pair("instruction", "output")),
    Mapping("instruction with input", ("input", "instruction", "output"), turns=_pair("case when coalesce(input, '') = '' then instruction else concat(instruction, '\\n\\n', input) end", "output")),
    Mapping("system, prompt and response", ("prompt", "response", "system"), turns=_pair("prompt", "response", "system")),
)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


REGISTRY = {fingerprint(m.paths): m for m in MAPPINGS}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields; array elements and map values count as their column."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix)
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *field_paths(f.dataType, path)]
        return out
    return []


def schema_fingerprint(schema: T.StructType, ignore: tuple[str, ...] = ()) -> str:
    return fingerprint([p for p in field_paths(schema) if p.split(".")[0] not in ignore])


def record_fingerprint(json: Column) -> Column:
    """Of each JSON record, as schema_fingerprint gives it for a table of such records."""
    shape = F.schema_of_variant(F.try_parse_json(json))
    # OBJECT<a: ARRAY<OBJECT<b: STRING>>> is spelt as field names with brackets; nested names get their parents'
    inner = F.regexp_replace(F.regexp_extract(shape, r"(?s)^OBJECT<(.*)>$", 1), r": ARRAY<OBJECT<([^<>]*)>>", ": OBJECT<$1>")
    parts = F.regexp_extract_all(inner, F.lit(r"(\w+): (?:OBJECT<[^<>]*>|[^,<>]*(?:<[^<>]*>)?)"), F.lit(0))
    paths = F.flatten(
        F.transform(
            parts,
            lambda p: F.concat(
                F.array(F.regexp_extract(p, r"^(\w+):", 1)),
                F.transform(
                    F.when(F.contains(p, F.lit(": OBJECT<")), F.regexp_extract_all(F.regexp_extract(p, r"OBJECT<(.*)>", 1), F.lit(r"(\w+):"), F.lit(1))).otherwise(F.array().cast("array<string>")),
                    lambda c: F.concat(F.regexp_extract(p, r"^(\w+):", 1), F.lit("."), c),
                ),
            ),
        )
    )
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def _has(name: str) -> Callable[[Column], Column]:
    return lambda x: F.try_variant_get(x, f"$.{name}", "variant").isNotNull()


def known_fingerprint(json: Column) -> Column:
    """The fingerprint of those paths of a JSON record that any mapping of records names: further fields, at any depth, don't
    count."""
    children: dict[str, set[str]] = {}
    for m in MAPPINGS:
        for top, _, child in (p.partition(".") for p in m.paths if m.turns):
            children.setdefault(top, set()).update({child} - {""})
    v = F.try_parse_json(json)
    found = []
    for top, below in children.items():
        found.append(F.when(F.try_variant_get(v, f"$.{top}", "variant").isNotNull(), top))
        each = F.try_variant_get(v, f"$.{top}", "array<variant>")
        found += [F.when(F.exists(each, _has(c)), f"{top}.{c}") for c in sorted(below)]
    return F.sha2(F.array_join(F.array_sort(F.array_compact(F.array(*found))), "\n"), 256)


def record_layout(json: Column) -> Column:
    """The fingerprint that chooses a record's mapping: its own where a mapping has it, else that of its known paths."""
    own = record_fingerprint(json)
    return F.when(own.isin(*[key for key, m in REGISTRY.items() if m.turns]), own).otherwise(known_fingerprint(json))


def turns_of_table(df: DataFrame, conversation: str | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema's fingerprint is known. `conversation` names the column that
    tells records apart, `ignore` further ones that aren't part of the layout."""
    aside = ignore + ((conversation,) if conversation else ())
    mapping = REGISTRY.get(schema_fingerprint(df.schema, aside))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(field_paths(df.schema))}")
    if mapping.key:
        return df.select(F.expr(mapping.key).alias("conv_id"), F.expr(mapping.order).cast("long").alias("turn"), F.expr(mapping.role).alias("role"), F.expr(mapping.text).alias("text"))
    rows = df.select(F.col(f"`{conversation}`").alias("conv_id"), F.posexplode(F.expr(mapping.turns)).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def turns_of_records(df: DataFrame, json: str, conversation: str) -> DataFrame:
    """The same of JSON records of any known layouts, told apart row by row; fields that no mapping names don't count where
    the rest is a known layout. Unknown ones give one row without a turn."""
    marked = df.select(F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{json}`").alias("json"), record_layout(F.col(f"`{json}`")).alias("layout"))
    cases = F.lit(None).cast("array<struct<role:string,text:string>>")
    for key, m in REGISTRY.items():
        if m.turns:
            tree: dict[str, list[str]] = {}
            for p in m.paths:
                tree.setdefault(p.split(".")[0], []).extend(p.split(".")[1:])
            ddl = ", ".join(f"`{k}` " + (f"array<struct<{', '.join(f'`{c}`: string' for c in v)}>>" if v else "string") for k, v in tree.items())
            record = F.from_json("json", ddl)
            names = sorted(tree)
            turns = f"get(transform(array(r), x -> {_within(m.turns, names)}), 0)"
            marked = marked.withColumn("r", record)
            cases = F.when(F.col("layout") == key, F.expr(turns)).otherwise(cases)
            marked = marked.withColumn("turns", cases).drop("r")
            cases = F.col("turns")
    rows = marked.select("conv_id", F.posexplode_outer("turns").alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def unknown_records(df: DataFrame, json: str, conversation: str) -> DataFrame:
    """(conv_id, json, layout): the JSON records that no mapping reads, broken ones and nulls included, with their whole
    text and their fingerprint, so that none is lost unseen and a mapping can be added for it."""
    rows = df.select(F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{json}`").alias("json")).withColumns({"layout": record_fingerprint(F.col("json")), "__chosen": record_layout(F.col("json"))})
    known = [key for key, m in REGISTRY.items() if m.turns]
    return rows.where(~F.coalesce(F.col("__chosen").isin(*known), F.lit(False))).drop("__chosen")


def _within(sql: str, names: list[str]) -> str:
    import re

    return re.sub(r"(?<![\w.'])(" + "|".join(names) + r")(?![\w'])", r"x.`\1`", sql)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (spans start, end) of each conversation of (conv_id, turn, role, text)."""
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    pieces = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit(START), role, F.lit(SEP)).alias("head"), text.alias("body"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select("conv_id", F.row_number().over(order).alias("i"), "role", (before + F.length("head")).alias("start"), F.length("body").alias("n"), F.concat("head", "body", F.lit(END)).alias("piece"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "piece", "role", "start", "n"))).alias("t"))
    mask = F.expr("transform(filter(t, x -> x.role in (" + ", ".join(f"'{r}'" for r in LEARNT) + ")), x -> named_struct('start', x.start, 'end', x.start + x.n))")
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and the texts under the loss mask, unescaped, of what format_turns gives."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p != "")
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(p, SEP, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )
    under = F.expr("transform(loss, s -> substring(formatted, int(s.start) + 1, int(s.end - s.start)))")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.transform(under, unescaped).alias("learnt"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text: numbers and digests of its turns and of what its loss mask covers."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
