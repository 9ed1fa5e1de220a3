"""License scans by diagonal voting.

The hashes of all rolling GRAM-word grams of the texts are joined to their positions in license texts, and the words of
each hit are compared. A hit at word i of a text and word j of a template votes for the diagonal i - j. Votes are counted
for each diagonal; neighbouring diagonals that are at most DRIFT apart merge, since inserted or missing words shift the
rest, to bands of at most half a template's length. A merged band is a span if the template words that its hits cover,
now known to stand in the text, are COVER of the template or more and it isn't longer than the template by more than half.

The templates are a fixed list, so their table is small enough to broadcast. Hits alone go on: they are written, so that a
row's key stays what it was when an executor is lost, and shuffled by it.

Defined cases: null or empty text: no words, no labels, score 0; equal rows or ids each get their own row; texts shorter
than a gram have base places only; spans of several templates may overlap and all count; spans are ordered by start, end
and label; long texts are scanned whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled
from .license_texts import TEXTS
from .urls import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, DRIFT, COVER = 3, 4, 0.6

# The phrases of the base scan with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = TEXTS


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_grams(spark) -> DataFrame:
    """(hash, said, template, at, size, label): every gram's place in its template, with its words."""
    values = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    rows = spark.sql(f"SELECT template, label, split(text, ' ') AS words FROM VALUES {values} AS t(template, label, text)")
    rows = rows.select("template", "label", F.size("words").alias("size"), "words", F.explode(F.expr(f"sequence(0, size(words) - {GRAM})")).alias("at"))
    return rows.select(F.expr(_gram("words", "at")).alias("said"), "template", "at", "size", "label").select(F.xxhash64("said").alias("hash"), "*")


def _gram(words: str, at: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"{words}[{at} + {k}]" for k in range(GRAM)) + ")"


def phrase_places(words: str, phrase: str) -> Column:
    """Starts of a phrase's words among the words."""
    parts = phrase.split()
    tests = " and ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(parts))
    return F.expr(f"filter(sequence(0, size({words})), i -> coalesce({tests}, false))")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, base places and labels, all labels, score and spans of every row."""
    grams = F.broadcast(template_grams(docs.sparkSession))  # GRAM-word grams of the fixed list above
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(f"`{text}`")).alias("w"))
    # the phrases end in one word, so most texts are done after one look
    places = [F.when(F.array_contains("w", "license"), phrase_places("w", p)).otherwise(F.array().cast("array<int>")).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)]
    grams_of = F.expr(f"transform(sequence(0, size(w) - {GRAM}), i -> {_gram('w', 'i')})")
    based = words.select("id", "row", F.size("w").cast("long").alias("n_words"), *places, F.when(F.size("w") >= GRAM, grams_of).otherwise(F.array().cast("array<string>")).alias("g"))
    head = F.struct("id", "n_words", *[f"p{i}" for i in range(len(PHRASES))])
    # place -1 carries what is known of the row; the rest are its grams
    rolled = based.select("row", head.alias("head"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "g")).alias("i", "gram"))
    rolled = rolled.select("row", F.when(F.col("i") == 0, F.col("head")).alias("head"), (F.col("i") - 1).alias("i"), F.when(F.col("i") > 0, F.xxhash64("gram")).alias("hash"), "gram")
    hits = rolled.join(grams, "hash", "left").where("head is not null or gram = said")
    hits = settled(hits.select("row", "head", "i", "template", "at", "size", "label"))
    votes = hits.groupBy("row", "template", (F.col("i") - F.col("at")).alias("diagonal")).agg(
        F.first("head", ignorenulls=True).alias("head"), F.first("size").alias("size"), F.first("label").alias("label"),
        F.collect_set("at").alias("ats"), F.min("i").alias("low"), F.max("i").alias("high"),
    )
    near = W.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > DRIFT, F.lit(True)).cast("int")
    chained = votes.withColumn("new", new).withColumn("chain", F.sum("new").over(near))
    first = F.min("diagonal").over(W.partitionBy("row", "template", "chain"))
    banded = chained.withColumn("band", F.floor((F.col("diagonal") - first) * 2 / F.col("size")))
    bands = banded.groupBy("row", "template", "chain", "band").agg(
        F.first("head").alias("head"), F.first("size").alias("size"), F.first("label").alias("label"),
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.array(*[a + k for k in range(GRAM)])))))
    bands = bands.withColumns({"cover": covered / F.col("size"), "long": F.col("high") + GRAM - F.col("low")})
    good = F.col("template").isNotNull() & (F.col("cover") >= COVER) & (F.col("long") <= 1.5 * F.col("size"))
    span = F.struct(F.col("low").alias("start"), (F.col("high") + GRAM).alias("end"), "label", "cover")
    rows = bands.groupBy("row").agg(F.first("head", ignorenulls=True).alias("head"), F.array_sort(F.collect_list(F.when(good, span))).alias("spans"))
    every = F.array_sort(F.concat(*[F.col(f"head.p{i}") for i in range(len(PHRASES))]))
    base = F.array_compact(F.array(*[F.when(F.size(f"head.p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    n_base = F.size(every)
    return rows.select(
        F.col("head.id").alias(id_col), F.col("head.n_words").alias("n_words"), n_base.cast("long").alias("n_base"),
        F.get(every, F.lit(0)).cast("long").alias("first_word"), F.get(every, n_base - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)))).alias("score"),
        "spans",
    )
