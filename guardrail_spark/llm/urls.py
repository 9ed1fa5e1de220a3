"""URL filters by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. Hosts are written with
their labels reversed and a slash at the end, so `org.example//es/` is the canonical key of example.org/es/. A url stands
for one key for each of its host's endings, as deep as rules go. A rule's key is a prefix of just the keys in the
interval from it to its last extension; such intervals nest or are apart. Rules and url keys are sorted together and
swept once: each rule brings the stack of the rules that are open where it starts (its prefixes), the last rule before a
url key brings the stack to it, and the rules that the key has left are popped.

The sweep runs in lanes. Rows are dealt to lanes by number, whatever their host, so a host with a third of all urls
fills all lanes alike; every lane has all rules, and there are no more lanes than keep these copies fewer than the urls.

Defined cases: null url or none with `://`: host and path are empty; repeated rows each get a row; of rules with one
key `block` wins; the longest fitting rule wins, of equally long ones the one with the longer host; no rules: the
default verdict; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 8  # for each shuffle partition


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(host: Column, depth: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.slice(F.reverse(F.split(host, r"\.")), 1, depth), "."), F.lit("/"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule of (host, path, verdict) with the rules open at its start, itself last."""
    host = F.translate("host", UPPER, LOWER)
    keyed = rules.select(_key(host, F.size(F.split(host, r"\.")), F.col("path")).alias("key"), F.struct(F.length(F.concat(host, "path")).alias("size"), F.length(host).alias("host_size"), F.concat(host, "path").alias("rule"), "verdict").alias("says"))
    keyed = keyed.groupBy("key").agg(F.max_by("says", "says.verdict").alias("says"))
    prefixes = keyed.select("key", F.explode(F.expr("transform(sequence(1, length(key)), n -> substring(key, 1, n))")).alias("prefix"))
    open_ = prefixes.join(keyed.select(F.col("key").alias("prefix"), "says"), "prefix")
    stack = F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), F.col("prefix").alias("key"), "says")))
    return open_.groupBy("key").agg(stack.alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, the longest fitting rule (or null) and the verdict (default without a rule) of every row."""
    stacks = rule_stacks(rules)
    many, deep = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("host", r"\.")))).first()
    lanes = max(1, min(LANES * shuffle_partitions(pages.sparkSession), pages.count() // max(1, many)))
    host, path = host_and_path(F.col(f"`{url}`"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)).cast("int").alias("lane"))
    depth = F.least(F.size(F.split("host", r"\.")), F.lit(deep or 1))
    points = urls.select("*", F.explode(F.sequence(F.lit(1), depth)).alias("depth"))
    points = points.select("lane", _key(F.col("host"), F.col("depth"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", "depth", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "key", F.lit(0).alias("kind"), F.lit(None).cast(pages.schema[id_col].dataType).alias("id"), F.lit("").alias("host"), F.lit("").alias("path"), F.lit(0).alias("depth"), "stack")
    sweep = W.partitionBy("lane").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = points.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.expr("filter(stack, r -> startswith(key, r.key))")
    best = F.max(F.get(fits, F.size(fits) - 1)["says"]).alias("best")
    found = swept.groupBy("id", "host", "path").agg(best, F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("n"))
    found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
