"""MinHash near-dedup with an LSH forest.

A text's set holds its distinct shingles of words (fewer words than one shingle: the whole sequence). Rows with equal
sets form a class, of which one goes on. Each class has TREES signatures of DEPTH min-hashes: its places in TREES sorted
orders.

Forest. In each order the classes that share a prefix of MIN_DEPTH hashes form a region. A region of more than REGION
classes is cut by ever longer prefixes until its parts fit: the depth adapts to the region. A task walks a part in sorted
order by the common prefixes of neighbours, longest first: where two runs meet at a prefix, their classes are compared by
signature. Those that agree often enough for the threshold (within SLACK standard errors) are joined to clusters.

Confirmation. A cluster's texts meet, and links are confirmed on the full sets: in a cluster of up to PIECE classes every
pair whose signatures allow the threshold, unless links already join it. Larger clusters meet in pieces that share one
class, the leader.

Exact rest. What the cutting of dense regions and large clusters may have parted is searched by prefix filter: among the
classes of these regions and clusters, shingles are ordered by rarity (counts of BUCKETS buckets, then themselves), and two
sets that reach the threshold share one of the first few of each; only these leave a set's task. Classes with different
labels (components of the links so far) meet under these shingles, block by block where there are many; pairs that sizes,
positions and signatures allow are confirmed on the full sets. ROUNDS rounds take few pairs, those that would join the labels,
so that large groups of near copies don't list all of theirs; the last takes every pair whose labels still differ.

Defined cases: null text or no words: an empty set, linked with nothing; equal sets are linked (also of rows with one id
or none); a component without any id has the id null and its rows are kept; other columns are ignored; an empty table
gives an empty table. Rows are numbered in a written table, so no two share a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, settled, shuffle_partitions
from .components import components
from .substring import Rolling

TREES, DEPTH, MIN_DEPTH, SLACK = 16, 8, 3, 5.0
REGION, PIECE = 8192, 1024  # classes that meet in a task by their signatures (2 MB), or with their texts
HASHES = TREES * DEPTH
_ROLLING = Rolling()
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint64).astype(np.uint32)
_BLOCK = 512
BUCKETS = 1 << 18  # counters that order shingles by rarity
ROUNDS = 2  # of few links before the search for all
ASKS = "array<struct<asks: boolean, __i: bigint, __j: bigint>>"


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words."""
    words = data.lower().split()  # of bytes: A-Z alone are lowered
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    short = len(words) if len(words) < size else 0
    return np.unique(_ROLLING.runs(h, short or size) ^ np.uint64(short))


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES min-hashes of a set, the upper 16 bits of each."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), _BLOCK):
        np.minimum(out, ((low[None, i : i + _BLOCK] ^ _B) * _A).min(1), out=out)
    return (out >> np.uint32(16)).astype(np.uint16)


def least_agreement(threshold: float) -> float:
    """Signatures of sets at the threshold agree less often only by chance of SLACK standard errors."""
    return threshold - SLACK * (threshold * (1 - threshold) / HASHES) ** 0.5


def described(docs: DataFrame, size: int, id_col: str, text: str, keep: list[str]) -> DataFrame:
    """(k, id, row, text, n_shingles, s1, s2, sig) of every row, written: k numbers rows; row has the columns `keep`; s1
    and s2 tell sets apart."""

    def start() -> Callable[[bytes], tuple]:
        def one(data: bytes) -> tuple:
            s = shingle_set(data, size)
            if not len(s):
                return 0, 0, 0, b""
            mixed = (s ^ s >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
            return len(s), int(s.sum(dtype=np.uint64).astype(np.int64)), int(mixed.sum(dtype=np.uint64).astype(np.int64)), signature(s).tobytes()

        return one

    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    rows = docs.select(F.monotonically_increasing_id().alias("k"), F.col(f"`{id_col}`").alias("id"), row.alias("row"), F.col(f"`{text}`").alias("text"))
    return settled(per_text(rows, ["k", "id", "row", "text"], [("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())], start))


def _batches(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Small arrays (a, b) as batches of about 100,000 rows."""
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*held)], ["a", "b"])
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*held)], ["a", "b"])


def _spots(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """The columns `names` of the rows of each spot; rows come sorted by spot."""
    spot, rows = None, []
    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("spot", *names))):
            if at != spot:
                if rows:
                    yield list(zip(*rows))
                spot, rows = at, []
            rows.append(row)
    if rows:
        yield list(zip(*rows))


def _sigs(sigs: tuple[bytes, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), HASHES)


def _join_where(label: np.ndarray, i: int, others: np.ndarray, similar: Callable[[int], bool]) -> None:
    """Gives row i and those of `others` that are similar to it one label; rows that have it already need no look."""
    others = others[label[others] != label[i]]
    while len(others):
        j = int(others[0])
        if similar(j):
            label[label == label[j]] = label[i]
        others = others[1:][label[others[1:]] != label[i]]


def _stars(keys: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least key of each label to its other keys."""
    _, label = np.unique(label, return_inverse=True)
    least = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, keys)
    rest = least[label] != keys
    return least[label][rest], keys[rest]


def _walk(least: float) -> Callable:
    """Links (a, b) that join the rows (spot, k, key, sig) of each spot as far as their signatures do. Rows of a spot come
    in the order of their keys; runs with the longest common prefix come first, and shorter ones only compare what the
    longer have not."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ks, keys, sigs in _spots(batches, "k", "key", "sig"):
            n = len(ks)
            if n < 2:
                continue
            sig, label = _sigs(sigs), np.arange(n)
            if n == 2:
                if np.count_nonzero(sig[0] == sig[1]) >= least * HASHES:
                    yield np.array([min(ks)], np.int64), np.array([max(ks)], np.int64)
                continue
            key = np.frombuffer(b"".join(keys), np.uint16).reshape(n, DEPTH)
            common = np.logical_and.accumulate(key[1:] == key[:-1], axis=1).sum(1)
            for depth in np.unique(common)[::-1].tolist():
                cut = np.flatnonzero(common < depth) + 1
                for start, end in zip([0, *cut.tolist()], [*cut.tolist(), n]):
                    meets = common[start : end - 1] == depth
                    if not meets.any():
                        continue
                    part = np.concatenate([[0], np.cumsum(meets)])
                    own = label[start:end]
                    for i in range(end - start - 1):
                        rest = start + np.flatnonzero((part > part[i]) & (own != own[i]))
                        if len(rest):
                            rest = rest[np.count_nonzero(sig[rest] == sig[start + i], axis=1) >= least * HASHES]
                            _join_where(label, start + i, rest, lambda j: True)
            yield _stars(np.array(ks, np.int64), label)

    return lambda batches: _batches(found(batches))


def _blocks(rows: DataFrame, group: str, label: str, known: DataFrame | None = None) -> DataFrame:
    """rows (group, k, label, ...) with asks and spot, for all pairs of a group's rows that differ in their labels. The
    rows outside the group's commonest label ask; a block of those and a piece of all rows meet in one spot. The columns of
    known (k, ...) are added to the rows of groups with several labels, before these are copied to their spots."""
    count = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("__n"))
    head = count.groupBy(group).agg(F.sum("__n").alias("__m"), F.max_by(label, F.struct("__n", label)).alias("__head"), F.max("__n").alias("__most")).where("__m > __most")
    deal = lambda n: F.ceil(n / PIECE).cast("long")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda asks, i, j: F.struct(F.lit(asks).alias("asks"), i.alias("__i"), j.alias("__j"))
    met = rows.join(head.hint("merge"), group)
    met = met if known is None else met.join(known, "k")
    met = met.withColumns({"__pieces": deal(F.col("__m")), "__asking": deal(F.col("__m") - F.col("__most"))})
    own_i, own_j = F.pmod(F.xxhash64("k", F.lit("asks")), F.col("__asking")), F.pmod(F.xxhash64("k"), F.col("__pieces"))
    home = F.transform(every(F.col("__asking")), lambda i: place(False, i, own_j))
    asking = F.when(F.col(label) != F.col("__head"), F.transform(every(F.col("__pieces")), lambda j: place(True, own_i, j)))
    met = met.select("*", F.inline(F.concat(home, F.coalesce(asking, F.array().cast(ASKS)))))
    return met.withColumn("spot", F.xxhash64(group, "__i", "__j")).drop("__m", "__head", "__most", "__pieces", "__asking", "__i", "__j")


def candidate_links(reps: DataFrame, least: float) -> tuple[DataFrame, DataFrame | None]:
    """(a, b): links that join the classes (k, sig) which share a part of a region and agree at least so often; and the
    classes (region, k) of regions that were cut, if any."""
    n = shuffle_partitions(reps.sparkSession)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    todo = reps.select("k", "sig", tree).select("k", "tree", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key"))
    parts, dense = [], None
    for depth in range(MIN_DEPTH, DEPTH + 1):
        rows = todo.withColumn("region", F.xxhash64("tree", F.lit(depth), F.expr(f"substring(key, 1, {2 * depth})")))
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        last = depth == DEPTH
        rows = settled(rows.join(sizes, "region").select("region", "m", "k", "tree", "key"))
        deal = F.when(F.col("m") > REGION, F.pmod(F.xxhash64("k", "tree"), F.ceil(F.col("m") / REGION).cast("long"))).otherwise(0)
        parts.append((rows if last else rows.where(F.col("m") <= REGION)).select("k", "key", F.xxhash64("region", deal).alias("spot")))
        if last:
            break
        rest = rows.where(F.col("m") > REGION).select("region", "k", "tree", "key")
        if rest.isEmpty():
            break
        rest = settled(rest)
        todo, dense = rest.drop("region"), rest.select("region", "k") if dense is None else dense
    spots = reduce(DataFrame.unionByName, parts).join(reps, "k").select("spot", "k", "key", "sig")
    links = spots.repartition(n, "spot").sortWithinPartitions("spot", "key", "k").mapInArrow(_walk(least), "a long, b long")
    return links, dense


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(size: int, percent: int, least: float) -> Callable:
    """Links (a, b) that join the rows (spot, k, sig, text) of each spot as far as their sets do."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ks, sigs, texts in _spots(batches, "k", "sig", "text"):
            sig, label, sets = _sigs(sigs), np.arange(len(ks)), []
            for i, text in enumerate(texts):
                sets.append(shingle_set(text, size))
                agree = np.count_nonzero(sig[:i] == sig[i], axis=1)
                near = np.flatnonzero(agree >= least * HASHES)
                _join_where(label, i, near[np.argsort(-agree[near], kind="stable")], lambda j: _similar(sets[i], sets[j], percent))
            yield _stars(np.array(ks, np.int64), label)

    return lambda batches: _batches(found(batches))


def confirmed_links(reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between the classes (k, sig) that the full sets of texts (k, text) confirm; they join all that any
    links join."""
    spark = reps.sparkSession
    n, least = shuffle_partitions(spark), least_agreement(percent / 100)
    links, dense = candidate_links(reps, least)
    clusters = components(links)
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    dealt = clusters.join(sizes, "component").select(F.col("node").alias("k"), F.col("component").alias("cluster"), F.ceil(F.col("m") / PIECE).cast("long").alias("pieces"))
    met = settled(dealt.join(reps, "k"))
    binary = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    own, leads = F.pmod(F.xxhash64("k"), F.col("pieces")), F.col("k") == F.col("cluster")  # a cluster is named by its least class
    piece = F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).otherwise(F.array(own)))
    # one plan at every size: a table of clusters isn't bounded, so it is never broadcast
    spots = texts.select("k", binary).join(met.hint("merge"), "k").withColumn("piece", piece).select(F.xxhash64("cluster", "piece").alias("spot"), "k", "sig", "text")
    links = settled(spots.repartition(n, "spot").sortWithinPartitions("spot", "k").mapInArrow(_confirm(size, percent, least), "a long, b long"))
    parted = met.where("pieces > 1").select(F.col("cluster").alias("region"), "k")
    parted = parted if dense is None else parted.unionByName(dense)
    if parted.isEmpty():
        return links
    still = lambda more: opened(parted, links.unionByName(more))
    return links.unionByName(parted_links(reps, texts, opened(parted, links), size, percent, still))


def opened(parted: DataFrame, links: DataFrame) -> DataFrame:
    """(k, label) of those of the classes (region, k) whose region has several labels under the links: where links have
    joined all of a region or cluster, nothing is left to find in it."""
    named = labelled(parted, links)
    several = named.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("region")
    return settled(named.join(several, "region").select("k", "label").distinct())


def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with the label of each k: its component under the links."""
    labels = components(links).select(F.col("node").alias("k"), F.col("component").alias("label"))
    return rows.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))


def shingles_of(rows: DataFrame, size: int) -> DataFrame:
    """(k, h): the set of each row (k, text)."""
    return per_text(rows, ["k"], [("h", pa.list_(pa.int64()))], lambda: lambda data: (shingle_set(data, size).view(np.int64),))


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets (h) fall in each of BUCKETS buckets: a fixed number of counters at any size."""
    bucket = F.pmod("h", F.lit(BUCKETS)).alias("bucket")
    got = sets.select(F.explode("h").alias("h")).groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return counts


def _prefixes(counts: np.ndarray, percent: int) -> Callable:
    """(k, label, n, at, h): the first shingles of each set (k, label, h) in the order of their buckets' counts, so many
    that sets which reach the threshold share one; at is a shingle's place in that order, n the set's size. Any one order of
    all shingles will do; this one puts the frequent ones last."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, label, h in zip(b.column("k"), b.column("label"), b.column("h")):
                h = h.values.to_numpy()
                n = len(h)
                first = n - -(-n * percent // 100) + 1
                h = h[np.lexsort((h, counts[h % BUCKETS]))[:first]]
                out.append((np.full(first, k.as_py()), np.full(first, label.as_py()), np.full(first, n), np.arange(first), h))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["k", "label", "n", "at", "h"])

    return listed


def _meet(percent: int, least: float, few: bool) -> Callable:
    """Pairs (a, b) of rows (spot, k, label, asks, n, at, sig) of a spot whose labels differ, of which one asks, and whose
    sizes, places of the shingle and signatures allow the threshold: all, or few, as many as would join their labels, of
    those for a row that agree most."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ks, labels, asks, ns, ats, sigs in _spots(batches, "k", "label", "asks", "n", "at", "sig"):
            k, label, n, left = np.array(ks), np.array(labels), np.array(ns), np.array(ns) - np.array(ats)
            ask, sig = np.array(asks, bool), _sigs(sigs)
            for i in np.flatnonzero(ask).tolist():
                fits = (label != label[i]) & (~ask | (k > k[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                j = np.flatnonzero(fits & ((100 + percent) * np.minimum(left, left[i]) >= percent * (n + n[i])))
                agree = np.count_nonzero(sig[j] == sig[i], axis=1)
                near = agree >= least * HASHES
                j, agree = j[near], agree[near]
                if few and len(j):
                    j = j[np.argsort(-agree, kind="stable")]
                    j = j[np.unique(label[j], return_index=True)[1]]
                    label[np.isin(label, label[j])] = label[i]
                if len(j):
                    yield np.minimum(k[j], k[i]), np.maximum(k[j], k[i])

    return lambda batches: _batches(found(batches))


def _linked(reps: DataFrame, sets: DataFrame, counts: np.ndarray, rows: DataFrame, percent: int, few: bool) -> DataFrame:
    """(a, b): links between those of the classes (k, label) whose labels differ, by prefix filter over their sets (k, h),
    confirmed on these; counts order the shingles; reps: (k, sig) of all classes. All links, or few that join labels.
    Classes get their labels before their shingles are listed, and signatures join the listed rows before these are copied
    to blocks: what a join makes grows with the sets, not with the copies."""
    n = shuffle_partitions(reps.sparkSession)
    listed = sets.join(rows.select("k", "label").hint("merge"), "k").select("k", "label", "h").mapInArrow(_prefixes(counts, percent), "k long, label long, n long, at long, h long")
    met = _blocks(settled(listed), "h", "label", reps.select("k", "sig")).select("spot", "k", "label", "asks", "n", "at", "sig")
    met = met.repartition(n, "spot").sortWithinPartitions("spot", "k").mapInArrow(_meet(percent, least_agreement(percent / 100), few), "a long, b long")
    side = lambda c: sets.select(F.col("k").alias(c), F.col("h").alias(f"h{c}"))
    pairs = met.distinct().join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return pairs.where(100 * F.col("both") >= percent * (F.size("ha") + F.size("hb") - F.col("both"))).select("a", "b")


def parted_links(reps: DataFrame, texts: DataFrame, rows: DataFrame, size: int, percent: int, still: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): links between those of the classes (k, label) whose labels differ; reps: (k, sig) and texts: (k, text) of
    all classes. Labels that link at many pairs are joined by few of them first: `still` gives the classes (k, label) that
    are left under such links, and the last search is for all links between these. Without it, all links are found."""
    sets = settled(shingles_of(texts.select("k", "text").join(rows.select("k").hint("merge"), "k"), size))
    counts = shingle_counts(sets)
    found = reps.sparkSession.createDataFrame([], "a long, b long")
    for _ in range(ROUNDS if still else 0):
        new = settled(_linked(reps, sets, counts, rows, percent, True))
        if new.isEmpty():
            break
        found = found.unionByName(new)
        rows = still(found)
    return found.unionByName(settled(_linked(reps, sets, counts, rows, percent, False)))


def grouped_rows(docs: DataFrame, size: int, percent: int, id_col: str, text: str, keep: list[str]) -> DataFrame:
    """(row, text, id, n_shingles, component_id, chosen) of every row of docs: row has the columns `keep`; one row of each
    component is chosen, one with its least id if it has any."""
    rows = described(docs, size, id_col, text, keep)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("first")
    classes = settled(rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("k").alias("k"), F.first("sig").alias("sig"), first))
    joined = components(confirmed_links(classes.select("k", "sig"), rows.select("k", "text"), size, percent))
    named = classes.select("s1", "s2", F.col("k").alias("node"), "first").join(joined, "node", "left")
    named = named.select("s1", "s2", "first", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    found = named.drop("first").join(firsts, "component").select("s1", "s2", F.col("first.id").alias("component_id"), F.col("first.k").alias("k1"))
    plain = rows.select("row", "text", "id", "k", "n_shingles", "s1", "s2")
    full = plain.where("n_shingles > 0").join(found, ["s1", "s2"], "left").withColumn("chosen", F.col("k") == F.col("k1"))
    empty = plain.where("n_shingles = 0").withColumns({"component_id": F.col("id"), "chosen": F.lit(True)})
    names = ["row", "text", "id", "n_shingles", "component_id", "chosen"]
    return full.select(*names).unionByName(empty.select(*names))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id of the component) and kept of every row of docs."""
    rows = grouped_rows(docs, size, percent, id_col, text, [])
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, of each component one alone: one with its least id, or any if none has an id. Rows are told apart
    as such, so different texts under one id, and rows without an id, are judged like all others."""
    rest = [c for c in docs.columns if c != text]
    rows = grouped_rows(docs, size, percent, id_col, text, rest).where("chosen")
    return rows.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
