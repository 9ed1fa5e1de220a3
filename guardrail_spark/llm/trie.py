"""A trie of conversations' prefixes, by collapse of whole sequences.

Each turn is reduced to a digest of its role and text and its number of words before anything is shuffled; texts move no
further. Turns in order chain to digests of prefixes: a stream through sorted rows that keeps one digest. Conversations with
the same whole sequence collapse into one weighted sequence, named by its least id, so that however many copies there are,
only one goes on. Sequences whose digest is another's proper prefix are dropped by an anti-join: the rest are the leaves. A
node is a prefix digest; it sums the weights and leaves of the sequences through it.

Tokens saved in a subtree are sums over its sequences as well. Each node is owned by the least sequence through it, and what
a sequence owns is the end of its path, from some depth on. With B(d) the words before depth d and T all words of a sequence,
the nodes of a subtree at depth d hold (weight * (T - B(d))) words counted once a member, and (T - max(B(d), B(own))) words
counted once a node, both summed over its sequences; the difference is what is saved. So the tree is never walked.

Defined cases: rows without conv_id belong to no conversation; null roles and texts are empty; turns of equal number stand in
order of their digests, null numbers first; repeated rows are turns of their own; conversations of any length are streamed;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE_WORD, settled

BLOCK, HEADS = 20, 4  # conversations that share a head, and one more than the most turns of a head
CHUNK = 8192  # ids that are joined to one text before they are hashed
HEAVY = 10_000  # parents with the most children, whose ids are broadcast: any other has less than a HEAVYth of all nodes
ROOT = b""


def turn_digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, words): pos is a turn's place from 1."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    rows = conversations.where(F.col(f"`{conv}`").isNotNull())
    rows = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.regexp_count(t, F.lit(ASCII_SPACE_WORD)).cast("long").alias("words"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", place.cast("long").alias("pos"), "digest", "words")


def with_shared_heads(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """Every conversation c rebuilt: the first crc32(c) % heads turns of conversation c - c % block, then its own turns after
    as many. Places stay; a rebuilt conversation may have none."""
    h = lambda c: F.crc32(F.col(c).cast("string")) % heads
    own = turns.where(F.col("pos") > h("conv_id"))
    base = turns.where((F.col("pos") < heads) & (F.col("conv_id") % block == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    ids = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    return own.unionByName(ids.join(base, "base").where(F.col("pos") <= h("conv_id")).drop("base"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, prefix, parent, words, before, last) of every turn of (conv_id, pos, digest, words): the digests of
    the turns up to it and before it, and the words before it."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, at, before, held = None, 0, ROOT, 0, None
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["conv_id", "depth", "prefix", "parent", "words", "before", "last"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            out = []
            for c, digest, words in zip(*(b.column(n).to_pylist() for n in ("conv_id", "digest", "words"))):
                if held:
                    out.append((*held, c != conv))
                if c != conv:
                    conv, depth, at, before = c, 0, ROOT, 0
                depth += 1
                parent, at = at, hashlib.blake2b(at + digest, digest_size=16).digest()
                held = (c, depth, at, parent, words, before)
                before += words
            if out:
                yield batch(out)
        if held:
            yield batch([(*held, True)])

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInArrow(chain, "conv_id long, depth long, prefix binary, parent binary, words long, before long, last boolean")


def end_lists(ends: DataFrame) -> DataFrame:
    """(seq, ends_sha256): the digest of each sequence's ids (seq, conv_id) in ascending order, joined by commas. The ids are
    sorted by range, so that those of one large sequence are sorted and joined in many tasks; only the joined texts pass
    through one task, which keeps no more than the state of a hash."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, seq, ids = [], None, []
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (s != seq or len(ids) == CHUNK):
                    out.append((seq, ids[0], ",".join(map(str, ids))))
                    ids = []
                seq = s
                ids.append(c)
            if ids:
                out.append((seq, ids[0], ",".join(map(str, ids))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], ["seq", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.string()))], ["seq", "ends_sha256"])

        for b in batches:
            out = []
            for s, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if state is not None and s == seq:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield batch(out)
        if state is not None:
            yield batch([(seq, state.hexdigest())])

    parts = ends.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(joined, "seq binary, first long, ids string")
    return parts.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq binary, ends_sha256 string")


def trie_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of all conversations: convs (conv_id), each once, and their turns (conv_id, pos, digest,
    words). Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, prefix)."""
    root: Column = F.lit(ROOT)
    chained = settled(prefixes(turns))
    tips = chained.where("last").select("conv_id", F.col("prefix").alias("seq"), (F.col("before") + F.col("words")).alias("total"))
    ends = settled(convs.join(tips, "conv_id", "left").select("conv_id", F.coalesce("seq", root).alias("seq"), F.coalesce("total", F.lit(0)).cast("long").alias("total")))
    collapsed = ends.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total"))
    leaves = collapsed.join(chained.select(F.col("parent").alias("seq")).distinct(), "seq", "left_anti").select("seq", F.lit(1).alias("leaf"))
    weighted = settled(collapsed.join(leaves, "seq", "left").select("conv_id", "weight", "total", F.coalesce("leaf", F.lit(0)).alias("leaf")))
    own_root = weighted.select("*", F.lit(0).cast("long").alias("depth"), root.alias("prefix"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("before"))
    paths = settled(chained.join(weighted, "conv_id").select(*own_root.columns).unionByName(own_root))

    owned = paths.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.min("before").alias("before"))
    owned = owned.groupBy("conv_id").agg(F.min("before").alias("own"))
    inside = F.col("weight") * (F.col("total") - F.col("before")) - (F.col("total") - F.greatest("before", F.coalesce("own", "total")))
    nodes = settled(paths.join(owned, "conv_id", "left").groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(inside).alias("saved_tokens"),
    ))

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"))
    known = settled(nodes.join(children, "prefix", "left").join(end_lists(ends).withColumnRenamed("seq", "prefix"), "prefix", "left"))
    parents = known.where("n_children is not null").select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = parents.orderBy(F.col("n_children").desc(), "parent").limit(HEAVY).drop("n_children")
    near = known.join(F.broadcast(heavy), "parent", "left")
    at_once = F.col("parent").isNull() | F.col("parent_conv_id").isNotNull()
    far = near.where(~at_once).drop("parent_conv_id").join(parents.drop("n_children"), "parent", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return near.where(at_once).unionByName(far).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "prefix",
    )


def prefix_trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """The trie of conversations rebuilt with shared heads."""
    turns = settled(turn_digests(conversations))
    return trie_nodes(turns.where("pos = 1").select("conv_id"), with_shared_heads(turns, block, heads))
