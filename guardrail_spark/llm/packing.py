"""Best-fit packing of documents into sequences of a fixed number of tokens, by sums of squares.

A document's ids and an end id are cut into pieces of at most `capacity` ids (only longer documents are cut). A full piece is
a sequence of its own. The others are dealt at random into shards of about SHARD pieces. Each shard places its pieces, longest
first, where the squared counts of open sequences per residual gap become smallest: into an open sequence of some gap, or
into a new one; among equals into the smallest gap. Sequences that end with at most SLACK ids free are closed. The pieces of
all others go to the next round, dealt anew into fewer shards, until they fit into one shard, or until a round has closed
hardly any (no places left to find): then all stay as they are. So no task ever holds more than a shard, whatever the input.

Ids come from the library word by word. Words are runs without the six ASCII blanks; a vocabulary whose pieces never cross
blanks (checked when the encoder is made) gives a text the ids of its words in a row. A worker keeps the words that it has
met; a word of Latin letters before a run of .,;:!? is its letters in lower case and then the run, which is what such a
vocabulary does with it (checked on samples). Caches are emptied when full, which never changes a result.

Defined cases: null or blank texts have the end id alone; very long texts are encoded in slices cut at blanks and become many
pieces; rows equal in all columns each get pieces of their own; ties in length are placed in order of row number; an empty
table gives no rows; null ids stay; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, small_batches

CAPACITY, END = 4096, 1
SHARD = 4096  # pieces that a task packs together
SLACK = 16  # ids that a closed sequence may leave free
SLICE = 1 << 20  # bytes of a text that are split into words at a time
MAX_WORDS, LONG_WORD = 1_000_000, 64  # entries of a cache, bytes of its longest word
_PLAIN = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, word by word."""

    def __init__(self, path: str, most: int | None = None):
        self.most = MAX_WORDS if most is None else most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        sample = ["a", "Été!?", "x'S", "́b", "--", "1.5"]
        if self._whole(" \n".join(sample)) != b"".join(map(self._whole, sample)):
            raise ValueError("packing needs a vocabulary whose pieces never cross blanks")
        self.folds = all(self._whole(w) == self._whole(w[:-2].lower()) + self._whole(w[-2:]) for w in ("Étage!?", "WORD.,", "ßÀ;:", "x,."))
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, texts: list[str]) -> Iterator[bytes]:
        return (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words; the parts that are not known are encoded all at once."""
        split = {}
        for w in missing:
            text = w.decode()
            plain = _PLAIN.fullmatch(text) if self.folds and len(w) <= LONG_WORD else None
            split[w] = (plain[1].lower(), plain[2]) if plain else (text,)
        wanted = list({p for parts in split.values() for p in parts if p not in self.parts})
        made = dict(zip(wanted, self._many(wanted)))
        found = {w: b"".join(made[p] if p in made else self.parts[p] for p in parts) for w, parts in split.items()}
        if len(self.parts) + len(made) > self.most:
            self.parts.clear()
        self.parts.update((p, i) for p, i in made.items() if len(p) <= LONG_WORD)
        return found

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        ids = list(map(self.words.get, words))
        missing = {w for w, i in zip(words, ids) if i is None}
        if missing:
            new = self._learn(missing)
            ids = [new[w] if i is None else i for w, i in zip(words, ids)]
            if len(self.words) + len(new) > self.most:
                self.words.clear()
            self.words.update((w, i) for w, i in new.items() if len(w) <= LONG_WORD)
        return ids

    def encode(self, data: bytes) -> Iterator[bytes]:
        """The ids of UTF-8 text, slice by slice."""
        at = 0
        while at < len(data):
            cut = _BLANK.search(data, min(at + SLICE, len(data)))
            end = cut.end() if cut else len(data)
            yield b"".join(self.of_words(data[at:end].split()))
            at = end


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps its caches from task to task."""
    return WordEncoder(path)


def pieces_of(encoder: WordEncoder, data: bytes, capacity: int, end: int) -> Iterator[bytes]:
    """The ids of a text and the end id, cut into pieces of at most `capacity`."""
    held, size = bytearray(), 4 * capacity
    for ids in encoder.encode(data):
        held += ids
        whole = len(held) // size * size
        for at in range(0, whole, size):
            yield bytes(held[at : at + size])
        del held[:whole]
    held += end.to_bytes(4, "little")
    for at in range(0, len(held), size):
        yield bytes(held[at : at + size])


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32, row) of every piece of every document; row is a number of its own, which holds
    as long as the table isn't computed anew: write it before it is used twice."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = word_encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            at, out = [], []
            for i, x in enumerate(b.column(1)):
                start = 0
                for n, ids in enumerate(pieces_of(own, x.as_buffer().to_pybytes(), capacity, end)):
                    at.append(i)
                    out.append((n, start, len(ids) // 4, zlib.crc32(ids), row))
                    start += len(ids) // 4
                    row += 1
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *columns], ["__id", "piece", "start", "length", "ids_crc32", "row"])

    kind = source.schema["__id"].dataType.simpleString()
    return source.mapInArrow(run, f"__id {kind}, piece int, start long, length long, ids_crc32 long, row long")


def sum_of_squares(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, placed in this order: each goes where the sum over gaps of the squared number of open bins
    becomes smallest, among equals into the smallest gap, a new bin last. Lengths lie within 1 and capacity - 1."""
    never = np.iinfo(np.int64).max
    count = np.zeros(capacity + 1, np.int64)  # open bins by residual gap
    open_bins: dict[int, list[int]] = {}
    placed, made = [], 0
    for size in lengths:
        # from gap g to g - size: 2 * (count[g - size] - count[g]) + 2; closing a bin or opening one changes one term alone
        costs = np.where(count[size + 1 : capacity] > 0, 2 * (count[1 : capacity - size] - count[size + 1 : capacity]) + 2, never)
        best, gap = (1 - 2 * count[size], size) if count[size] else (never, None)
        if len(costs) and costs[k := int(costs.argmin())] < best:
            best, gap = costs[k], size + 1 + k
        if 2 * count[capacity - size] + 1 < best:
            gap = None
        if gap is None:
            at, gap, made = made, capacity, made + 1
        else:
            at = open_bins[gap].pop()
            count[gap] -= 1
        if gap > size:
            count[gap - size] += 1
            open_bins.setdefault(gap - size, []).append(at)
        placed.append(at)
    return placed


def shard_packer(capacity: int, slack: int) -> Callable[[pa.Table], pa.Table]:
    """Gives a shard's pieces their sequence (the row number of its first piece), their offset, and whether it is closed."""

    def pack(shard: pa.Table) -> pa.Table:
        shard = shard.drop_columns(["shard"]).sort_by([("length", "descending"), ("row", "ascending")])
        lengths, rows = shard["length"].to_numpy(), shard["row"].to_numpy()
        bins = sum_of_squares(lengths.tolist(), capacity)
        first, filled, offsets = {}, {}, []
        for at, row, size in zip(bins, rows.tolist(), lengths.tolist()):
            first.setdefault(at, row)
            offsets.append(filled.get(at, 0))
            filled[at] = offsets[-1] + size
        made = [([first[x] for x in bins], pa.int64()), (offsets, pa.int64()), ([filled[x] >= capacity - slack for x in bins], pa.bool_())]
        for name, (values, kind) in zip(("sequence_id", "offset", "closed"), made):
            shard = shard.append_column(name, pa.array(values, kind))
        return shard

    return pack


def pack_pieces(made: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, slack: int = SLACK) -> DataFrame:
    """made (written pieces) with sequence_id and offset: no sequence holds more than capacity, none has a gap inside."""
    full = made.where(F.col("length") == capacity).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, pool = [full], made.where(F.col("length") < capacity)
    columns = ", ".join(f"{n} {t}" for n, t in full.dtypes)
    before, n = None, pool.count()
    while n:
        shards = -(-n // shard)
        last = shards == 1 or (before is not None and n > 0.9 * before)
        dealt = pool.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(n)), F.lit(shards)))
        placed = settled(dealt.groupBy("shard").applyInArrow(shard_packer(capacity, slack), f"{columns}, closed boolean"))
        out.append((placed if last else placed.where("closed")).drop("closed"))
        if last:
            break
        pool = placed.where("not closed").drop("sequence_id", "offset", "closed")
        before, n = n, pool.count()
    packed = out[0]
    for more in out[1:]:
        packed = packed.unionByName(more)
    return packed


def packing(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece. `path` names the vocabulary file, which
    every executor has."""
    packed = pack_pieces(settled(pieces(docs, path, id_col, text, capacity, end)), capacity)
    return packed.select(F.col("__id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
