"""Toxicity by noisy-channel deobfuscation.

Writers hide words behind look-alike characters (`1d10t`), repeated letters (`looooser`) and spacing (`s c u m`). Each
observed word spans a character lattice: a character may stand for itself, for letters that it resembles, for nothing
(a repetition of the letter before, a separator). Viterbi finds the likeliest path under a character trigram model,
counted over all texts of the corpus, times the channel's probabilities. Restored words are then scored.

The classifier is learnt from a bounded sample of labelled rows (SAMPLE rows, lowest hashes first): for each word
beginning of 4, 5 or 6 bytes, the share of toxic documents among those that have it, kept where the lower Wilson bound is
MIN_PRECISION or more. Of near copies among the sample (same least hash of three words) one counts. A beginning is then
worth the share of toxic documents among those that have no better one, and a document's score is the noisy-or of the
beginnings it has.

Words whose lattice cannot reach any scored beginning need no decoding for the score. That is tested exactly: look-alike
classes and repetitions collapse to one key which is the same for every path of a lattice.

Defined cases: null or empty text gets the base score; labels that are null are no labels, of repeated labels the
highest counts; without labelled rows every score is the base score; repeated rows each get a row; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, settled

SAMPLE = 20_000
LENGTHS = (4, 5, 6)
MIN_TOXIC, MIN_PRECISION, Z = 3, 0.5, 2.5
BASE, THRESHOLD = 0.01, 0.3
#: The channel: chances that a letter is written as itself, as a look-alike, again, or followed by a separator.
P_SAME, P_ALIKE, P_AGAIN, P_GAP = 0.90, 0.04, 0.04, 0.02
ALIKE = {"1": "il", "!": "il", "|": "il", "0": "o", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g"}
SEPARATORS = " .-_*~"
#: Marks that may hug a word without being part of it.
HUG = b".,;:?\"'()[]{}<>#%&*$!|~_-"
#: Those of them that no lattice reads as a letter or drops.
_OUTSIDE = b".,;:?\"'()[]{}<>#%&~"
SPACED = re.compile(rb"(?<![^ \t\r\n\x0b\x0c])(?:[^ \t\r\n\x0b\x0c][ .\-_*~] *){2,}[^ \t\r\n\x0b\x0c](?![^ \t\r\n\x0b\x0c])")
_AGAIN = re.compile(rb"(.)\1+", re.S)
#: One class for letters and look-alikes that a lattice may exchange.
_CLASS = bytes.maketrans(b"l1!|0344@5$7+89", b"iiiioeaaassttbg")
_DROPPED = b" .-_*~"

#: The model's 64 characters: blank, a-z, digits, other signs, and the bytes of other letters folded to 32.
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[33:128] = 28
SYMBOL[48:58] = 27
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = 29 + np.arange(128) % 32
SHARE = {27: 10, 28: 32}


def collapsed(word: bytes) -> bytes:
    """The key that all paths of a word's lattice share."""
    return _AGAIN.sub(rb"\1", word.translate(_CLASS, _DROPPED))


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all whole texts, each between blanks; summed in each task before the shuffle."""
    source = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64**3, np.int64)
        for b in batches:
            data = b" " + b" ".join(x.as_buffer().to_pybytes() for x in b.column(0)) + b" "
            for at in range(0, len(data), 1 << 22):
                s = SYMBOL[np.frombuffer(data, np.uint8)[at : at + (1 << 22) + 2]].astype(np.int32)
                total += np.bincount(s[:-2] << 12 | s[1:-1] << 6 | s[2:], minlength=64**3)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(total[grams], pa.int64())], ["gram", "n"])

    return source.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_probabilities(counts: list[tuple[int, int]]) -> np.ndarray:
    """ln P(third | first two) of interpolated trigram, bigram and unigram frequencies."""
    three = np.zeros((64, 64, 64))
    for gram, n in counts:
        three[gram >> 12, gram >> 6 & 63, gram & 63] = n
    two, one = three.sum(0), three.sum((0, 1)) + 0.5
    one /= one.sum()
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    return np.log((three + 20 * two) / (three.sum(2, keepdims=True) + 20)).astype(np.float32)


def decode(word: str, model: np.ndarray, spelt: bool = False) -> str:
    """The likeliest intended word (Viterbi over the lattice of a lower-cased word, states: last two characters). In a
    run of spelt-out letters a separator may also stand for the blank between two words."""
    same, alike, again, gap = (math.log(p) for p in (P_SAME, P_ALIKE, P_AGAIN, P_GAP))
    states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
    for ch in word:
        new: dict[tuple[int, int, str], tuple[float, str]] = {}

        def put(key: tuple[int, int, str], score: float, made: str) -> None:
            if key not in new or new[key][0] < score:
                new[key] = score, made

        within = SHARE.get(int(SYMBOL[ch.encode()[0]]), 1)  # the model has one symbol for so many characters
        options = [(ch, same - math.log(within)), *((x, alike) for x in ALIKE.get(ch, ""))]
        for (a, b, last), (score, made) in states.items():
            if last and (last == ch or last in ALIKE.get(ch, "")):
                put((a, b, last), score + again, made)
            if ch in SEPARATORS and made:
                put((a, b, last), score + gap, made)
                if spelt and last:
                    put((b, 0, ""), score + gap + float(model[a, b, 0]), made + " ")
            if ch == " ":
                continue  # inside a spelt-out word a blank is never a letter
            for x, cost in options:
                c = int(SYMBOL[x.encode()[0]])
                put((b, c, x), score + cost + float(model[a, b, c]), made + x)
        states = new or states
    return max(((s + float(model[a, b, 0]), m) for (a, b, _), (s, m) in states.items()), default=(0.0, ""))[1]


@dataclass(frozen=True)
class Model:
    """Bounded by the alphabet and by the sample: 64**3 floats and the kept beginnings."""

    trigrams: np.ndarray
    precision: dict[bytes, float]


class Restorer:
    """Restored words of texts, with a memo that is emptied when full."""

    def __init__(self, model: Model, everything: bool = False):
        self.model, self.everything = model, everything
        self.keys = {collapsed(f) for f in model.precision}
        self.sizes = sorted({len(k) for k in self.keys})
        self.memo: dict[bytes, bytes] = {}
        self.runs: dict[bytes, list[bytes]] = {}

    def reaches(self, word: bytes) -> bool:
        key = collapsed(word)
        return any(key[:n] in self.keys for n in self.sizes)

    def run(self, run: bytes) -> list[bytes]:
        """The words that a lower-cased run of spelt-out letters may mean: as one, cut where blanks are likely, and those
        that reach a scored beginning from any letter on."""
        key = collapsed(run)
        if not self.everything and not any(key[i : i + n] in self.keys for i in range(len(key)) for n in self.sizes):
            return []
        found = self.runs.get(run)
        if found is None:
            text = run.strip(_OUTSIDE).decode("utf-8", "replace")
            found = [w.strip(HUG) for spelt in (False, True) for w in decode(text, self.model.trigrams, spelt).encode().split()]
            # a word may begin at any letter; beginnings are short, so 64 letters and their separators tell them
            for i in range(1, len(text)):
                rest = text[i : i + 128]
                if text[i] not in SEPARATORS and self.reaches(rest.encode()):
                    found.append(decode(rest, self.model.trigrams).encode().strip(HUG))
            if len(self.runs) >= 100_000:
                self.runs.clear()
            self.runs[run] = found = list(dict.fromkeys(found))
        return found

    def word(self, word: bytes) -> bytes:
        """A lower-cased word as it was meant, without the marks that hug it."""
        found = self.memo.get(word)
        if found is None:
            core = word.strip(HUG)
            inner = word.strip(_OUTSIDE)
            # `$` or `!` at an end may be a letter too
            if core.isalpha() and not _THRICE.search(core) and (inner.strip(b"*_-") == core or self.scored(core)):
                found = core
                if _AGAIN.search(core) and not self.scored(core) and self.reaches(core):
                    found = decode(core.decode("utf-8", "replace"), self.model.trigrams).encode()
            elif self.everything or self.reaches(inner):
                found = decode(inner.decode("utf-8", "replace"), self.model.trigrams).encode().strip(HUG)
            else:
                found = core
            if len(self.memo) >= 300_000:
                self.memo.clear()
            self.memo[word] = found
        return found

    def scored(self, core: bytes) -> bool:
        return any(core[:n] in self.model.precision for n in LENGTHS)

    def words(self, data: bytes) -> list[bytes]:
        """The restored words of a text, each spelt-out run (`i d i o t`) as one and cut into words."""
        low = data.lower()
        runs = [m.group() for m in SPACED.finditer(low)]
        return [*(w for r in runs for w in self.run(r)), *map(self.word, low.split())]

    def beginnings(self, data: bytes) -> set[bytes]:
        words = {self.word(w) for w in set(data.lower().split())}
        words |= {w for m in SPACED.finditer(data.lower()) for w in self.run(m.group())}
        return {w[:n] for w in words for n in LENGTHS if len(w) >= n}


def _sketch(data: bytes) -> int:
    """The least hash of three words in a row, which near copies mostly share."""
    h = np.fromiter(map(zlib.crc32, data.split()), np.uint64)
    if len(h) < 3:
        return zlib.crc32(data) | 1 << 40
    return int(((h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(8)).min())


_THRICE = re.compile(rb"(.)\1\1", re.S)


def labelled(labels: DataFrame, usable: Column, id_col: str, label: str) -> DataFrame:
    """(id, toxic) of at most SAMPLE usable labelled rows, lowest hashes first."""
    rows = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & usable)
    rows = rows.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(F.col(f"`{label}`")).cast("int").alias("__y"))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Counts the language model over all docs and learns the classifier from the sample of labels. `usable` is a
    condition over the id that says which labels may be learnt from."""
    trigrams = log_probabilities([tuple(r) for r in trigram_counts(docs, text).collect()])  # 64**3 rows at most
    sample = labelled(labels, F.lit(True) if usable is None else usable, id_col, label)
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))

    def sketch() -> Callable:
        return lambda data: (_sketch(data),)

    rows = settled(texts.join(F.broadcast(sample), "__id"))  # SAMPLE labels at most; the texts are that sample's
    sketches = per_text(rows.select("__id", F.col("t").alias("text")), ["__id"], [("s", pa.int64())], sketch)
    apart = sketches.groupBy("s").agg(F.min("__id").alias("__id")).select("__id").distinct()
    rows = settled(rows.join(F.broadcast(apart), "__id").select("__y", "t"))
    counts = "f binary, n long, t long"

    def tally(pick: Callable) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer, found = Restorer(Model(trigrams, {}), everything=True), {}
            for b in batches:
                for y, x in zip(b.column(0).to_pylist(), b.column(1)):
                    for f in pick(restorer.beginnings(x.as_buffer().to_pybytes())):
                        n = found.setdefault(f, [0, 0])
                        n[0] += 1
                        n[1] += y
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([t for _, t in found.values()], pa.int64())], ["f", "n", "t"])

        return rows.mapInArrow(count, counts).groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))

    p = F.col("t") / F.col("n")
    low = (p + Z * Z / (2 * F.col("n")) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * F.col("n"))) / F.col("n"))) / (1 + Z * Z / F.col("n"))
    kept = tally(lambda found: found).withColumn("low", low).where((F.col("t") >= MIN_TOXIC) & (F.col("low") >= MIN_PRECISION)).collect()  # bounded by the sample
    rank = {bytes(r.f): (r.low, bytes(r.f)) for r in kept}
    best = tally(lambda found: sorted(found.intersection(rank), key=rank.__getitem__)[-1:]).collect()  # at most as many
    own = {bytes(r.f): (r.t, r.n) for r in best}
    return Model(trigrams, {bytes(r.f): (own.get(bytes(r.f), (0, 0))[0] + r.t / (r.n + 1)) / (own.get(bytes(r.f), (0, 0))[1] + 1) for r in kept})


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("__t"))
    return scored_rows(rows, model, "__t", [id_col])


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold; columns may have any names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    clean = scored_rows(plain, model, f"c{docs.columns.index(text)}").where(F.col("score") < threshold)
    return clean.drop("score").toDF(*docs.columns)


def scored_rows(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep` of it, none of them named score) with the column score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        restorer, precision = Restorer(shared.value), shared.value.precision

        def one(data: bytes) -> tuple:
            clean = 1 - BASE
            for f in restorer.beginnings(data).intersection(precision):
                clean *= 1 - precision[f]
            return (1 - clean,)

        return one

    return per_text(docs, keep or docs.columns, [("score", pa.float64())], start, text)


def restore(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, restored): the restored words of every row's text, decoded whether scored or not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        restorer = Restorer(shared.value, everything=True)
        return lambda data: (b" ".join(restorer.words(data)).decode("utf-8", "replace"),)

    return per_text(docs, [id_col], [("restored", pa.string())], start, text)


@lru_cache(maxsize=None)
def held_out_rule(id_col: str = "doc_id") -> str:
    return f"crc32(cast(cast(`{id_col}` as string) as binary)) % 4 = 2"


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Score and prediction of every row; labels whose id is held out are never learnt from."""
    rule = held_out_rule(id_col)
    model = fit(docs, labels, ~F.expr(rule), id_col, text)
    return score_texts(docs, model, id_col, text).select(
        F.col(f"`{id_col}`"), F.coalesce(F.expr(rule), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
