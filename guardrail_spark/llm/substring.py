"""Substring dedup by relative Lempel-Ziv parsing.

Every text is a reference block for every other one and for its own other places. A text is factored greedily: from the
first window of WINDOW words that also starts elsewhere, the reference that agrees longest is taken and the factor grows
along it until it no longer agrees; the next factor begins with the window that the last one could not take, so it shares
WINDOW - 1 words with it, and all windows that straddle a factor's boundary are looked up too. So the factors cover
exactly the words of windows that occur more than once. A factor is confirmed by a 128-bit digest of its words, taken at
the reference and at the text; confirmed factors are the duplicate spans.

The index of the reference blocks is sparse. Of any 24 neighbouring 12-word grams the one with the least hash is an
anchor, so each window holds one, the same for equal windows. First the anchors alone are shuffled and those that occur
once drop out. Then each place of a shared anchor sends the hashes of the windows that it is the anchor of (24 at most);
places that meet under one anchor find the windows they share, with the least place as reference. In both shuffles a task
merges equal keys first: what it meets again is known to be shared and needs no counting, so a passage that a third of all
texts share sends a few rows for each task. An anchor at more than HOT places, such as a line common to texts that differ
around it, sends each of its windows under a key of its own, so that its places spread over all tasks.

Defined cases: null text has no words; fewer than WINDOW words: nothing is removed; equal rows are different places, even
with one id or none, so both lose what they share; rows are told apart by 98 bits of hashes of id and text; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches

WINDOW, GRAM = 35, 12
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


class Rolling:
    """Hashes of all runs of k words: sum of word hash times base**(k-1-j), modulo 2**64, then mixed."""

    def __init__(self) -> None:
        self.size = 0

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(4096, 2 * n)
            self.up = [_powers(b, self.size) for b in (_B1, _B2)]
            self.down = [_powers(pow(b, -1, 1 << 64), self.size) for b in (_B1, _B2)]

    def runs(self, h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        n = len(h)
        if n < k:
            return np.empty(0, np.uint64)
        self.grow(n)
        total = np.r_[np.uint64(0), np.cumsum(h * self.down[which][:n], dtype=np.uint64)]
        x = (total[k:] - total[:-k]) * self.up[which][k - 1 : n]
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(29)


_ROLLING = Rolling()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its anchor, and the gram hashes. Of equal least hashes the last one is taken,
    which again depends on the window's words alone."""
    grams = _ROLLING.runs(h, GRAM)
    span = WINDOW - GRAM + 1
    n = len(h) - WINDOW + 1
    # doubling: least hash, and its last place, of spans of 16 grams, then of two that overlap
    place, least = np.arange(len(grams)), grams
    width = 1
    while 2 * width <= span:
        a, b = least[:-width], least[width:]
        right = b <= a
        place, least = np.where(right, place[width:], place[:-width]), np.where(right, b, a)
        width *= 2
    a, b = least[:n], least[span - width :][:n]
    return np.where(b <= a, place[span - width :][:n], place[:n]), grams


_BUFFER = 1_000_000  # keys that a task merges at a time
HOT, MOST_HOT = 4096, 100_000  # the MOST_HOT anchors of more places than HOT send each window by its own key
#: A place: (row, at); at holds 34 more bits of the row's hash (its tag), a flag, and the word's number.
TAG, FLAG = 29, 1 << 28
NUMBER = FLAG - 1


def _texts(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple]:
    for b in batches:
        for *row, text in zip(*(b.column(k).to_pylist() for k in keys), b.column("__text")):
            yield *row, text.as_buffer().to_pybytes().split()


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names.split())


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, row, at) of every anchor; places of an anchor that the task meets again are flagged as known to be shared."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        h, row, at = (np.concatenate(x) for x in zip(*parts))
        _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        again = n[inverse] > 1
        # the first place of a repeated anchor also asks for it, in the others' name, as two
        asks = np.flatnonzero(again & (first[inverse] == np.arange(len(h))))
        every = np.concatenate([np.arange(len(h)), asks, asks])
        flag = np.concatenate([again, np.zeros(2 * len(asks), bool)])
        return _batch("h row at", h[every], row[every], at[every] | np.where(flag, FLAG, 0))

    for row, tag, words in _texts(batches, "__row", "__tag"):
        if len(words) >= WINDOW:
            place, grams = anchors(word_hashes(words))
            at = np.unique(place)
            parts.append((grams[at].view(np.int64), np.full(len(at), row), at.astype(np.int64) | tag << TAG))
            held += len(at)
            if held >= _BUFFER:
                yield flush()
                parts, held = [], 0
    if parts:
        yield flush()


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, row, at) of the known and of those whose h stands next to an equal one. Rows come sorted by h."""
    rest = None
    for b in batches:
        h, row, at = (b.column(i).to_numpy() for i in range(3))
        if rest is not None:
            h, row, at = (np.concatenate(x) for x in zip(rest, (h, row, at)))
        known = (at & FLAG) > 0
        yield _batch("h row at", h[known], row[known], at[known] & ~FLAG)
        h, row, at = h[~known], row[~known], at[~known]
        if not len(h):
            rest = None
            continue
        same = h[1:] == h[:-1]
        out = np.r_[False, same] | np.r_[same, False]
        # the last row waits for its successor, with one equal before it if there is one
        keep = 2 if len(h) > 1 and same[-1] else 1
        if keep == 1:
            out[-1:] = False
        yield _batch("h row at", h[out], row[out], at[out])
        rest = (h[len(h) - keep :], row[len(h) - keep :], at[len(h) - keep :])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, row, at, hashes) for each place of a shared anchor: its gram's hash, the first window that it is the anchor of,
    and the hashes of these neighbouring windows; for places that are flagged as hot a row for each window. Equal lists in
    a task go on as two rows; the rest are known (hashes: their number, 4 bytes, and the first of them)."""
    held: dict[tuple[int, bytes], list] = {}
    ready: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [*ready, *((h, *places[0], x) for (h, x), places in held.items())]
        for i in range(0, len(rows), 50_000):
            h, row, at, x = zip(*rows[i : i + 50_000])
            yield _batch("h row at hashes", h, row, at, pa.array(x, pa.binary()))

    def put(h: int, row: int, at: int, x: bytes) -> None:
        places = held.setdefault((h, x), [])
        if len(places) < 2:
            places.append((row, at))
            if len(places) == 2:
                ready.append((h, row, at, x))
        else:
            ready.append((row ^ at, row, at, (len(x) // 8).to_bytes(4, "little") + np.array(places[0], np.int64).tobytes()))

    for row, tag, shared, words in _texts(batches, "__row", "__tag", "shared"):
        h = word_hashes(words)
        place, grams = anchors(h)
        windows = _ROLLING.runs(h, WINDOW, 1)
        shared = np.unique(np.array(shared, np.int64))
        numbers, hot = shared & NUMBER, (shared & FLAG) > 0
        first, end = np.searchsorted(place, numbers), np.searchsorted(place, numbers, "right")
        keys = grams[numbers].view(np.int64).tolist()
        for g, own, i, j in zip(keys, hot.tolist(), first.tolist(), end.tolist()):
            if own:
                for k, w in zip(range(i, j), windows[i:j].view(np.int64).tolist()):
                    put(g ^ w, row, k | tag << TAG, windows[k : k + 1].tobytes())
            elif i < j:
                put(g, row, i | tag << TAG, windows[i:j].tobytes())
        if len(held) + len(ready) >= _BUFFER // 4:
            yield from flush()
            held, ready = {}, []
    yield from flush()


MATCHES = "row long, at long, n long, ref_row long, ref_at long"


def _compare(rows: list[tuple]) -> pa.RecordBatch | None:
    """What the places under one anchor share, as MATCHES: runs of n windows, each also found along one reference, which is
    the least other place that has the first."""
    if len(rows) < 2:
        return None
    rows.sort(key=lambda r: (r[1], r[2]))
    sizes = np.array([len(r[3]) // 8 for r in rows])
    of = np.repeat(np.arange(len(rows)), sizes)
    step = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
    windows = np.frombuffer(b"".join(r[3] for r in rows), np.uint64)
    _, first, inverse, n = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
    found = np.flatnonzero(n[inverse] > 1)
    if not len(found):
        return None
    last = np.zeros(len(first), np.int64)
    np.maximum.at(last, inverse, np.arange(len(of)))
    ref = np.where(first[inverse] == np.arange(len(of)), last[inverse], first[inverse])[found]
    row, at = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    mine, other, shift = of[found], of[ref], step[ref] - step[found]
    new = np.r_[True, (np.diff(found) != 1) | (np.diff(mine) != 0) | (np.diff(other) != 0) | (np.diff(shift) != 0)]
    begin = np.flatnonzero(new)
    lead = found[begin]
    return _batch(
        "row at n ref_row ref_at", row[mine[begin]], at[mine[begin]] + step[lead],
        np.diff(np.r_[begin, len(found)]), row[other[begin]], at[other[begin]] + step[ref[begin]],
    )


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h."""
    group: list[tuple] = []
    made: list[pa.RecordBatch] = []
    known: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        if known:
            made.append(_batch("row at n ref_row ref_at", *zip(*known)))
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()
        made.clear()
        known.clear()

    def compare() -> None:
        if len(group) > 1 and all(r[3] == group[0][3] for r in group):  # whole lists are equal
            places = sorted((r[1], r[2]) for r in group)
            n = len(group[0][3]) // 8
            known.append((*places[0], n, *places[-1]))
            known.extend((*p, n, *places[0]) for p in places[1:])
        elif (m := _compare(group)) is not None:
            made.append(m)

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if len(r[3]) == 20:
                known.append((r[1], r[2], int.from_bytes(r[3][:4], "little"), *np.frombuffer(r[3], np.int64, 2, 4).tolist()))
                continue
            if group and group[-1][0] != r[0]:
                compare()
                group = []
            group.append(r)
        yield from out()
    compare()
    yield from out()


def parse(matches: list[dict]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, number of words, reference row, reference place) of one text from its matches: always
    the reference that agrees longest from the first window not yet taken."""
    runs: dict[tuple[int, int], list[list[int]]] = {}
    for m in sorted(matches, key=lambda m: m["at"]):
        a, e = m["at"] & NUMBER, (m["at"] & NUMBER) + m["n"]
        own = runs.setdefault((m["ref_row"], m["ref_at"] - a), [])  # a reference and its diagonal
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([a, e])
    todo = sorted((a, e, *key) for key, own in runs.items() for a, e in own)
    out, done, i = [], 0, 0
    best: tuple = (0,)
    while i < len(todo) or best[0] > done:
        if best[0] <= done and i < len(todo) and todo[i][0] > done:
            done = todo[i][0]
        while i < len(todo) and todo[i][0] <= done:
            best = max(best, (todo[i][1], *todo[i][2:]))
            i += 1
        if best[0] > done:
            end, row, diagonal = best
            out.append((done, end - done + WINDOW - 1, row, diagonal + done))
            done = end
    return out


FACTORS = "row long, tag long, start long, words long, ref_row long, ref_at long"


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [(row, tag, *f) for row, tag, matches in zip(*(c.to_pylist() for c in b.columns)) for f in parse(matches)]
        if made:
            yield _batch("row tag start words ref_row ref_at", *zip(*made))


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref_row, ref_at, words, digest) of the pieces that factors point at."""
    for b in batches:
        made = []
        for row, asked, words in _texts(iter([b]), "__row", "asked"):
            made += [(row, x["ref_at"], x["words"], digest(words[x["ref_at"] & NUMBER :][: x["words"]])) for x in asked]
        if made:
            row, at, n, d = zip(*made)
            yield _batch("ref_row ref_at words digest", row, at, n, pa.array(d, pa.binary()))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((a, e))
    return out


def keyed(docs: DataFrame, id_col: str, text: str, more: list[str]) -> DataFrame:
    """(__row, __tag, __keep, __text): the row's hashes, the columns id and more as c0, c1, ..., and the text in UTF-8."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([id_col, *more])])
    own = F.col(f"`{id_col}`")
    return docs.select(F.xxhash64(own, t).alias("__row"), F.shiftrightunsigned(F.xxhash64(F.lit("tag"), own, t), 64 - 34).alias("__tag"), keep.alias("__keep"), t.cast("binary").alias("__text"))


def factors_of(rows: DataFrame) -> DataFrame:
    """FACTORS of all rows that have some, with the digest of the words at the reference; rows: keyed(). Every step takes
    all its columns, so that Spark can use one exchange of the texts for them all."""
    n = shuffle_partitions(rows.sparkSession)
    spread = F.when(F.col("at").bitwiseAND(FLAG) > 0, F.col("row")).otherwise(0)  # the known need not meet
    found = rows.mapInArrow(_emit_anchors, "h long, row long, at long").repartition(n, "h", spread).sortWithinPartitions("h")
    found = found.mapInArrow(_shared_anchors, "h long, row long, at long")
    # the hottest anchors only spread their rows, so this choice changes no result; others have at most a share of
    # 1 / MOST_HOT of all places each
    hot = found.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT).orderBy(F.desc("m"), "h").limit(MOST_HOT)
    hot = F.broadcast(hot.select("h", F.lit(FLAG).cast("long").alias("flag")))  # MOST_HOT rows at most
    tag = F.shiftright("at", TAG).alias("tag")
    shared = found.join(hot, "h", "left").select("row", tag, (F.col("at").bitwiseAND(NUMBER) + F.coalesce("flag", F.lit(0))).alias("at"))
    shared = shared.groupBy("row", "tag").agg(F.collect_list("at").alias("shared"))  # no more than a text has words
    here = (F.col("__row") == F.col("row")) & (F.col("__tag") == F.col("tag"))
    windows = rows.join(shared, here).mapInArrow(_emit_windows, "h long, row long, at long, hashes binary")
    matches = windows.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_matches, MATCHES)
    matches = matches.groupBy("row", tag).agg(F.collect_list(F.struct("at", "n", "ref_row", "ref_at")).alias("m"))
    factors = matches.mapInArrow(_parse_all, FACTORS)
    asked = factors.select("ref_row", "ref_at", "words").distinct()
    asked = asked.groupBy(F.col("ref_row").alias("row"), F.shiftright("ref_at", TAG).alias("tag")).agg(F.collect_list(F.struct("ref_at", "words")).alias("asked"))
    there = rows.join(asked, here).mapInArrow(_digests, "ref_row long, ref_at long, words long, digest binary")
    # rows that are equal in id and text have one key and equal digests
    there = there.groupBy("ref_row", "ref_at", "words").agg(F.first("digest").alias("digest"))
    return factors.join(there, ["ref_row", "ref_at", "words"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row's id, n_words, n_removed, kept_sha256, and its duplicate spans as word offsets [start, end) with the
    reference (row, place) that the span's first factor points at. With `keep` (other columns) also those and the kept
    text, in columns whose names cannot clash: keep (struct: c0 the id, c1 and so on the columns), kept_text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, id_col, text, keep or [])
    rows = rows.repartition(shuffle_partitions(spark), "__row", "__tag")  # one exchange serves all joins
    factors = factors_of(rows).groupBy("row", "tag").agg(F.collect_list(F.struct("start", "words", "ref_row", "ref_at", "digest")).alias("factors"))
    joined = rows.join(factors, (F.col("__row") == F.col("row")) & (F.col("__tag") == F.col("tag")), "left").select("__keep", "__text", "factors")
    whole = keep is not None
    ddl = f"keep {joined.schema['__keep'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, spans array<array<bigint>>" + ", kept_text string" * whole

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, factors in zip(b.column(1), b.column(2)):
                data, factors = data.as_buffer().to_pybytes(), factors.as_py() or []
                words = data.split()
                true = sorted((f["start"], f["start"] + f["words"], f["ref_row"], f["ref_at"]) for f in factors if digest(words[f["start"] :][: f["words"]]) == f["digest"])
                spans = union([f[:2] for f in true])
                refs = {f[0]: f[2:] for f in reversed(true)}
                left, done = [], 0
                for a, e in spans:
                    left += words[done:a]
                    done = e
                left += words[done:]
                kept = b" ".join(left)
                row = len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), [[a, e, *refs[a]] for a, e in spans]
                out.append((*row, (kept if spans else data).decode()) if whole else row)
            i = pa.int64()
            kinds = [i, i, pa.string(), pa.list_(pa.list_(i))] + [pa.string()] * whole
            cols = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["keep", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"][: 1 + len(kinds)])

    made = joined.mapInArrow(apply, ddl)
    return made if whole else made.select(F.col("keep.c0").alias(id_col), "n_words", "n_removed", "kept_sha256", "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their texts cut: words of repeated windows go, and rows of which nothing is left."""
    rest = [c for c in docs.columns if c != text]
    cut = substring_dedup(docs, id_col, text, rest).where("n_removed = 0 or n_removed < n_words")
    return cut.select(*[F.col("kept_text").alias(c) if c == text else F.col("keep")[f"c{1 + rest.index(c)}"].alias(c) for c in docs.columns])
