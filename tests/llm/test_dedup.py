from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guardrail_spark.llm import neardup, substring
from guardrail_spark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def brute_substring(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


PASSAGE, LONG = prose(1, 60), prose(2, 900)
CASES = {
    "odd": [None, "", " \n", "one", "x " * 34, "y " * 35, "z " * 36, "é" * 9000],
    "copies": [" ".join(LONG)] * 3 + ["\n".join(LONG)],
    "passages": [" ".join(prose(i, 50) + PASSAGE + prose(i + 50, 40)) for i in range(9)],
    "edges": [" ".join(PASSAGE[:35]), " ".join(PASSAGE[1:36]), " ".join(PASSAGE[:34] + ["q"]), " ".join(["q"] + PASSAGE[:36])],
    "repeats": [" ".join(prose(5, 40) * 4), " ".join(["a", "b"] * 100), " ".join(prose(6, 400) + prose(7, 36) + prose(8, 20) + prose(7, 36))],
    "overlaps": [" ".join(LONG[i : i + 80]) for i in range(0, 800, 23)],
}


@pytest.mark.parametrize("name", CASES)
def test_substring_equals_brute_force(spark, name):
    texts = CASES[name]
    df = spark.createDataFrame([(i if i % 5 else None, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, at int")
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df.repartition(3)).collect())
    assert got == sorted(brute_substring(texts))


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_all_cases_at_once(spark, monkeypatch, hot):
    """Also with every anchor hot: each window goes its own way."""
    monkeypatch.setattr(substring, "HOT", hot)
    texts = [t for c in CASES.values() for t in c]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring.substring_dedup(df, keep=[]).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in rows) == sorted(brute_substring(texts))
    for r in rows:
        assert r.n_removed == sum(e - s for s, e, *_ in r.spans)
    assert substring.substring_dedup(df.limit(0)).count() == 0


def test_factors_point_at_equal_words(spark):
    texts = [" ".join(prose(i, 30) + PASSAGE + prose(i + 9, 30)) for i in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {(r["__row"], r["__tag"]): r["__keep"].c0 for r in substring.keyed(df, "doc_id", "text", []).collect()}
    words = [t.split() for t in texts]
    for r in substring.substring_dedup(df).collect():
        ((start, end, ref, at),) = r.spans
        assert (start, end) == (30, 90)
        other, at = keys[ref, at >> substring.TAG], at & substring.NUMBER
        assert (other, at) != (r.doc_id, start) and words[r.doc_id][start:end] == words[other][at : at + end - start]


def test_parse_is_greedy():
    """The longest reference first; what it can't take begins the next factor, 34 words before its end."""
    match = lambda at, n, row, ref: {"at": at, "n": n, "ref_row": row, "ref_at": ref}
    got = substring.parse([match(10, 5, 1, 100), match(15, 5, 1, 105), match(10, 4, 2, 50), match(18, 6, 3, 7), match(40, 1, 2, 80)])
    assert got == [(10, 44, 1, 100), (20, 38, 3, 9), (40, 35, 2, 80)]
    assert substring.parse([]) == []


def brute_factors(words, others, window=35):
    """Greedy relative Lempel-Ziv by comparing words with every place of every other text."""
    out, at = [], 0
    while at + window <= len(words):
        best = 0
        for o in others:
            for q in range(len(o) - window + 1):
                n = 0
                while at + n < len(words) and q + n < len(o) and words[at + n] == o[q + n]:
                    n += 1
                best = max(best, n)
        if best >= window:
            out.append((at, best))
            at += best - window + 1
        else:
            at += 1
    return out


def test_factors_equal_a_word_by_word_parse(spark):
    """One text made of pieces of two others, with seams at which a window lies in neither."""
    one, two = prose(21, 150), prose(22, 150)
    mixed = one[10:80] + two[30:100] + ["x"] + one[90:140] + two[60:99]
    df = spark.createDataFrame([(0, " ".join(one)), (1, " ".join(two)), (2, " ".join(mixed))], "doc_id long, text string")
    rows = substring.keyed(df, "doc_id", "text", []).repartition(2, "__row", "__tag")
    names = {r["__row"]: r["__keep"].c0 for r in rows.collect()}
    got = sorted((r.start, r.words) for r in substring.factors_of(rows).collect() if names[r.row] == 2)
    assert got == brute_factors(mixed, [one, two])


def test_factors_whose_words_differ_are_left(spark, monkeypatch):
    """Windows that only seem equal: a digest at the reference that is not the text's own drops the factor."""
    df = spark.createDataFrame([(0, " ".join(PASSAGE)), (1, " ".join(PASSAGE))], "doc_id long, text string")
    true = substring.factors_of
    monkeypatch.setattr(substring, "factors_of", lambda rows: true(rows).withColumn("digest", F.lit(b"other")))
    assert [r.n_removed for r in substring.substring_dedup(df).collect()] == [0, 0]


def test_substring_clashing_columns(spark):
    names = ["score", "n_words", "spans", "factors", "kept", "kept_text", "keep", "row", "tag", "__row", "c0"]
    df = spark.createDataFrame([(i, " ".join(prose(50 + i, 40) + PASSAGE), *range(len(names))) for i in range(2)], ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in names)]))
    got = substring.without_repeats(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(i, " ".join(prose(50 + i, 40))) for i in range(2)]


def shingles(text, size):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_near(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(least[find(i)], default=None)
        out.append((d, len(sets[i]), c, d == c if c is not None and d is not None else c is None))
    return sorted(out, key=str)


def near_rows():
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, "   "), (3, "a"), (4, "A"), (5, "a b"), (6, "b a"), (None, "null id text here"), (None, "null id text here"), (None, None)]
    base = [prose(100 + k, rng.choice([12, 60, 300])) for k in range(8)]
    n = 10
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, " ".join(base[0])) for i in range(5)] + [(7, " ".join(base[1])), (7, " ".join(base[2])), (999, "long " * 20_000)]
    return rows


@pytest.mark.parametrize(("size", "percent", "piece"), [(3, 85, 1024), (5, 80, 1024), (3, 85, 4)])
def test_near_equals_brute_force(spark, monkeypatch, size, percent, piece):
    monkeypatch.setattr(neardup, "PIECE", piece)
    monkeypatch.setattr(neardup, "REGION", piece)
    rows = near_rows()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, k string, sig int")
    got = sorted((tuple(r) for r in neardup.near_dedup(df.repartition(4), size, percent).collect()), key=str)
    assert got == brute_near(rows, size, percent)


@pytest.mark.parametrize("piece", [1024, 64])
def test_candidates_hidden_in_a_dense_region(spark, monkeypatch, piece):
    """Signatures of a template: all share the first hashes of every tree; pairs agree beyond, but not in sorted order.
    A region that fits is compared whole; one that is cut is named, for the exact search."""
    monkeypatch.setattr(neardup, "PIECE", piece)
    monkeypatch.setattr(neardup, "REGION", piece)
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 1 << 16, (400, neardup.TREES, neardup.DEPTH)).astype(np.uint16)
    sigs[:, :, : neardup.MIN_DEPTH] = 7
    sigs[20:40, :, neardup.MIN_DEPTH + 1 :] = sigs[:20, :, neardup.MIN_DEPTH + 1 :]
    df = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sigs)], "k long, sig binary")
    links, dense = neardup.candidate_links(df, neardup.least_agreement(0.85))
    if piece == 1024:
        assert {tuple(r) for r in links.collect()} == {(i, i + 20) for i in range(20)} and dense is None
    else:
        assert {r.k for r in dense.collect()} == set(range(400))


def templated(n, template=60, own=60):
    """Texts of one template with words of their own: any two agree on about a third to a half of their shingles. Every
    tenth text has a partner that differs in one word."""
    base, rows = prose(77, template), []
    for i in range(n):
        words = base[: template // 2] + [f"own{i}x{j}" for j in range(own)] + base[template // 2 :]
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((n + i, " ".join(words[:5] + ["changed"] + words[6:])))
    return rows


@pytest.mark.parametrize("own", [60, 8])
def test_dense_region_loses_no_link(spark, monkeypatch, own):
    """Recall against all rows, for ids divisible by 50 and for all others: whole. With 8 words of their own the texts lie
    just below the threshold, so whole clusters have no true link but those of the hidden pairs."""
    monkeypatch.setattr(neardup, "PIECE", 16)
    monkeypatch.setattr(neardup, "REGION", 16)
    rows = templated(300, own=own)
    got = sorted((tuple(r) for r in neardup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=str)
    want = brute_near(rows, 3, 85)
    asked = [r for r in want if r[0] % 50 == 0]
    assert sum(r in got for r in asked) / len(asked) >= 0.9
    assert got == want


def test_prefix_filter_is_exact(spark):
    """Without any link to begin with, the exact search alone finds the components of all pairs."""
    rows = [(k, t) for k, (d, t) in enumerate(near_rows()) if t and t.split()]
    seen, classes = set(), []
    for k, t in rows:
        s = neardup.shingle_set(t.encode(), 3)
        if s.tobytes() not in seen:
            seen.add(s.tobytes())
            classes.append((k, bytearray(neardup.signature(s).tobytes()), t))
    reps = spark.createDataFrame(classes, "k long, sig binary, text string")
    links = neardup.parted_links(reps.select("k", "sig"), reps.select("k", "text"), reps.selectExpr("k", "k AS label"), 3, 85)
    found = {tuple(r) for r in links.collect()}
    sets = {k: shingles(t, 3) for k, _, t in classes}
    assert found == {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}


def test_near_spots_stay_bounded(spark, monkeypatch):
    """A large group of which no two have one label: all ask, and no spot grows with it."""
    monkeypatch.setattr(neardup, "PIECE", 16)
    rows = spark.createDataFrame([(0, k, k) for k in range(400)], "h long, k long, label long")
    spots = neardup._blocks(rows, "h", "label").groupBy("spot").agg(F.collect_list(F.struct("asks", "k")).alias("met")).collect()
    assert max(len(r.met) for r in spots) <= 6 * 16
    met = {frozenset((a.k, b.k)) for r in spots for a in r.met if a.asks for b in r.met}
    assert all(frozenset((a, b)) in met for a in range(400) for b in range(a))


def joined_rows(spark, run):
    """What run gives, and the rows that joins over the classes made for it."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out, made = store.executionsCount(), run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executions = store.executionsList()
    for i in range(before, executions.size()):
        at = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = node.metrics()
            for m in map(metrics.apply, range(metrics.size())):
                if "Join" in node.name() and "[k#" in node.desc() and m.name() == "number of output rows":
                    made += int(str(values.get(m.accumulatorId()).getOrElse(None) or 0).replace(",", "")) if values.contains(m.accumulatorId()) else 0
    return out, made


def test_joins_of_the_exact_search_grow_with_the_sets(spark, monkeypatch):
    """Texts just below the threshold that share their listed shingles: twice the texts, twice the rows of joins, however
    many blocks the rows are copied to."""
    monkeypatch.setattr(neardup, "PIECE", 16)
    made = []
    for n in (100, 200):
        rows = templated(n, own=4)
        reps = spark.createDataFrame([(k, bytearray(neardup.signature(neardup.shingle_set(t.encode(), 3)).tobytes()), t) for k, t in rows], "k long, sig binary, text string")
        find = lambda: neardup.parted_links(reps.select("k", "sig"), reps.select("k", "text"), reps.selectExpr("k", "k AS label"), 3, 85).collect()  # noqa: B023, E731
        links, joined = joined_rows(spark, find)
        assert {tuple(r) for r in links} == {(i, n + i) for i in range(0, n, 10)}
        made.append(joined)
    assert 0 < made[0] and made[1] < 2.6 * made[0], made


@pytest.mark.parametrize("few", [True, False])
def test_few_pairs_join_the_labels_of_a_spot(few):
    """Of equal signatures few pairs join all labels; a search for all pairs takes each once."""
    n = 60
    columns = {"spot": [0] * n, "k": list(range(n)), "label": [k // 2 for k in range(n)], "asks": [True] * n, "n": [100] * n, "at": [0] * n, "sig": [bytes(2 * neardup.HASHES)] * n}
    found = [p for b in neardup._meet(85, neardup.least_agreement(0.85), few)([pa.RecordBatch.from_pydict(columns)]) for p in zip(*b.to_pydict().values())]
    label = list(range(n))
    for a, b in [*found, *((k, k + 1) for k in range(0, n, 2))]:
        label = [label[a] if x == label[b] else x for x in label]
    assert len(set(label)) == 1 and len(found) == len(set(found))
    assert len(found) == (n // 2 - 1 if few else n * (n - 1) // 2 - n // 2)


@pytest.mark.parametrize("columns", ["doc_id long, text string, row string, k long, id long, sig long, first long"])
def test_one_of_each(spark, columns):
    rows = [(7, "a b c d e f"), (7, "quite another text under this id"), (8, "a b c d e f"), (None, "a b c d e f"), (None, "only here"), (None, "only here"), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "r", 1, 2, 3, 4) for i, t in rows], columns)
    got = neardup.one_of_each(df, 3, 85)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[6], rows[7]], key=str)


def test_near_empty(spark):
    assert neardup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90, 500: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
