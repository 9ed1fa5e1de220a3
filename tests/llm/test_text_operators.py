from __future__ import annotations

import hashlib
import json
import random
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardrail_spark.llm import chat, licenses, mixing, toxicity, urls
from guardrail_spark.llm.queries import INJECTED, RULES

SF = "/root/testdata/sf0.01"


# chat


def test_fingerprints(spark):
    df = spark.createDataFrame([], "messages array<struct<role:string,content:string>>")
    assert chat.REGISTRY[chat.schema_fingerprint(df.schema)].name == "messages"
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", None)]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [("user", "q"), ("assistant", "r")]),
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"response": "r", "prompt": "p"}, [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"unknown": 1}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(records)], "id int, record string")
    got: dict = {}
    for r in chat.turns_of_records(df, "record", "id").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: t if t else [(None, None)] for i, (_, t) in enumerate(records)}


def test_tables_of_several_layouts(spark):
    df = spark.createDataFrame([(7, "p", "r", 1)], "id int, prompt string, response string, extra int")
    assert [(r.conv_id, r.turn, r.role, r.text) for r in chat.turns_of_table(df, "id", ("extra",)).collect()] == [(7, 0, "user", "p"), (7, 1, "assistant", "r")]
    with pytest.raises(ValueError):
        chat.turns_of_table(df, "id")


def test_format_round_trip(spark):
    nasty = [INJECTED, "", None, "\\", "\\\\<|", "<", "<|", "\\<\\|", "x\ny", "<|im_sep|>", "é🙂<", "|im_end|>", "$1 \\1"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "only"), (None, 0, None, None), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (3, None, "system", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_turns(df)
    text = {r.conv_id: r for r in made.collect()}
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for conv in (1, 2, None, 3):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1:]))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(text[conv].formatted)
        assert text[conv].formatted.count("<|im_start|>") == len(turns)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# toxicity


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), ~F.expr(toxicity.held_out_rule()))


@pytest.mark.parametrize(("seen", "meant"), [("idi0t", "idiot"), ("l0ser", "loser"), ("tr@sh", "trash"), ("looooser", "loser"), ("stup1d", "stupid"), ("s.c.u.m", "scum"), ("i d i o t", "idiot"), ("thereading", "thereading")])
def test_decoding(model, seen, meant):
    assert toxicity.decode(seen, model.trigrams) == meant


def test_hidden_words_score_like_plain_ones(spark, model):
    texts = ["you idiot", "you 1d10t", "you i d i o t", "you I-D-I-O-T !", "you idiiiiot", "hello there", "", None, "h0use 1000 $5", "idiot " + "the ering of " * 40_000]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = [r.score for r in toxicity.score_texts(df, model).collect()]
    assert all(s >= toxicity.THRESHOLD for s in [*got[:5], got[9]]) and all(s < toxicity.THRESHOLD for s in got[5:9])
    assert all(0 <= s <= 1 for s in got)
    assert "idiot" in toxicity.restore(df, model).collect()[2].restored


def test_hidden_beginnings_and_words_in_runs_score(spark, model):
    texts = ["you $tupid", "you !diot", "you |oser", "a l o s e r", "y o u i d i o t", "i  d  i  o  t", "so great! $5 |x|"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in toxicity.score_texts(df, model).collect()]
    assert [s >= toxicity.THRESHOLD for s in got] == [True] * 6 + [False]


def test_words_labelled_only_when_hidden_are_learnt(spark):
    plain = [(i, f"the story number w{i} of a zorgle garden and q{i}", 0) for i in range(300)]
    rows = [(1000 + i, f"z0rgl3 said k{i} to m{i} on n{i}", 1) for i in range(40)] + [(2000 + i, f"nice v{i} to r{i} on s{i}", 0) for i in range(40)]
    schema = "doc_id long, text string, toxic int"
    model = toxicity.fit(spark.createDataFrame(plain + rows, schema), spark.createDataFrame(rows, schema))
    assert any(f.startswith(b"zorg") for f in model.precision)


def test_pruning_reaches_all_paths(model):
    """Every path of a lattice collapses to the observed word's key."""
    rng = random.Random(5)
    for _ in range(300):
        word = rng.choice(["idiot", "loser", "trash", "scum", "hello", "bookkeeper"])
        seen = ""
        for c in word:
            alike = [k for k, v in toxicity.ALIKE.items() if c in v]
            seen += (rng.choice(alike) if alike and rng.random() < 0.4 else c) * rng.choice([1, 1, 1, 3]) + rng.choice(["", "", "", "."])
        assert toxicity.collapsed(seen.encode()) == toxicity.collapsed(word.encode())


def lattice_paths(word, model, spelt=False):
    """(score, made) of every path through a word's lattice."""
    import math

    same, alike, again, gap = (math.log(p) for p in (toxicity.P_SAME, toxicity.P_ALIKE, toxicity.P_AGAIN, toxicity.P_GAP))
    symbol = lambda c: int(toxicity.SYMBOL[c.encode()[0]])

    def go(i, a, b, last, score, made):
        if i == len(word):
            yield score + float(model[a, b, 0]), made
            return
        ch = word[i]
        letters = [(ch, same - math.log(toxicity.SHARE.get(symbol(ch), 1)))] + [(x, alike) for x in toxicity.ALIKE.get(ch, "")]
        moved = False
        if last and (last == ch or last in toxicity.ALIKE.get(ch, "")):
            yield from go(i + 1, a, b, last, score + again, made)
            moved = True
        if ch in toxicity.SEPARATORS and made:
            yield from go(i + 1, a, b, last, score + gap, made)
            moved = True
            if spelt and last:
                yield from go(i + 1, b, 0, "", score + gap + float(model[a, b, 0]), made + " ")
        if ch != " ":
            for x, cost in letters:
                yield from go(i + 1, b, symbol(x), x, score + cost + float(model[a, b, symbol(x)]), made + x)
        elif not moved:
            yield from go(i + 1, a, b, last, score, made)

    yield from go(0, 0, 0, "", 0.0, "")


@pytest.mark.parametrize("word", ["1d10t", "l0ser", "tr@sh", "looser", "s.c.u.m", "$tupid", "b00k", "a-b", "né0", "!!i1", "7h3", "x+7"])
def test_viterbi_equals_all_paths(model, word):
    paths = list(lattice_paths(word, model.trigrams))
    best = max(s for s, _ in paths)
    made = toxicity.decode(word, model.trigrams)
    assert max(s for s, m in paths if m == made) == pytest.approx(best, abs=1e-4)


@pytest.mark.parametrize("run", ["i d i o t", "u a l o", "a.b c"])
def test_viterbi_of_spelt_runs_equals_all_paths(model, run):
    paths = list(lattice_paths(run, model.trigrams, True))
    best = max(s for s, _ in paths)
    made = toxicity.decode(run, model.trigrams, True)
    assert max(s for s, m in paths if m == made) == pytest.approx(best, abs=1e-4)


def test_repeated_rows_and_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "you idiot", 1, 2, 3), (1, "you idiot", 1, 2, 3), (2, "good day", 1, 2, 3), (2, "good day", 1, 2, 3), (None, None, 1, 2, 3)], "doc_id long, text string, score int, `__text` int, c0 int")
    assert sorted((str(r.doc_id), r.score >= toxicity.THRESHOLD) for r in toxicity.score_texts(df, model).collect()) == [("1", True), ("1", True), ("2", False), ("2", False), ("None", False)]
    got = toxicity.without_toxic(df, model)
    assert got.columns == df.columns and sorted(str(tuple(r)) for r in got.collect()) == sorted(str(x) for x in [(2, "good day", 1, 2, 3)] * 2 + [(None, None, 1, 2, 3)])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.5 * sum(r.toxic for r in rows)
    none = toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()
    assert [r.predicted for r in none] == [0] * 5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


# urls


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_equal_brute_force(spark):
    rng = random.Random(9)
    hosts = ["org", "example.org", "a.example.org", "EXAMPLE.org", "xexample.org", "example.orgs", "com", "b.com", "net", "", "a..b", "müller.com"]
    paths = ["", "/", "/es/", "/en/1", "/en/12?x=/fr/", "/fr/é", "/de/#a", "/fr", "//es/"]
    pages = [(i % 50, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}", "h") for i in range(600)]
    pages += [(None, None, None), (None, None, None), (1, "no scheme", ""), (1, "://", ""), (2, "a://b://c/d", "")] + [(3, "http://example.org/es/", "")] * 40
    rules = [*RULES, ("example.org", "", "block"), ("a.example.org", "/", "allow"), ("b.com", "/fr/", "allow"), ("b.com", "/fr/", "block")]
    for rs in (rules, list(RULES), []):
        df = spark.createDataFrame(pages, "page_id long, url string, host string")
        got = urls.filter_urls(df, spark.createDataFrame(rs, "host string, path string, verdict string"))
        best: dict = {}  # of equal keys block wins
        for h, p, v in rs:
            best[h, p] = max(v, best.get((h, p), ""))
        expected = [(i, *brute_rule(u, [(h, p, v) for (h, p), v in best.items()])) for i, u, _ in pages]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))


def test_unknown_records_are_listed(spark):
    texts = [
        '{"messages": [{"role": "user", "content": "a", "name": "x"}]}', '{"messages": [{"role": "user", "content": "b"}]}', '{"messages": [{"role": "user", "content": "c", "odd": 1}]}',
        "{broken", None, '{"messages": []}', '{"prompt": "p", "response": "r"}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, record string")
    unknown = {r.conv_id: r.json for r in chat.unknown_records(df, "record", "id").collect()}
    assert unknown == {i: texts[i] for i in (3, 4, 5)}
    turns = {(r.conv_id, r.role, r.text) for r in chat.turns_of_records(df, "record", "id").collect() if r.role}
    assert turns == {(0, "user", "a"), (1, "user", "b"), (2, "user", "c"), (6, "user", "p"), (6, "assistant", "r")}
    assert chat.unknown_records(df.limit(0), "record", "id").count() == 0


# licenses


def test_licenses(spark):
    texts = [
        None, "", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "apache   LICENSE mit-license General Public License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files, to deal in the Software without restriction",
        "license license license", "Licensed under the", "word " * 30_000 + "licensed under cc by nc 4 0", "licensed under cc by nc 4 0 and then other words come here licensed under cc by nc 4 0",
    ]
    df = spark.createDataFrame([(i if i % 4 else None, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = licenses.scan_licenses(df.coalesce(1)).collect()
    by = sorted(got, key=lambda r: (r.n_words, r.labels))
    assert len(got) == len(texts)
    named = {r.n_words: r for r in got}
    assert (named[5].n_base, named[5].first_word, named[5].base_labels, named[5].labels) == (1, 3, "mit", "mit,mit-notice")
    assert (named[7].n_base, named[7].labels, named[7].first_word) == (3, "apache,gpl,mit", 0) if named[7].n_base else named[7].labels == "cc-by-nc-4.0"
    assert any(r.labels == "mit-notice" and r.n_base == 0 and 0.6 <= r.score <= 1 for r in got)
    assert named[30_007].labels == "cc-by-nc-4.0" and [(s.start, s.end) for s in named[30_007].spans] == [(30_000, 30_007)]
    assert [len(r.spans) for r in got if r.n_words == 20] == [2]
    assert by[0].labels == "" and by[0].score == 0 and by[0].first_word is None
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licenses_equal_sql(spark):
    """Whole texts with words changed, left out and put in, odd letters, repeats and overlaps, against DuckDB."""
    import duckdb

    from guardrail_spark.llm.queries import ORACLES

    rng = np.random.default_rng(7)
    texts = [None, "", "released under the \u212aMIT license", "\u0130 MIT L\u0130CENSE mit license", "released under the mit " * 40, "the mit license released under " * 9]
    for _, words in licenses.TEMPLATES:
        words = words.split()
        texts.append("x " * 5 + " ".join(words).upper() + " y")
        for share in (0.05, 0.2, 0.4):
            noisy = [w for w in words if rng.random() > share / 2]
            noisy = [w if rng.random() > share / 2 else "other" for w in noisy]
            texts.append(" ".join(["new"] * int(rng.integers(0, 4)) + noisy[: len(noisy) // 2] + ["put in"] * int(rng.integers(0, 3)) + noisy[len(noisy) // 2 :] + noisy[:9]))
    texts += [" ".join(w for _, w in licenses.TEMPLATES)] * 2
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    documents = df.toPandas()
    with duckdb.connect() as db:
        db.register("documents", documents)
        want = db.execute(ORACLES["op10_licenses"]).fetchall()
        names = [d[0] for d in db.description]
    got = licenses.scan_licenses(df).select(*names).collect()
    key = lambda r: tuple((x is None, x if not isinstance(x, float) else round(x, 9)) for x in r)
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)
    assert {label for r in got for label in r.labels.split(",")} >= {label for label, _ in licenses.TEMPLATES}


# mixing


def brute_rates(n, p, goal, most):
    """Rates of least squares by plain projected gradient steps, as many as it takes."""
    scale = np.linalg.inv((n[:, None] * p).T @ p)
    w = np.ones(len(n))
    for _ in range(20_000):
        w = np.clip(w - p @ (scale @ (((n * w)[:, None] * p).sum(0) - goal)), 0, most)
    return w


def test_rates_meet_what_brute_force_meets(spark):
    """Whatever targets plain steps meet in the end, the fit meets in a few, and it comes as near to the others."""
    rng = np.random.default_rng(4)
    n, low = rng.integers(0, 900, 300), rng.random(300)
    p = np.stack([low, 1 - low], 1)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n long, p array<double>").cache()
    has = (n[:, None] * p).sum(0)
    for targets, most, relative in (([0.2, 0.8], 1e9, False), ([0.8, 0.95], 1.0, True), ([0.6, 0.85], 1.0, True), ([3.0, 1.5], 3.0, True), ([0.5, 1.0], 1.0, True)):
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            errors = mixing.fit_rates(rows, targets, most, relative)
        said = [w for w in said if w.category is RuntimeWarning]
        goal = np.array(targets) * (has if relative else n.sum())
        off = lambda w: np.abs(((n * w)[:, None] * p).sum(0) - goal).max() / has.max()
        got, want = np.array([r.w for r in rows.select(mixing._rate(errors, 2, most).alias("w")).collect()]), brute_rates(n, p, goal, most)
        assert got.min() >= 0 and got.max() <= most
        if off(want) < 1e-5:
            assert off(got) < 1e-6 and len(errors) <= 12 and not said
        else:
            scale = np.linalg.inv((n[:, None] * p).T @ p)
            left = lambda w: (e := ((n * w)[:, None] * p).sum(0) - goal) @ scale @ e
            assert left(got) <= 1.05 * left(want) and "out of reach" in str(said[-1].message)


def test_a_domain_without_tokens_is_named(spark):
    rows = spark.createDataFrame([(100, [1.0, 0.0]), (50, [1.0, 0.0])], "n long, p array<double>")
    with pytest.warns(RuntimeWarning, match="without tokens"):
        errors = mixing.fit_rates(rows, [0.5, 0.5], 1.0, False)
    assert [round(r.w, 6) for r in rows.select(mixing._rate(errors, 2, 1.0).alias("w")).collect()] == [0.5, 0.5]


def test_a_fit_that_ends_by_its_steps_says_so(spark, monkeypatch):
    rows = spark.createDataFrame([(100, [0.9, 0.1]), (50, [0.2, 0.8]), (80, [0.6, 0.4]), (400, [0.3, 0.7]), (70, [0.05, 0.95])], "n long, p array<double>")
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.warns(RuntimeWarning, match="after 1 steps"):
        mixing.fit_rates(rows, [0.3, 0.7], 1.0, True)


def test_rates_meet_their_targets_closely(spark):
    n, p = np.array([100, 50, 80, 400]), np.array([[0.9, 0.1], [0.2, 0.8], [0.6, 0.4], [0.3, 0.7]])
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n long, p array<double>")
    goal = np.array([0.5, 0.6]) * (n[:, None] * p).sum(0)
    got = np.array([r.w for r in rows.select(mixing._rate(mixing.fit_rates(rows, [0.5, 0.6], 1.0, True), 2, 1.0).alias("w")).collect()])
    assert np.allclose(((n * got)[:, None] * p).sum(0), goal, rtol=1e-6)


def test_targets_out_of_reach_are_proved(spark):
    """No rates up to one can keep all of one domain and half of the other where all rows belong to both."""
    rows = spark.createDataFrame([(100, [0.5, 0.5]), (50, [0.4, 0.6]), (80, [0.6, 0.4])], "n long, p array<double>")
    with pytest.warns(RuntimeWarning, match="out of reach"):
        mixing.fit_rates(rows, [0.2, 1.0], 1.0, True)


def test_posteriors_equal_naive_bayes(spark):
    """The classifier against one written out; labels of a domain without a target don't count, repeated ones once."""
    rng = np.random.default_rng(6)
    x = rng.random((60, 7))
    y = rng.integers(0, 3, 60)
    rows = spark.createDataFrame([(i, int(100 * v[0]), [float(f) for f in v]) for i, v in enumerate(x)], "id long, n long, x array<double>")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)] * 2 + [(None, 1), (3, None)], "doc_id long, k int")
    domain = F.when(F.col("k") == 0, "low").when(F.col("k") == 1, "good").when(F.col("k") == 2, "other")
    model = mixing.fit_classifier(rows, labels, "doc_id", domain, ("low", "good"))
    want = np.zeros((60, 2))
    for k in range(2):
        own = x[y == k]
        var = np.maximum(own.var(0), mixing.LEAST_VARIANCE)
        want[:, k] = len(own) / (y < 2).sum() * np.exp(-((x - own.mean(0)) ** 2 / (2 * var)).sum(1)) / np.sqrt(var).prod()
    want /= want.sum(1, keepdims=True)
    got = np.array([r.p for r in mixing.posteriors(rows, model).orderBy("id").collect()])
    assert np.allclose(got, want)


def test_mixing_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = mixing.mix(docs, labels, mixing.TARGETS).collect()
    total = sum(r.n_tokens for r in rows)
    for d, t in mixing.TARGETS.items():
        assert sum(r.n_tokens * r[f"p_{d}"] * r.rate for r in rows) == pytest.approx(t * total, rel=0.01)
    assert all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "w " * 50_000)], "doc_id long, text string")
    assert len(mixing.mix(odd, labels, mixing.TARGETS).collect()) == 4
    assert [r.rate for r in mixing.mix(odd, labels.limit(0), mixing.TARGETS).collect()] == [1.0] * 4
    assert mixing.mix(odd.limit(0), labels, mixing.TARGETS).count() == 0
    clash = docs.selectExpr("doc_id", "text", "7 AS n", "'x' AS id", "'y' AS x", "'z' AS p", "'r' AS rate")
    kept = mixing.mixed_rows(clash, labels, {"low": 0.5, "good": 1.0})
    assert kept.columns == clash.columns
    assert {(r.n, r.id, r.x, r.p, r.rate) for r in kept.collect()} == {(7, "x", "y", "z", "r")}


def test_further_fields_at_any_depth_do_not_count(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","tool_calls":[{"name":"f","args":{"x":[1]}}]}],"meta":{"role":"x"}}',
        '{"prompt":"p","response":"r","score":{"content":1},"tags":["t"]}',
        '{"messages":[{"role":"user","text":"other"}]}', '{"messages":[]}', '{"prompt":"p","messages":[{"role":"user","content":"a"}]}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    turns: dict[int, list] = {}
    for r in chat.turns_of_records(df, "record", "id").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns[0] == [("user", "a"), ("assistant", "b")] and turns[1] == [("user", "p"), ("assistant", "r")]
    assert all(turns[i] == [(None, None)] for i in (2, 3, 4))
    assert sorted(r.conv_id for r in chat.unknown_records(df, "record", "id").collect()) == [2, 3, 4]
