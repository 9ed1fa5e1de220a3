from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from guardrail_spark.llm import bpe, toxicity
from guardrail_spark.llm.common import settled

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against a plain version over what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-dedup", "substring dedup", "mixing", "bpe"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    clean = settled(stages["toxicity"](spark, docs, SF))
    model = toxicity.fit(docs, labels, ~F.expr(toxicity.held_out_rule()))
    bad = {r.doc_id for r in toxicity.score_texts(docs, model).where(F.col("score") >= toxicity.THRESHOLD).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad and clean.columns == docs.columns

    one = settled(stages["near-dedup"](spark, clean, SF))
    rows = clean.collect()
    sets = {r.doc_id: {tuple(r.text.lower().split()[i : i + 5]) for i in range(max(1, len(r.text.split()) - 4))} for r in rows}
    group = {d: d for d in sets}
    ids = sorted(sets)
    for _ in range(4):
        for a in ids:
            for b in ids:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert {r.doc_id for r in one.collect()} == set(group.values())

    cut = settled(stages["substring dedup"](spark, one, SF))
    windows = Counter()
    for r in one.collect():
        w = r.text.split()
        windows.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    left = {r.doc_id: r.text for r in cut.collect()}
    for r in one.collect():
        w = r.text.split()
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        rest = [x for j, x in enumerate(w) if j not in gone]
        if gone and not rest:
            assert r.doc_id not in left
        else:
            assert left[r.doc_id] == (" ".join(rest) if gone else r.text)
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0

    mixed = settled(stages["mixing"](spark, cut, SF))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(left)

    encoder = bpe.Encoder(f"{corpus_pipeline.TOKENIZERS}/{corpus_pipeline.VOCABULARY}")
    text = {r.doc_id: r.text for r in mixed.collect()}
    last = stages["bpe"](spark, mixed, SF).collect()
    assert len(last) == len(text)
    for r in last:
        assert r.n_tokens == len(encoder.tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids)


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == ["1", "2", "None"]
    (tmp_path / "e").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "e" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
