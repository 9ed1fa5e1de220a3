from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from guardrail_spark.llm import packing
from guardrail_spark.llm.queries import QUERIES, TOKENIZERS, VOCABULARY

PATH = f"{TOKENIZERS}/{VOCABULARY}"
ODD = [None, "", " \n\t ", "a", "word " * 9, "x" * 3000, "né à 日本語 \u0085   y", "same", "same", "ÉTÉ!? été.", "ΣΑΣ. it's I'LL, <|endoftext|>ok", "a\x1cb́ ́c ½² 10.5% --x", "İx İx. ǅ! ß? ſt"]
LONG = " ".join(f"w{i % 977} Token{i}." for i in range(9_000))


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected_pieces(tok, text, capacity):
    ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
    cut = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
    return [(n, n * capacity, len(c), zlib.crc32(array("I", c).tobytes())) for n, c in enumerate(cut)]


def check(rows, capacity):
    """Sequences are gapless and within capacity; gives how many there are."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_sequences(spark):
    texts = [*ODD, LONG, *["copy of a text"] * 300]
    df = spark.createDataFrame([(None if i == 3 else i % 50, t, 5, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, piece int, row string, __id string")
    out = packing.packing(df, PATH, capacity=100)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows, tok = out.collect(), tokenizer()
    want = sorted((str(None if i == 3 else i % 50), *p) for i, t in enumerate(texts) for p in expected_pieces(tok, t, 100))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    assert check(rows, 100) <= -(-total // 100) + 1
    assert packing.packing(df.where("false"), PATH).collect() == []


def test_slices_do_not_change_ids(monkeypatch):
    whole = list(packing.pieces_of(packing.WordEncoder(PATH), LONG.encode(), 4096, 1))
    monkeypatch.setattr(packing, "SLICE", 1000)
    monkeypatch.setattr(packing, "MAX_WORDS", 50)
    assert list(packing.pieces_of(packing.WordEncoder(PATH), LONG.encode(), 4096, 1)) == whole
    assert [len(p) // 4 for p in whole[:-1]] == [4096] * (len(whole) - 1)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aÉßſİΣ'’.!?,;: \n\t́\u0085#<|>1½"), st.characters(codec="utf-8")), max_size=40))
def test_words_have_the_librarys_ids(text):
    own = packing.word_encoder(PATH)
    assert b"".join(own.encode(text.encode())) == array("I", own.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def squares(open_gaps):
    return sum(open_gaps.count(g) ** 2 for g in set(open_gaps))


@pytest.mark.parametrize("seed", range(6))
def test_each_piece_goes_where_the_sum_of_squares_is_least(seed):
    rng, capacity = random.Random(seed), 30
    lengths = [rng.randrange(1, capacity) for _ in range(200)]
    if seed % 2:
        lengths.sort(reverse=True)
    free: list[int] = []
    for size, at in zip(lengths, packing.sum_of_squares(lengths, capacity)):
        sums = {}
        for i, g in [*enumerate(free), (len(free), capacity)]:
            if g >= size:
                after = [*free[:i], g - size, *free[i + 1 :]]
                sums.setdefault((squares([x for x in after if x]), g), []).append(i)
        assert at in sums[min(sums)]
        if at == len(free):
            free.append(capacity)
        free[at] -= size


def test_rounds_repack_what_shards_leave_open(spark):
    rng = random.Random(4)
    lengths = [rng.randrange(1, 100) for _ in range(3000)]
    made = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], "__id long, piece int, start long, length long, ids_crc32 long, row long")
    rows = packing.pack_pieces(made, capacity=100, shard=200, slack=0).collect()
    assert sorted(r.row for r in rows) == list(range(3000))
    at_once = max(packing.sum_of_squares(sorted(lengths, reverse=True), 100)) + 1
    assert check(rows, 100) <= 1.005 * at_once


def test_pieces_that_never_fit_together_end_the_rounds(spark):
    made = spark.createDataFrame([(i, 0, 0, 60, 0, i) for i in range(500)], "__id long, piece int, start long, length long, ids_crc32 long, row long")
    assert check(packing.pack_pieces(made, capacity=100, shard=50).collect(), 100) == 500


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows, tok = QUERIES["op13_packing"](spark, sf).collect(), tokenizer()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((d.doc_id, *p) for d in docs for p in expected_pieces(tok, d.text, 4096))
    assert check(rows, 4096) <= 1.005 * sum(r.length for r in rows) / 4096 + 1
