from __future__ import annotations

import hashlib
import random
import zlib
from array import array
from collections import Counter

import pytest

from guardrail_spark.llm import bpe, media, quality
from guardrail_spark.llm.queries import TOKENIZERS, VOCABULARY

ODD = [None, "", " \n\t ", "a", "word " * 9, "x" * 30_000, "né à 日本語 \u0085   y", "same", "same", "# | &", "line one\nline one\n\nline one\n"]
LONG = " ".join(f"w{i % 977} token{i}" for i in range(20_000))


def frame(spark, texts, extra=False):
    rows = [(i if i != 3 else None, t, "src", 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, media int" if extra else "doc_id long, text string, source string, n_chars int")


def test_mux_round_trip():
    rng = random.Random(7)
    for n in [0, 1, 161, 162, 163, 345, 346, media.UNIT - 1, media.UNIT, media.UNIT + 1, 3 * media.UNIT + 500, 200_000]:
        payload = rng.randbytes(n)
        ts = media.mux(payload)
        s = media.demux(ts)
        assert len(ts) % 188 == 0 and s.payload == payload and not s.continuity_errors and not s.damaged
        assert s.programs == {1: media.PMT_PID} and s.pids == [media.MEDIA_PID]
        assert s.pts == [media.TICKS * k for k in range(-(-n // media.UNIT))]
        assert s.random_access == s.pts[:: media.RANDOM_ACCESS_EVERY]


def test_demux_of_damage():
    ts = bytearray(media.mux(b"x" * 5000))
    lost = bytes(ts[: 188 * 5] + ts[188 * 6 :])
    assert media.demux(lost).continuity_errors == 1
    ts[188 * 4] = 0
    assert media.demux(bytes(ts)).damaged >= 1
    assert media.demux(b"").packets == 0 and media.demux(b"junk" * 100).payload == b""


def packet(pid, counter, payload=b"", start=False, adaptation=None, head=0):
    """A transport packet by hand; short payloads are stuffed."""
    if adaptation is None and len(payload) < 184:
        n = 183 - len(payload)
        adaptation = b"\x00" + b"\xff" * (n - 1) if n else b""
    field = b"" if adaptation is None else bytes([len(adaptation)]) + adaptation
    control = (0x20 if adaptation is not None else 0) | (0x10 if payload else 0)
    made = bytes([0x47, head | (0x40 if start else 0) | pid >> 8, pid & 0xFF, control | counter & 15]) + field + payload
    assert len(made) == 188
    return made


def pes(payload, pts=None, size=None):
    timed = b"" if pts is None else media._pts_bytes(pts)
    head = bytes([0x80, 0x80 if timed else 0, len(timed)]) + timed
    return b"\x00\x00\x01\xbd" + (len(head) + len(payload) if size is None else size).to_bytes(2, "big") + head + payload


def test_packets_by_hand():
    ts = media.tables() + packet(0x100, 4, pes(b"one", 90_000), True) + packet(0x1FFF, 0, b"null" * 46) + packet(0x100, 5, pes(b"two"), True)
    s = media.demux(ts)
    assert (s.payload, s.pts, s.random_access, s.continuity_errors, s.damaged) == (b"onetwo", [90_000], [], 0, 0)
    twice = media.tables() + packet(0x100, 4, pes(b"one", 7), True) * 2 + packet(0x100, 5, pes(b"two"), True)
    assert (media.demux(twice).payload, media.demux(twice).continuity_errors) == (b"onetwo", 0)
    jump = media.tables() + packet(0x100, 4, pes(b"one"), True) + packet(0x100, 9, pes(b"two"), True)
    assert media.demux(jump).continuity_errors == 1
    told = media.tables() + packet(0x100, 4, pes(b"x" * 170), True) + packet(0x100, 9, pes(b"y" * 150), True, b"\x80" + b"\xff" * 23)
    assert (media.demux(told).continuity_errors, len(media.demux(told).payload)) == (0, 320)
    point = media.tables() + packet(0x100, 0, pes(b"k", 5), True, b"\x40" + b"\xff" * 167)
    assert media.demux(point).random_access == [5]


def test_tables_over_several_packets():
    programs = [(i, 0x1000) for i in range(1, 61)]
    body = (1).to_bytes(2, "big") + b"\xc1\x00\x00" + b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in programs)
    section = media._section(0, body)
    first, rest = b"\x00" + section[:183], section[183:]
    split = packet(0, 0, first, True) + packet(0, 1, rest.ljust(184, b"\xff"))
    s = media.demux(split + media.tables()[188:] + packet(0x100, 0, pes(b"p"), True))
    assert s.programs == dict(programs) and s.payload == b"p" and not s.damaged


def test_damage_is_counted_and_never_raised():
    ts = media.mux(b"x" * 5000)
    wide = bytearray(ts)
    wide[3], wide[4] = 0x30, 255  # the program table's packet: an adaptation field longer than the packet
    assert media.demux(bytes(wide)).damaged >= 1
    short = media.tables() + packet(0x100, 0, pes(b"", size=0)[:7] + b"\x80\x01\xff", True, b"\x00" + b"\xff" * 172)
    assert media.demux(short).damaged == 1 and media.demux(short).pts == []
    lost = media.demux(ts[: 188 * 5] + ts[188 * 6 :])
    assert (lost.continuity_errors, lost.damaged, len(lost.payload)) == (1, 1, 5000 - 184)
    grown = media.demux(ts[: 188 * 5] + b"abc" + ts[188 * 5 :])
    assert grown.payload == b"x" * 5000 and grown.damaged == 1
    rng = random.Random(2)
    for _ in range(300):
        broken = bytearray(ts[: 188 * rng.randrange(1, 27)])
        for _ in range(rng.randrange(1, 30)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        cut = rng.randrange(len(broken))
        media.demux(bytes(broken[:cut] + broken[cut + rng.randrange(4) :]))


def test_media_query(spark):
    got = media.media_columns(frame(spark, ODD, True), keep_media=True).collect()
    assert len(got) == len(ODD)
    for r, t in zip(got, ODD):
        data = (t or "").encode()
        pad = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert got[7][1:] == got[8][1:]
    assert media.media_columns(frame(spark, ODD).limit(0)).count() == 0


def brute_quality(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality(spark):
    texts = [*ODD, LONG, "a b c d e " * 60, "\n".join(f"line {i} of #{i % 3} words" for i in range(40))]
    got = quality.quality(frame(spark, texts)).collect()
    for r, t in zip(got, texts):
        n, chars, symbols, dup, rep = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)
    assert quality.quality(frame(spark, []).limit(0)).count() == 0


def test_bands():
    import os

    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(random.Random(i).choices("etaoinshrdlu", k=6)) for i in range(400)).encode()
    assert quality.compression_verdict(prose, packer)[2]
    assert not quality.compression_verdict(b"again and again " * 300, packer)[2]
    assert not quality.compression_verdict(os.urandom(5000), packer)[2]
    assert not quality.compression_verdict(prose + b"z" * 40_000, packer)[2]


def brute_verdict(data):
    """The bands written out: ratio of the whole, then of each 2,048 bytes and what is left."""
    import zstandard

    def ratio(piece):
        return len(zstandard.ZstdCompressor(level=3).compress(piece)) / len(piece)

    def fits(piece):
        limits = [(64, 0.4, 12), (128, 0.5, 1.16), (256, 0.45, 0.98), (512, 0.4, 0.84), (1024, 0.35, 0.77), (2048, 0.3, 0.7), (4096, 0.27, 0.68), (16384, 0.24, 0.66), (1e99, 0.18, 0.66)]
        low, high = next((a, b) for n, a, b in limits if len(piece) < n)
        return low <= ratio(piece) <= high

    if not data:
        return 0.0, 0.0, False
    bad, at = 0, 0
    while at < len(data):
        piece = data[at : at + 2048]
        bad += 0 if fits(piece) else len(piece)
        at += 2048
    return ratio(data), bad / len(data), fits(data) and bad / len(data) < 0.25


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlucm", k=rng.randrange(2, 9))) for _ in range(n))
    noise = lambda n: "".join(rng.choices([chr(c) for c in range(0x21, 0x7F)] + [chr(c) for c in range(0xA1, 0x250)], k=n))
    english = "the people of this old town often say that rivers were wider once and that boats came from far away to trade cloth for grain or salt before the bridge was built there"
    mixed = lambda n: " ".join(rng.choice(english.split()) + rng.choice(["", "s", "ing", ", "]) for _ in range(n))
    texts = [*ODD, mixed(900), mixed(60), mixed(3000), prose(800), mixed(700)[:4096] + noise(2600), mixed(400) + "ab " * 1500, "ab" * 80, noise(9000), "again and again " * 300]
    names = ["n_words", "kept", "ratio", "k"]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in enumerate(texts)], ", ".join(["doc_id long", "text string", *(f"{n} int" for n in names)]))
    kept = 0
    for r in quality.quality(df).collect():
        want = brute_verdict((texts[r.doc_id] or "").encode())
        assert (r.ratio, r.bad_chunks, r.kept) == (*want[:2], want[2] and not r.base_failed)
        kept += r.kept
    assert kept >= 3


def test_noise_in_a_part_of_a_text_is_seen():
    import os

    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    rng = random.Random(4)
    words = [" ".join("".join(rng.choices("etaoinshr", k=4)) for _ in range(1)) for _ in range(900)]
    sound = " ".join(rng.choice(words) for _ in range(3000)).encode()
    assert quality.compression_verdict(sound[:8191], packer)[2]
    assert not quality.compression_verdict(sound[:4095] + os.urandom(4096), packer)[2]
    assert not quality.compression_verdict(sound[:4600] + os.urandom(1800), packer)[2]  # the last, shorter chunk
    assert not quality.compression_verdict(b"ab" * 80, packer)[2]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(f"{TOKENIZERS}/{VOCABULARY}")


TRICKY = [
    "", "  ", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "a" * 5000, "I'm don't x's y'LL z", "é é ́x İstanbul ΣΑΣ ς ß ẞ ÿ Ÿ",
    "\n\nfoo\tbar\x1cbaz q " * 40, "日本語テキスト" * 90 + " x", "the,the.THE ... !!! a_b-c 1234567 ½ ² ª º µ", "zażółć gęślą jaźń " * 30, "🙂🙃 👩‍👩‍👧 " * 50,
]


@pytest.mark.parametrize("text", [*TRICKY, LONG[:40_000]])
def test_bpe_equals_the_library(encoder, text):
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text.encode())
    assert got == array("I", ids).tobytes()
    assert encoder.decode(got).decode() == encoder.tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_random_texts(encoder):
    rng = random.Random(3)
    alphabet = "abcdeé' ,.\n1<|>ß́ Ω"
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randrange(300)))
        assert encoder.encode(text.encode()) == array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_bpe_full_caches_change_nothing(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 40)
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 3)
    small = bpe.Encoder(f"{TOKENIZERS}/{VOCABULARY}")
    for text in (LONG[:3000], "some words again " * 20, LONG[2000:5000]):
        assert small.encode(text.encode()) == encoder.encode(text.encode())


def test_shared_passages_are_encoded_once(encoder):
    fresh = bpe.Encoder(f"{TOKENIZERS}/{VOCABULARY}")
    passage = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(400))
    fresh.encode(("one start " + passage + " one end").encode())
    before = fresh.new_chunks
    fresh.encode(("quite another start here " + passage + " and end").encode())
    assert fresh.new_chunks - before <= 4


def test_words_of_known_chunks_are_not_encoded_again():
    fresh = bpe.Encoder(f"{TOKENIZERS}/{VOCABULARY}")
    data = " ".join(f"word{i}" for i in range(2000)).encode()
    ids = fresh.encode(data)
    fresh.words.clear()
    fresh.joins.clear()
    before = fresh.new_chunks
    assert fresh.encode(data) == ids
    assert not fresh.words and fresh.new_chunks == before  # joins alone
    assert 0 < len(fresh.joins) <= len(bpe.cuts(data))


def test_joins_grow_until_they_agree(monkeypatch):
    """An outer word that comes out otherwise makes the join grow by a word on either side."""
    fresh = bpe.Encoder(f"{TOKENIZERS}/{VOCABULARY}")
    data = " ".join(f"word{i}" for i in range(400)).encode()
    ids, seen, true = fresh.encode(data), [], fresh.anew

    def anew(piece):
        made = true(piece)
        seen.append(len(made))
        return [b"other", *made[1:]] if len(made) == 4 else made

    fresh.joins.clear()
    monkeypatch.setattr(fresh, "anew", anew)
    assert fresh.encode(data) == ids and {3, 4, 5, 6} & set(seen) >= {4, 6}


def test_a_word_is_encoded_once_whatever_its_case_and_marks(encoder, monkeypatch):
    fresh, asked = bpe.Encoder(f"{TOKENIZERS}/{VOCABULARY}"), []
    true = fresh.known._many
    monkeypatch.setattr(fresh.known, "_many", lambda texts: asked.extend(texts) or true(texts))
    text = "Alpha, alpha. ALPHA! alpha " * 3
    assert fresh.encode(text.encode()) == array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert sorted(filter(None, asked)) == ["!", ",", ".", "alpha"]


def test_words_about_a_cut(monkeypatch):
    monkeypatch.setattr(bpe, "NEAR", 3)
    rng = random.Random(5)
    for _ in range(300):
        data = "".join(rng.choices("ab \n", k=40)).encode()
        cut = rng.randrange(41)
        spans = [m.span() for m in bpe._WORD.finditer(data[:cut])]
        after = [m.end() for m in bpe._WORD.finditer(data[cut:])]
        for n in range(1, 5):
            assert bpe.last_word(data, cut, n) == (spans[-n][0] if len(spans) > n else 0)
            assert len(after) < n or bpe.nth_word(data, cut, 40, n) == cut + after[n - 1]


def test_cuts_stand_between_characters():
    data = "".join(random.Random(1).choices("日本語テキスト né à éü", k=9000)).encode()
    at = bpe.cuts(data)
    assert at and all(data[:i].decode() + data[i:].decode() == data.decode() for i in at)


def test_bpe_odd_tables(spark):
    names = ["n_tokens", "ids", "k", "row", "score", "__id"]
    rows = [(1, "a b", *range(6)), (1, "a b", *range(6)), (None, None, *range(6))]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in names)]))
    got = bpe.bpe(df, f"{TOKENIZERS}/{VOCABULARY}")
    assert sorted(r.n_tokens for r in got.collect()) == [0, 2, 2]
    assert bpe.bpe(df.limit(0), f"{TOKENIZERS}/{VOCABULARY}").count() == 0


def test_bpe_query(spark, encoder):
    got = bpe.bpe(frame(spark, ODD), f"{TOKENIZERS}/{VOCABULARY}", keep_ids=True).collect()
    for r, t in zip(got, ODD):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(encoder.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
