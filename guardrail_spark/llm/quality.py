"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks, the last of which is what is left. Repetitive text
compresses far better than prose of its length, noise hardly at all; the limits between them depend on the length of what
is compressed, text or chunk, since short pieces carry more overhead. A text is rejected if its own ratio lies outside the
limits, or those of chunks that make up BAD_SHARE of its bytes.

Defined cases: null text counts as empty; a text without words has zero counts, fails the base rule and isn't kept; long
texts are read whole, chunk by chunk; repeated rows each get their own equal row; other columns are ignored, also those
named like a result. Every row is judged on its own, so ties change nothing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import per_text

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """For pieces of fewer than `bytes` bytes: the lowest and highest ratio of compressed to plain size of sound text."""

    bytes: int
    low: float
    high: float


BANDS = (
    Bands(64, 0.40, 12.0),
    Bands(128, 0.50, 1.16),
    Bands(256, 0.45, 0.98),
    Bands(512, 0.40, 0.84),
    Bands(1024, 0.35, 0.77),
    Bands(2048, 0.30, 0.70),
    Bands(4096, 0.27, 0.68),
    Bands(16384, 0.24, 0.66),
    Bands(1 << 62, 0.18, 0.66),
)
CHUNK, BAD_SHARE = 2048, 0.25
LEVEL = 3


def ratio_of(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, bool]:
    """Compressed to plain size of a piece, and whether it lies in the band of the piece's length."""
    ratio = len(packer.compress(data)) / len(data)
    band = next(b for b in BANDS if len(data) < b.bytes)
    return ratio, band.low <= ratio <= band.high


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    n = len(words)
    continuation = len(data) - len(data.translate(None, bytes(range(0x80, 0xC0))))
    spaces = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            twice = Counter(windows)
            end = 0  # words before this one are counted already
            for i, w in enumerate(windows):
                if twice[w] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    return n, len(data) - continuation - spaces, symbols, dup_lines, repeat


def compression_verdict(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks outside the limits, and whether the bands keep it."""
    if not data:
        return 0.0, 0.0, False
    ratio, fits = ratio_of(data, packer)
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    bad = sum(len(c) for c in chunks if not ratio_of(c, packer)[1]) / len(data)
    return ratio, bad, fits and bad < BAD_SHARE


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, compression ratios and the verdict of every row of docs."""

    def start():
        packer = zstandard.ZstdCompressor(level=LEVEL)

        def one(data: bytes) -> tuple:
            n, chars, symbols, dup, repeat = base_counts(data)
            failed = n < 50 or 100 * repeat > 50 * n
            ratio, bad, ok = compression_verdict(data, packer)
            return n, chars, symbols, dup, repeat, failed, ok and not failed, ratio, bad

        return one

    out = [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out += [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.float64())]
    return per_text(docs, [id_col], out, start, text)
