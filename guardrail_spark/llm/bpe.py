"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes of a text cuts it into chunks at places that depend on the content alone, so texts
that share a passage share its chunks. A task encodes a chunk that it meets again only once. A cut may fall inside a
word or between words that belong together, so each join is repaired: the text about it, from the words on both sides, is
encoded anew as one, and grows by a word on either side until it reproduces what both chunks have at its ends.

A chunk's words go through the memo of `packing.WordEncoder`, which gives a word of Latin letters the ids of its letters in
lower case and of its marks, so that each is encoded once.

Only vocabularies that drop white space can be used (checked when the encoder is made). Caches are emptied when full,
which costs time and never changes a result. Defined cases: null text is empty and has no ids; very long texts are
encoded whole; repeated rows each get a row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text
from .packing import WordEncoder

WINDOW = 16  # bytes that a cut depends on
MEAN_BITS = 10  # chunks of 2**10 bytes on average
MAX_CHUNKS, MAX_WORDS = 20_000, 300_000  # entries of the caches
REACH = 2  # words on either side of a join that are encoded anew at first: the outer ones must come out as they were
NEAR = 64  # bytes before a join in which its words are looked for at first
_WORD, _RUN = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


def cuts(data: bytes) -> list[int]:
    """Offsets at which chunks begin, without 0: where the hash of the WINDOW bytes before has MEAN_BITS zero bits."""
    if len(data) <= WINDOW:
        return []
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = b * np.uint32(0x9E3779B1) ^ (b << np.uint32(7))
    for step in (1, 2, 4, 8):  # doubles the window: 2, 4, 8, 16 bytes
        h = h[:-step] * np.uint32(0x85EBCA6B) + (h[step:] ^ h[step:] >> np.uint32(15))
    h = (h ^ h >> np.uint32(16)) * np.uint32(0xC2B2AE35)
    at = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + WINDOW
    at = at[at < len(data)]
    # never inside a character
    for _ in range(3):
        at = at + ((np.frombuffer(data, np.uint8)[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    return np.unique(at[at < len(data)]).tolist()


def last_word(data: bytes, cut: int, n: int) -> int:
    """Where the n-th last word (run without blanks) of data[:cut] begins, or 0 if there are not more than n."""
    size = NEAR
    while True:
        low = max(0, cut - size)
        starts = [m.start() for m in _WORD.finditer(data, low, cut)]
        if len(starts) > n:  # the first may begin before
            return starts[-n]
        if not low:
            return 0
        size *= 4


def nth_word(data: bytes, cut: int, end: int, n: int) -> int:
    """Where the n-th word of data[cut:end] ends."""
    return next(islice(_WORD.finditer(data, cut, end), n - 1, None)).end()


class Encoder:
    """Ids (little-endian unsigned 32-bit, as bytes) of whole texts, and back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.ids_of("a b") != self.ids_of("a") + self.ids_of("b") or self.tokenizer.decoder is not None:
            raise ValueError("chunk reuse needs a vocabulary that drops white space and a plain decoder")
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]
        self.known = WordEncoder(path, MAX_WORDS)
        self.words = self.known.words
        self.chunks: dict[bytes, list[bytes]] = {}
        self.joins: dict[bytes, list[bytes]] = {}
        self.new_chunks = self.met_chunks = 0

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def chunk(self, data: bytes) -> list[bytes]:
        """The ids of a chunk's words; words that the worker has not met are encoded, all at once."""
        self.met_chunks += 1
        found = self.chunks.get(data)
        if found is not None:
            return found
        self.new_chunks += 1
        if len(self.chunks) >= MAX_CHUNKS:
            self.chunks.clear()
        found = self.chunks[data] = self.known.of_words(data.split())
        return found

    def anew(self, data: bytes) -> list[bytes]:
        """The ids of a piece of text, encoded as one, given out by its words."""
        found = self.joins.get(data)
        if found is None:
            text = data.decode()
            e = self.tokenizer.encode(text, add_special_tokens=False)
            ends = [m.end() for m in _RUN.finditer(text)]
            out, i = [array("I") for _ in ends], 0
            for token, (start, _) in zip(e.ids, e.offsets):
                while i + 1 < len(ends) and start >= ends[i]:
                    i += 1
                out[i].append(token)
            if len(self.joins) >= MAX_CHUNKS:
                self.joins.clear()
            found = self.joins[data] = [x.tobytes() for x in out]
        return found

    def encode(self, data: bytes) -> bytes:
        """Ids of a text: those of its chunks, with the joins repaired."""
        bounds = [0, *cuts(data), len(data)]
        ids = list(self.chunk(data[: bounds[1]]))
        for cut, end in zip(bounds[1:], bounds[2:]):
            chunk = self.chunk(data[cut:end])
            n, size = REACH, len(chunk)
            while True:
                left, right = min(n, len(ids)), min(n, size)
                low = last_word(data, cut, n) if left == n else 0
                high = nth_word(data, cut, end, n) if right == n else end
                made = self.anew(data[low:high])
                # an outer word is there to agree unless the text ends, or the next join goes on from it
                if (left < n or made[0] == ids[-left]) and (right < n or made[-1] == chunk[right - 1]):
                    break
                n += 1
            del ids[len(ids) - left :]
            ids += made
            ids += chunk[right:]
        return b"".join(ids)

    def forget(self) -> None:
        """Gives the memory of chunks and joins back: a worker lives on, and later stages share its executor."""
        self.chunks.clear()
        self.joins.clear()

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps its words from task to task."""
    return Encoder(path)


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Number and digest of each text's ids, digest of their decoded text; the ids themselves as `ids` if keep_ids.
    `path` names the vocabulary file, which every executor has."""

    def start():
        own = encoder(path)

        def one(data: bytes) -> tuple:
            ids = own.encode(data)
            decoded = own.decode(ids)
            row = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
            return (*row, array("I", ids).tolist()) if keep_ids else row

        return one

    out = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return per_text(docs, [id_col], out + [("ids", pa.list_(pa.int64()))] * keep_ids, start, text, lambda: encoder(path).forget())
