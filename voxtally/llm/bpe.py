"""Byte-level BPE encoding and decoding as a reduction of a tree.

A text is cut into halves until a piece is short; pieces are encoded on their
own, and two neighbours are joined by encoding a window around the cut again.
The window grows until both its ends lie where a match of the pattern must
end whatever the rest of the text is: between a letter and a following space
or line feed. No match can hold a letter and then white space, and none of
the pattern's look-aheads reaches past such a place, so the ids outside the
window are those of the whole text. Where there is no such place, the window
is the whole of the two pieces. Joining is associative, as the result is
always the encoding of the joined text. Decoding concatenates the bytes of
halves up the same tree.

Each row is encoded by one task; nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.common import by_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 2048
FIRST_WINDOW = 32
LEAF_IDS = 4096

# A place where a match of the pattern ends in any text.
_SURE = re.compile(r"[^\W\d_](?=[ \n])")


class Codec:
    """Ranks of one vocabulary, with the encoding of short pieces."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.leaf_chars = max(2, leaf_chars)

    @functools.cached_property
    def _short(self) -> tiktoken.Encoding:
        # made by those who encode only
        ranks = {token: rank for rank, token in enumerate(self.tokens) if token}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, 0, len(text))

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self._short.encode_ordinary(text), dtype=np.uint32)

    def _tree(self, text: str, low: int, high: int) -> np.ndarray:
        if high - low <= self.leaf_chars:
            return self._leaf(text[low:high])
        cut = (low + high) // 2
        return self.join(text, low, cut, high, self._tree(text, low, cut), self._tree(text, cut, high))

    def join(self, text: str, low: int, cut: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[low:high] from those of its parts before and after the cut."""
        size = FIRST_WINDOW
        start = end = None
        while start is None or end is None:
            if start is None:
                start = self._sure_before(text, max(low, cut - size), cut)
                if start is None and cut - size <= low:
                    start = low
            if end is None:
                end = self._sure_after(text, cut, min(high, cut + size))
                if end is None and cut + size >= high:
                    end = high
            size *= 2
        kept_left = len(left) - self._ids_of(left[::-1], len(text[start:cut].encode("utf-8", "replace")))
        kept_right = self._ids_of(right, len(text[cut:end].encode("utf-8", "replace")))
        return np.concatenate([left[:kept_left], self._leaf(text[start:end]), right[kept_right:]])

    @staticmethod
    def _sure_before(text: str, low: int, cut: int) -> int | None:
        # The character after the place lies before the cut, so that the left piece ended a match there too.
        found = None
        for m in _SURE.finditer(text, low, cut):
            found = m.end()
        return found

    @staticmethod
    def _sure_after(text: str, cut: int, high: int) -> int | None:
        m = _SURE.search(text, cut, high)
        return m.end() if m else None

    def _ids_of(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many ids from the start hold exactly so many bytes."""
        if n_bytes == 0:
            return 0
        # every id has at least one byte
        sums = np.cumsum(self._lengths[ids[:n_bytes]])
        at = int(np.searchsorted(sums, n_bytes))
        if at == len(sums) or sums[at] != n_bytes:
            raise AssertionError("a window does not end between two tokens")
        return at + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self.tokens[i] for i in ids.tolist()])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=4)
def codec(path: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    """One codec for each vocabulary and Python worker."""
    return Codec(path, leaf_chars)


def _path(vocabulary: str) -> str:
    # resolved where it is used: every machine has its own installation
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def encode(
    docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text",
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """``(id, n_tokens bigint, ids binary)``: the ids as little-endian unsigned 32-bit integers.

    One row for each input row, repeated rows included. A null text counts as
    the empty one and has no ids; a null id stays null. Bytes that are not
    UTF-8 are read as U+FFFD. Other columns, whatever their names, are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        own = codec(_path(vocabulary), leaf_chars)
        for row in rows:
            ids = own.encode((row["_text"] or b"").decode("utf-8", "replace"))
            yield row["_id"], len(ids), ids.astype("<u4").tobytes()

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    done = by_rows(narrow, f"_id {kind}, n_tokens bigint, ids binary", run)
    return done.withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids stand for no bytes.

    An id that the vocabulary does not have fails the job. An input column
    called like the new one is replaced; all others stay.
    """
    kept = [c for c in encoded.columns if c.lower() != name.lower()]
    read = kept if ids_col in kept else [*kept, ids_col]
    fields = encoded.select(*[F.col(f"`{c}`") for c in kept]).schema.add(name, "binary")

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        own = codec(_path(vocabulary))
        for row in rows:
            ids = np.frombuffer(row[ids_col] or b"", dtype="<u4")
            yield *[row[c] for c in kept], own.decode(ids)

    return by_rows(encoded.select(*[F.col(f"`{c}`") for c in read]), fields, run)

