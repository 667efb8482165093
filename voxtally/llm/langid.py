"""Language by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed
with each of them: a phrase is the longest match that occurs in the labelled
text, and the next phrase begins where it ends. The language that needs the
fewest phrases wins, where phrases are counted per character and divided by
what the language's automaton needs for other labelled text of its own.

Texts are lower-cased and mapped to the letters that the labelled texts have;
all other characters are one blank, repeated blanks are one, and a letter
that no labelled text has never matches. Parsing runs over many pieces of
texts at once; phrases end at the pieces' edges, as they do at the text's end,
and every piece of every text is parsed. No row is shuffled.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxtally.llm.common import held_out, in_arrow, unit_hash, whole_text

#: Bounds of the labelled sample: documents and characters per language, and characters in all.
SAMPLE_DOCS = 40
SAMPLE_CHARS = 20_000
ALL_CHARS = 400_000
PARTS = 64
PIECE = 256
STEP_CHARS = 2_000_000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MISS = 1 << 30


class Alphabet:
    """Small codes of the letters of some texts: 0 fills up, 1 is blank, 2 is any other letter."""

    def __init__(self, texts: Sequence[str]):
        letters = sorted({c for t in texts for c in t.lower() if _LETTER.match(c)})
        self.letters = {ord(c): 3 + i for i, c in enumerate(letters)}
        self.size = 3 + len(letters)
        top = max([0x24F, *self.letters]) + 1
        self._codes = np.array([2 if _LETTER.match(chr(i)) else 1 for i in range(top)], dtype=np.uint16)
        for at, code in self.letters.items():
            self._codes[at] = code

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        far = points >= len(self._codes)
        codes = self._codes[np.where(far, 0, points)]
        if far.any():
            codes = codes.copy()
            codes[far] = [2 if _LETTER.match(chr(p)) else 1 for p in points[far]]
        blank = codes == 1
        repeated = np.zeros(len(codes), dtype=bool)
        repeated[1:] = blank[1:] & blank[:-1]
        return codes[~repeated]


def suffix_automaton(codes: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads all factors of the codes; state 0 begins."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


@dataclass(frozen=True)
class Samples:
    """Labelled text of each language: to build the automaton from, and to measure it with."""

    languages: tuple[str, ...]
    build: tuple[str, ...]
    measure: tuple[str, ...]


class Parser:
    """The automata of all languages in one table: state and code give the next state, and whether a phrase began."""

    def __init__(self, samples: Samples):
        self.alphabet = Alphabet(samples.build)
        a = self.alphabet.size
        blocks, self._starts, at = [], [], 0
        for text in samples.build:
            moves = suffix_automaton(self.alphabet.encode(text).tolist())
            # a miss starts over with the letter that did not match; the first state has no phrase open
            root = np.full(a, at * a, dtype=np.int32)
            for c, to in moves[0].items():
                root[c] = (at + to) * a
            block = np.tile(root | _MISS, (len(moves), 1))
            for state, out in enumerate(moves[1:], 1):
                for c, to in out.items():
                    block[state, c] = (at + to) * a
            block[:, 0] = (at + np.arange(len(moves))) * a
            blocks.append(block)
            self._starts.append(at * a)
            at += len(moves)
        self._table = np.concatenate(blocks).ravel() if blocks else np.zeros(0, np.int32)
        self.own = np.ones(len(samples.languages))
        if samples.languages:
            counts, chars = self.phrases(list(samples.measure))
            with np.errstate(divide="ignore", invalid="ignore"):
                rates = np.diagonal(counts) / chars
            self.own = np.where(np.isfinite(rates) & (rates > 0), rates, 1.0)

    def phrases(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) by language (columns), and the texts' lengths in codes."""
        coded = [self.alphabet.encode(t) for t in texts]
        lengths = np.array([len(c) for c in coded], dtype=np.int64)
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        grid = np.zeros((len(owner), PIECE), dtype=np.uint16)
        row = 0
        for codes, n in zip(coded, pieces):
            grid[row : row + n].ravel()[: len(codes)] = codes
            row += n
        state = np.repeat(np.array(self._starts, dtype=np.int32)[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        for column in np.ascontiguousarray(grid.T).astype(np.int32):
            state = self._table[state + column]
            count += state >> 30
            state &= _MISS - 1
        total = np.zeros((len(texts), len(self._starts)), dtype=np.int64)
        np.add.at(total, owner, count.T)
        return total, lengths

    def languages(self, texts: Sequence[str]) -> list[tuple[int, float]]:
        """The winner of each text, -1 without a letter, and its lead: 1 less best over second."""
        total, lengths = self.phrases(texts)
        out = []
        for i, text in enumerate(texts):
            if not len(self._starts) or not _LETTER.search(text):
                out.append((-1, 0.0))
                continue
            need = total[i] / lengths[i] / self.own
            order = np.argsort(need, kind="stable")
            lead = 1.0 if len(order) == 1 else 1.0 - need[order[0]] / need[order[1]]
            out.append((int(order[0]), float(min(1.0, max(0.0, lead)))))
        return out


@functools.lru_cache(maxsize=2)
def parser(samples: Samples) -> Parser:
    """One parser for each Python worker."""
    return Parser(samples)


def _split(texts: Sequence[str], chars: int) -> tuple[str, str]:
    """Text to build from and text to measure with, in turn; long texts only where there is nothing else."""
    parts, sizes = [[], []], [0, 0]
    for text in sorted(texts, key=lambda t: len(t) > chars // 4):
        side = 0 if sizes[0] <= sizes[1] else 1
        if sizes[side] < chars:
            part = text[: chars - sizes[side]]
            parts[side].append(part)
            sizes[side] += len(part)
    return " ".join(parts[0]), " ".join(parts[1])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Samples:
    """Labelled samples from outside the held-out fold.

    Of each language, the ``SAMPLE_DOCS`` documents with the smallest hash of
    their id that have a letter, and of those at most ``SAMPLE_CHARS``
    characters twice; with many languages fewer, so that all of them stay
    within ``ALL_CHARS``. The driver gets ``SAMPLE_DOCS * ALL_CHARS`` characters at
    most, however long the documents are.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), FOLDS, HELD_OUT))
    known = known.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    # first among a few hashed parts of each language, so that a common one is no single task
    part = F.floor(F.col("_h") * PARTS)
    within = Window.partitionBy("_lang", part).orderBy("_h", "_id")
    order = Window.partitionBy("_lang").orderBy("_h", "_id")
    keys = known.select(
        F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), unit_hash(F.col(id_col), "language").alias("_h")
    ).distinct()
    keys = keys.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= SAMPLE_DOCS)
    chosen = keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_DOCS).select("_id", "_lang", "_n").collect()
    if not chosen:
        return Samples((), (), ())
    kind = docs.schema[id_col].dataType.simpleString()
    small = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], f"_id {kind}, _lang string, _n int")
    chars = min(SAMPLE_CHARS, ALL_CHARS // len({r["_lang"] for r in chosen}))
    # SAMPLE_DOCS rows of each language, of which no more characters leave Spark than are learned from
    first = F.left(whole_text(text_col), F.lit(chars))
    texts = known.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), first.alias("_text"))
    texts = texts.join(F.broadcast(small), ["_id", "_lang"]).groupBy("_lang", "_n").agg(F.min("_text").alias("_text"))
    by_lang = defaultdict(list)
    for r in sorted(texts.collect(), key=lambda r: r["_n"]):
        by_lang[r["_lang"]].append(r["_text"])
    names = tuple(sorted(by_lang))
    pairs = [_split(by_lang[n], chars) for n in names]
    return Samples(names, tuple(p[0] for p in pairs), tuple(p[1] or p[0] for p in pairs))


def identify(docs: DataFrame, samples: Samples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row.

    The score is how much fewer normalised phrases the winner needs than the
    second, from 0 to 1; ties go to the first name. ``und`` with score 0 is
    the answer for texts that are null, empty or without a letter, and for
    all if nothing was learned. Repeated rows have equal results, an empty
    table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = narrow.select("_id").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(shared.value)
        names = shared.value.languages

        def answer(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
            found = own.languages(texts)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, kind),
                pa.array([names[i] if i >= 0 else UNKNOWN for i, _ in found], pa.string()),
                pa.array([s for _, s in found], pa.float64()),
            ], names=["_id", "lang_pred", "score"])

        for batch in batches:
            ids, texts, held = [], [], 0
            kind = batch.schema.field("_id").type
            for i, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                value = (text.as_py() or b"").decode("utf-8", "replace")
                ids.append(i)
                texts.append(value)
                held += len(value)
                if held >= STEP_CHARS:
                    yield answer(ids, texts, kind)
                    ids, texts, held = [], [], 0
            if ids:
                yield answer(ids, texts, kind)

    return in_arrow(narrow, run, schema).withColumnRenamed("_id", id_col)
