"""Toxicity by a small convolutional network over hashed word embeddings.

A word is the sum of the embeddings of its own hash and of the hashes of its
first letters, so that unseen endings keep the meaning of their stem. Filters
over one, two and three neighbouring words are followed by the largest value
over the whole text and by one logistic layer. All labelled rows are learned
from: counts of them start the embeddings, then tasks go through their rows in
small steps, and after each round their networks become one, by mean. Labelled
rows that are not trained on, one in four, give the thresholds from counts of
their logits, one for each language. The language is told from the
letters of the text, as the given ones are no inputs, and the threshold is
taken off the logit, so that 0.5 is the decision everywhere.

Every text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.common import held_out, in_arrow, under_safe_names, whole_text
from voxtally.session import materialize

BUCKETS = 1 << 17
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
STEMS = (4, 5, 6)
#: All rows are gone through so often, and more seldom, but twice at least, where a task makes ``TRAINER_STEPS`` steps before.
EPOCHS = 5
TRAINER_STEPS = 500
#: Few rows are gone through more often, up to so many steps.
LEAST_STEPS = 300
BATCH = 32
#: A task trains on so many rows at least; there are no more such tasks than cores.
ROWS_A_TRAINER = 1000
#: Embeddings leave the tasks in blocks of so many buckets, and their means are made block by block.
BLOCK = 4096
#: Logits are counted for the thresholds in steps of this size, between plus and minus ``LARGEST_LOGIT``.
LOGIT_STEP = 1 / 256
LARGEST_LOGIT = 50.0
CALIBRATION = 4
#: A language gets a threshold of its own from so many rows of each label on.
LEAST_CALIBRATION = 12
KNOWN_WORDS = 100_000
#: Texts are scored in steps of about so many words, longer ones in pieces of so many.
WORDS_PER_STEP = 20_000
FOLDS, HELD_OUT = 5, 0
#: What words lose at both ends.
OUTER = "\"'.,;:!?()[]{}*#$%&<>-_…«»¿¡"
#: Longer words are hashed one by one, others together.
LONG_WORD = 64
#: crc32 of each byte, as the state that the byte adds to.
CRC_TABLE = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], dtype=np.uint32)
#: Letters that tell a language, fixed values.
LETTERS = {"de": "äöüß", "es": "ñíóáú¿¡", "fr": "éèêçàâùîœ"}


def language_of(text: str) -> str:
    counts = {k: sum(map(text.count, v)) for k, v in LETTERS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] * 200 > len(text) else "other"


def hashes(word: str) -> list[int]:
    """Buckets of a word: itself and its stems, without case and outer punctuation."""
    plain = word.lower().strip(OUTER)
    parts = [f"={plain}", *[f"{n}^{plain[:n]}" for n in STEMS]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def crc32s(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: bytes) -> np.ndarray:
    """crc32 of ``first`` and then ``lengths`` bytes from ``starts``, each of at most some bytes: one byte of all at a time."""
    order = np.argsort(-lengths, kind="stable")
    at, lengths = starts[order], lengths[order]
    state = np.full(len(at), zlib.crc32(first) ^ 0xFFFFFFFF, dtype=np.uint32)
    for j in range(lengths.max(initial=0)):
        n = np.searchsorted(-lengths, -j)  # those longer than j
        state[:n] = CRC_TABLE[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def hash_rows(words: Iterable[str]) -> np.ndarray:
    """The ``hashes`` of each word, one row a word; words are without white space."""
    words = list(words)
    if not words:
        return np.zeros((0, 1 + len(STEMS)), dtype=np.int32)
    plain = [w.strip(OUTER) for w in "\n".join(words).lower().split("\n")]
    long = [i for i, w in enumerate(plain) if len(w) > LONG_WORD]
    for i in long:
        plain[i] = ""
    data = np.frombuffer("\n".join([*plain, ""]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    letters = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.flatnonzero(data[letters] == ord("\n"))
    begins = np.concatenate([[0], ends[:-1] + 1])
    starts = letters[begins]
    parts = [(b"=", ends), *[(b"%d^" % n, np.minimum(begins + n, ends)) for n in STEMS]]
    rows = np.stack([crc32s(data, starts, letters[stop] - starts, first) for first, stop in parts], axis=1)
    rows = (rows % BUCKETS).astype(np.int32)
    for i in long:
        rows[i] = hashes(words[i])
    return rows


@dataclass
class Network:
    embeddings: np.ndarray
    filters: list[np.ndarray]  # one for each width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    start: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def projections(self, words: np.ndarray) -> np.ndarray:
        """What words, given as hash rows, add to each filter at each of its places."""
        e = self.embeddings.take(words[:, 0], axis=0)
        for part in words.T[1:]:
            e += self.embeddings.take(part, axis=0)
        return (e @ np.hstack([f[i] for f in self.filters for i in range(len(f))])).astype(np.float32)

    def values(self, places: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the values of its filters from each place on, also across the texts' bounds."""
        at = 0
        for f, b in zip(self.filters, self.biases):
            length = max(0, len(places) - len(f) + 1)
            values = np.zeros((length, FILTERS), dtype=np.float32) + b.astype(np.float32)
            for i in range(len(f)):
                values += places[i : i + length, (at + i) * FILTERS : (at + i + 1) * FILTERS]
            at += len(f)
            yield values

    def pooled(self, places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter values of each text, at least zero, and the places they come from (-1: none).

        ``places`` has the projections of the words of all texts, one after
        another; ``bounds`` says where each text begins, and the end.
        """
        n = len(bounds) - 1
        best = np.zeros((n, len(self.weights)), dtype=np.float32)
        origin = np.full((n, len(self.weights)), -1, dtype=np.int64)
        for k, (f, values) in enumerate(zip(self.filters, self.values(places))):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for t in range(n):
                low, high = bounds[t], bounds[t + 1] - len(f) + 1
                if high > low:
                    where = values[low:high].argmax(0)
                    top = values[low + where, np.arange(FILTERS)]
                    best[t, cols] = np.maximum(top, 0)
                    origin[t, cols] = np.where(top > 0, low + where, -1)
        return best, origin

    def largest(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest filter values alone."""
        best = np.zeros((len(bounds) - 1, len(self.weights)), dtype=np.float32)
        for k, (f, values) in enumerate(zip(self.filters, self.values(places))):
            for t, (low, high) in enumerate(zip(bounds[:-1].tolist(), (bounds[1:] - len(f) + 1).tolist())):
                if high > low:
                    best[t, k * FILTERS : (k + 1) * FILTERS] = values[low:high].max(0, initial=0)
        return best

    def logits(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.largest(places, bounds) @ self.weights + self.start


class Vocabulary:
    """Numbers of the words met so far, and a row for each: its hashes, or what ``rows_of`` gives for new words."""

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray] = hash_rows):
        self._rows_of = rows_of
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[str, int] = defaultdict(count().__next__)
        self.rows = self._space = self._rows_of([])

    def numbered(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The numbers of the texts' words. Those given before end when too many words are known."""
        return self.numbers(map(str.split, texts))

    def numbers(self, docs: Iterable[list[str]]) -> list[np.ndarray]:
        """``numbered`` for texts that are split into words."""
        if len(self._numbers) > KNOWN_WORDS:
            self._forget()
        number, known = self._numbers.__getitem__, len(self._numbers)
        found = [np.fromiter(map(number, words), dtype=np.int32, count=len(words)) for words in docs]
        total = len(self._numbers)
        if total > known:
            if total > len(self._space):
                space = np.empty((2 * total, self._space.shape[1]), dtype=self._space.dtype)
                space[:known] = self.rows
                self._space = space
            fresh = islice(self._numbers, known, None)
            for at in range(known, total, WORDS_PER_STEP):
                # what it takes to make rows goes by a step's words, also for one huge text
                some = list(islice(fresh, WORDS_PER_STEP))
                self._space[at : at + len(some)] = self._rows_of(some)
            self.rows = self._space[:total]
        return found


def bucket_counts(batches: Iterable[tuple[Sequence[str], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of each label a bucket occurs, and how many texts of each label there are."""
    hits, totals, vocabulary = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(2, dtype=np.int64), Vocabulary()
    for texts, labels in batches:
        for doc, y in zip(vocabulary.numbered(texts), labels):
            # a bucket that the text has several times is read once and written once
            hits[y, vocabulary.rows[doc].ravel()] += 1
            totals[y] += 1
    return hits, totals


def first_network(hits: np.ndarray, totals: np.ndarray, seed: int = 7) -> Network:
    """One direction of the embeddings starts as the log-odds of a bucket's texts, the others at random."""
    rng = np.random.default_rng(seed)
    rates = (hits + 0.5) / (np.maximum(1, totals)[:, None] + 1)
    embeddings = rng.normal(0, 0.05, (BUCKETS, DIM))
    embeddings[:, 0] = np.where(hits.sum(0) >= 3, np.clip(np.log(rates[1] / rates[0]), -2, 2), 0) / 4
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5
    return Network(
        embeddings, filters, [np.full(FILTERS, -0.2) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.3),
        float(np.log((totals[1] + 1) / (totals[0] + 1))),
    )


class Trainer:
    """Goes down the error of a network in small steps, and knows which buckets they touched."""

    def __init__(self, network: Network, squares: dict):
        self.network, self.squares = network, squares
        self.touches = np.zeros(BUCKETS, dtype=np.int32)
        self.steps = 0

    @staticmethod
    def first_squares() -> dict:
        return {"e": np.full(BUCKETS, 1e-2), "w": 1e-2, "s": 1e-2, **{f"f{k}": 1e-2 for k in range(len(WIDTHS))}}

    def step(self, docs: Sequence[np.ndarray], rows: np.ndarray, y: np.ndarray) -> None:
        network, squares = self.network, self.squares
        words, best, origin = pooled_texts(network, docs, rows)
        error = 1 / (1 + np.exp(-np.clip(best @ network.weights + network.start, -50, 50))) - y
        error /= len(docs)
        g_weights, g_start = best.T @ error, error.sum()
        back = error[:, None] * network.weights
        touched, grads = [], []
        g_filters = []
        for k, width in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            t, j = np.nonzero(origin[:, cols] >= 0)
            place, amount = origin[:, cols][t, j], back[:, cols][t, j]
            g = np.zeros_like(network.filters[k])
            for i in range(width):
                w = rows[words[place + i]]
                np.add.at(g[i].T, j, amount[:, None] * network.embeddings[w].sum(1))
                touched.append(w.ravel())
                grads.append(np.repeat(amount[:, None] * network.filters[k][i].T[j], w.shape[1], axis=0))
            b = np.bincount(j, weights=amount, minlength=FILTERS)
            g_filters.append((g, b))
        for k, (g, b) in enumerate(g_filters):
            squares[f"f{k}"] += float((g * g).mean())
            network.filters[k] -= 0.1 * g / np.sqrt(squares[f"f{k}"])
            network.biases[k] -= 0.1 * b / np.sqrt(squares[f"f{k}"])
        squares["w"] += float((g_weights**2).mean())
        squares["s"] += float(g_start**2)
        network.weights = network.weights - 0.3 * g_weights / np.sqrt(squares["w"])
        network.start -= 0.3 * float(g_start) / float(np.sqrt(squares["s"]))
        at_rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        g = np.zeros((len(at_rows), DIM))
        np.add.at(g, inverse, np.concatenate(grads))
        squares["e"][at_rows] += (g * g).mean(1)
        network.embeddings[at_rows] -= 0.1 * g / np.sqrt(squares["e"][at_rows])[:, None]
        self.touches[at_rows] += 1
        self.steps += 1


def pooled_texts(network: Network, docs: Sequence[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, and the largest filter values of each text and the words they come from; long texts in pieces."""
    words = np.concatenate([*docs, np.zeros(0, np.int32)])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    best = np.zeros((len(docs), len(network.weights)), dtype=np.float32)
    origin = np.full(best.shape, -1, dtype=np.int64)
    pieces = [
        (t, at, min(at + WORDS_PER_STEP + max(WIDTHS) - 1, int(starts[t + 1])))
        for t in range(len(docs)) for at in range(int(starts[t]), int(starts[t + 1]), WORDS_PER_STEP)
    ]
    while pieces:
        n, size = 0, 0
        while n < len(pieces) and size < WORDS_PER_STEP:
            size += pieces[n][2] - pieces[n][1]
            n += 1
        some, pieces = pieces[:n], pieces[n:]
        bounds = np.concatenate([[0], np.cumsum([high - low for _, low, high in some])]).astype(np.int64)
        used, inverse = np.unique(np.concatenate([words[low:high] for _, low, high in some]), return_inverse=True)
        values, places = network.pooled(network.projections(rows[used])[inverse], bounds)
        for i, (t, low, _) in enumerate(some):
            better = values[i] > best[t]
            best[t, better] = values[i, better]
            origin[t, better] = places[i, better] - bounds[i] + low
    return words, best, origin


def best_threshold(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The logit that separates the labels with the fewest errors, in the middle of its gap; each counts once, or so often."""
    if not len(logits) or labels.all() or not labels.any():
        return 0.0
    order = np.argsort(logits, kind="stable")
    n = np.ones(len(logits), dtype=np.int64) if counts is None else counts[order]
    x, y, z = logits[order], labels[order] * n, (1 - labels[order]) * n
    # errors if the first i are called 0
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[z.sum()], z.sum() - np.cumsum(z)])
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    able = np.concatenate([[True], x[1:] > x[:-1], [True]])
    least = errors[able].min()
    best = edges[able & (errors == least)]
    return float(best[len(best) // 2])


class Scorer:
    """Scores of whole texts; keeps what the words met so far add to the filters."""

    def __init__(self, network: Network):
        self._network = network
        self._places = Vocabulary(lambda words: network.projections(hash_rows(words)))

    def _pooled(self, pieces: list[list[str]]) -> np.ndarray:
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        (words,) = self._places.numbers([list(chain.from_iterable(pieces))])
        return self._network.largest(self._places.rows[words], bounds)

    def scores(self, texts: Sequence[str]) -> list[float]:
        """The score of each text. Memory goes by the words of a step, not by the length of a text."""
        best = np.zeros((len(texts), len(self._network.weights)), dtype=np.float32)
        step: list[list[str]] = []
        owners: list[int] = []

        def take() -> None:
            if step:
                # the largest value of a long text is that of its pieces
                np.maximum.at(best, owners, self._pooled(step))
                step.clear()
                owners.clear()

        size = 0
        for i, text in enumerate(texts):
            words = text.split()
            # pieces share as many words as no filter may miss
            for start in range(0, max(1, len(words) - max(WIDTHS) + 1), WORDS_PER_STEP):
                piece = words[start : start + WORDS_PER_STEP + max(WIDTHS) - 1]
                step.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= WORDS_PER_STEP:
                    take()
                    size = 0
        take()
        marks = self._network.thresholds
        logits = best @ self._network.weights + self._network.start
        logits = logits - np.array([marks.get(language_of(t), marks.get("", 0.0)) for t in texts])
        return (1 / (1 + np.exp(-np.clip(logits, -50, 50)))).tolist()


def chosen_within(rows: Sequence[tuple], chars: int) -> list[tuple]:
    """The rows, in order, that fit into a number of characters; ``(key..., length)``. Those that do not fit are left out alone."""
    taken, left = [], chars
    for row in rows:
        if row[-1] <= left:
            taken.append(row[:-1])
            left -= row[-1]
    return taken


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(_text, _y, _h)`` of every labelled text outside the held-out fold, by the hash ``_h`` within each partition.

    A document labelled several times counts as toxic if one label says so;
    rows that repeat id and text are one.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), FOLDS, HELD_OUT))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("_y"))
    texts = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col), FOLDS, HELD_OUT))
    texts = texts.select(F.col(id_col).alias("_id"), whole_text(text_col).cast("binary").alias("_text"))
    rows = texts.join(known, "_id").dropDuplicates(["_id", "_text"]).withColumn("_h", F.xxhash64("_id", "_text"))
    return materialize(rows.sortWithinPartitions("_h").select("_text", "_y", "_h"), "labelled")


def texts_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and labels of ``rows`` rows at a time."""
    texts, ys = [], []
    for batch in batches:
        for text, y in zip(batch.column("_text"), batch.column("_y").to_pylist()):
            texts.append(text.as_py().decode("utf-8", "replace"))
            ys.append(y)
            if len(texts) == rows:
                yield texts, np.array(ys)
                texts, ys = [], []
    if texts:
        yield texts, np.array(ys)


_PARTS = "block int, trainer bigint, part binary"


def _parts(found: Iterable[tuple[int, int, object]]) -> pa.RecordBatch:
    blocks, trainers, parts = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), pa.array(trainers, pa.int64()), pa.array([pickle.dumps(p) for p in parts], pa.binary())],
        names=["block", "trainer", "part"],
    )


def _merged(parts: DataFrame, merge: Callable[[list], object]) -> dict[int, object]:
    """One value for each block, of the values that the tasks have for it; blocks come to the driver, never a task's rows."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("trainer")
        found = merge([pickle.loads(p) for p in group["part"].to_pylist()])
        return pa.table({"block": group["block"][:1], "part": pa.array([pickle.dumps(found)], pa.binary())})

    rows = parts.groupBy("block").applyInArrow(run, "block int, part binary").collect()
    return {r["block"]: pickle.loads(bytes(r["part"])) for r in rows}


def _sums(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


def _means(parts: list) -> object:
    """Of a block, the mean of each bucket by how often the tasks touched it; of the other parameters, by the tasks' steps."""
    if isinstance(parts[0], dict):
        n = sum(p["steps"] for p in parts)
        return {k: sum(np.asarray(p[k]) * (p["steps"] / n) for p in parts) for k in parts[0] if k != "steps"}
    total, weights = np.zeros((BLOCK, DIM + 1)), np.zeros(BLOCK)
    for at, times, values in parts:
        total[at] += values * times[:, None]
        weights[at] += times
    at = np.flatnonzero(weights)
    return at.astype(np.int32), (total[at] / weights[at, None]).astype(np.float32)


def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``bucket_counts`` of all the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, totals = bucket_counts(texts_of(batches, BATCH))
        if totals.any():
            cut = [(i // BLOCK, 0, hits[:, i : i + BLOCK].astype(np.int32)) for i in range(0, BUCKETS, BLOCK)]
            yield _parts([*cut, (-1, 0, totals)])

    found = _merged(in_arrow(rows.select("_text", "_y"), run, _PARTS), _sums)
    totals = found.pop(-1, np.zeros(2, dtype=np.int64))
    return np.hstack([found[k] for k in sorted(found)]) if found else np.zeros((2, BUCKETS)), totals


def trained_round(rows: DataFrame, network: Network, squares: dict, times: int) -> tuple[Network, dict]:
    """Each partition's steps from the network given, ``times`` through its rows, and the mean of what they come to."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((vars(network), squares)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, own = pickle.loads(shared.value)
        trainer, vocabulary = Trainer(Network(**plain), own), Vocabulary()
        source, first = texts_of(batches, BATCH), None
        if times > 1:
            # rows are only gone through again where there are too few for LEAST_STEPS
            source = list(source) * times
        for texts, y in source:
            docs = vocabulary.numbered(texts)
            trainer.step(docs, vocabulary.rows, y)
            first = zlib.crc32(texts[0].encode("utf-8", "replace")) if first is None else first
        if trainer.steps:
            net, found = trainer.network, []
            for i in range(0, BUCKETS, BLOCK):
                at = np.flatnonzero(trainer.touches[i : i + BLOCK]).astype(np.int32)
                if len(at):
                    values = np.hstack([net.embeddings[i + at], own["e"][i + at, None]]).astype(np.float32)
                    found.append((i // BLOCK, first, (at, trainer.touches[i + at], values)))
            dense = {"steps": trainer.steps, "weights": net.weights, "start": net.start, **{k: v for k, v in own.items() if k != "e"}}
            dense |= {f"filters{k}": f for k, f in enumerate(net.filters)} | {f"biases{k}": b for k, b in enumerate(net.biases)}
            yield _parts([*found, (-1, first, dense)])

    found = _merged(in_arrow(rows.select("_text", "_y"), run, _PARTS), _means)
    shared.destroy()
    dense = found.pop(-1)
    for block, (at, values) in found.items():
        network.embeddings[block * BLOCK + at] = values[:, :DIM]
        squares["e"][block * BLOCK + at] = values[:, DIM]
    network.weights, network.start = dense["weights"], float(dense["start"])
    network.filters = [dense[f"filters{k}"] for k in range(len(WIDTHS))]
    network.biases = [dense[f"biases{k}"] for k in range(len(WIDTHS))]
    return network, {"e": squares["e"], **{k: float(dense[k]) for k in squares if k != "e"}}


def thresholds(rows: DataFrame, network: Network) -> dict[str, float]:
    """The threshold of all rows and of each language with enough of them, from counts of their logits in small steps."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(vars(network)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, vocabulary = Network(**pickle.loads(shared.value)), Vocabulary()
        for texts, y in texts_of(batches, BATCH):
            docs = vocabulary.numbered(texts)
            logits = pooled_texts(net, docs, vocabulary.rows)[1] @ net.weights + net.start
            steps = np.rint(np.clip(logits, -LARGEST_LOGIT, LARGEST_LOGIT) / LOGIT_STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language_of(t) for t in texts], pa.string()), pa.array(steps, pa.int32()), pa.array(y, pa.int32())], names=["lang", "step", "y"])

    found = in_arrow(rows.select("_text", "_y"), run, "lang string, step int, y int").groupBy("lang", "step", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    shared.destroy()
    langs = np.array([r["lang"] for r in found])
    x, y, n = (np.array([r[c] for r in found], dtype=np.int64) for c in ("step", "y", "n"))
    out = {"": best_threshold(x * LOGIT_STEP, y, n)}
    for lang in (*LETTERS, "other"):
        own = langs == lang
        if min(n[own & (y == 0)].sum(), n[own & (y == 1)].sum()) >= LEAST_CALIBRATION:
            out[lang] = best_threshold(x[own] * LOGIT_STEP, y[own], n[own])
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Learn from all labelled documents outside the held-out fold; None without both labels.

    The labelled texts are written once. Their rows are dealt to at most as
    many tasks as there are cores, which hold some rows at a time. What comes
    to the driver, and goes back to the tasks, is the network.
    """
    rows = labelled(docs, labels, id_col, text_col, label_col)
    held = F.pmod("_h", F.lit(CALIBRATION)) == 0
    sizes = rows.agg(F.count(F.lit(1)).alias("all"), F.sum("_y").alias("toxic"), F.sum((~held).cast("int")).alias("fitted")).first()
    if not sizes["toxic"] or sizes["toxic"] == sizes["all"]:
        return None
    fitted = sizes["fitted"]
    trainers = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, fitted // ROWS_A_TRAINER))
    own = rows.where(~held)
    own = own.coalesce(1).sortWithinPartitions("_h") if trainers == 1 else own.coalesce(trainers)
    hits, totals = counted(own)
    network, squares = first_network(hits, totals), Trainer.first_squares()
    if fitted:
        per_epoch = -(-fitted // BATCH)
        if per_epoch * EPOCHS >= LEAST_STEPS:
            passes = -(-TRAINER_STEPS // max(1, per_epoch // trainers))
            for _ in range(min(EPOCHS, max(2, passes))):
                network, squares = trained_round(own, network, squares, 1)
        else:
            network, squares = trained_round(own, network, squares, -(-LEAST_STEPS // per_epoch))
    network.thresholds = thresholds(rows.where(held), network)
    return network


def with_scores(docs: DataFrame, network: Network | None, keep: Sequence[str], name: str = "score", text_col: str = "text") -> DataFrame:
    """The columns to keep, and a score from 0 to 1 of each whole text.

    A null text counts as the empty one, whose score is that of no words.
    Without a network every score is 0. Repeated rows have equal scores; an
    empty table gives no rows.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").cast("binary").alias("_scored_text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, "double")
    if network is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            texts = (t or b"" for t in batch.column(batch.num_columns - 1).to_pylist())
            scores = scorer.scores([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*keep, name])

    return in_arrow(kept, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row; other columns are ignored."""
    scored = with_scores(docs, fit(docs, labels, id_col, text_col), [id_col], "score", text_col)
    return scored.select(
        id_col, held_out(F.col(id_col), FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not called toxic, with the columns they came with."""
    network = fit(docs, labels, id_col, text_col)

    def keep(rows: DataFrame) -> DataFrame:
        scored = with_scores(rows, network, rows.columns, "_toxicity_score", text_col)
        return scored.where(F.col("_toxicity_score") < 0.5).drop("_toxicity_score")

    return under_safe_names(docs, [id_col, text_col], keep)
