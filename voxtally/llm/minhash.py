"""Near-duplicate documents by Order MinHash.

A document's k-mers are its runs of five words, each labelled with how often
the same run came before it, so that no label repeats. A hash function of the
sketch takes the two labelled k-mers with the smallest hashes, in the order
they have in the text; two texts agree in it if they share both and their
order. Two functions are a band; documents that agree in a band meet in its
bucket, and are candidates if they agree in two bands at least.

Texts with the same words are one document to begin with. A bucket gives no
list of all its pairs: small ones do, larger ones give a spanning tree of
their most alike documents and each document's nearest few, estimated from
the bands. Buckets over a bound are dealt into parts by a hash of the
document, and some of their documents go to all parts and tie them together.
What this leaves out is made up for once the classes are known: all pairs of a
larger bucket that agree in two bands and lie in different classes are verified
too, where they meet. So no candidate is lost, and a bucket that is one class
costs nothing more.

Candidates are verified by aligning their k-mer sequences. As labels do not
repeat, the longest common subsequence is the longest increasing run of
matched places; places that lie further apart than any alignment that passes
allows (the band) are left out first. The similarity is the share of aligned
k-mers among all, an ordered Jaccard index; links from 0.8 on are united.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.llm.common import by_rows, under_safe_names
from voxtally.llm.components import components
from voxtally.session import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
PER_BAND = 2
LEAST_BANDS = 2
SMALL_BUCKET = 8
BUCKET = 1024
ANCHORS = 32
NEAREST = 6
KNOWN_WORDS = 150_000
MARKS = 1 << 20
_FUNCTIONS = BANDS * PER_BAND
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_EDGES = "\"'.,;:!?()[]{}*#$%&<>-_…«»¿¡`~^=+|/\\"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_RNG = np.random.default_rng(2024)
_FLIPS = _RNG.integers(0, 1 << 63, _FUNCTIONS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 1 << 63, _FUNCTIONS, dtype=np.uint64) | np.uint64(1)


class Words:
    """Hashes of the words of texts: without case and outer punctuation, and without words of that alone."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def _hash(self, raw: str) -> int:
        plain = raw.lower().strip(_EDGES)
        value = int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1 if plain else 0
        if len(self._known) >= KNOWN_WORDS:
            self._known.clear()
        self._known[raw] = value
        return value

    def of(self, text: str) -> np.ndarray:
        known = self._known
        found = np.array([known[w] if w in known else self._hash(w) for w in text.split()], dtype=np.uint64)
        return found[found != 0]


def kmers(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Labelled k-mers in text order; a shorter text is one k-mer, an empty one has none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        label = np.zeros(n, dtype=np.uint64)
        label[order] = (at - first).astype(np.uint64)
        h = np.where(label > 0, _mix(h + label * np.uint64(0xD1B54A32D192ED03)), h)
    return h


def band_keys(labelled: np.ndarray) -> np.ndarray:
    """The keys of the sketch's bands."""
    n = len(labelled)
    entries = np.zeros(_FUNCTIONS, dtype=np.uint64)
    # a few functions at a time, so that long texts need little memory
    step = max(1, min(_FUNCTIONS, 400_000 // n))
    for at in range(0, _FUNCTIONS, step):
        v = (labelled[None, :] ^ _FLIPS[at : at + step, None]) * _FACTORS[at : at + step, None]
        rows = np.arange(len(v))
        one = v.argmin(1)
        if n > 1:
            v[rows, one] = _ALL
            two = v.argmin(1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            entries[at : at + step] = _mix(labelled[low] * np.uint64(3) + _mix(labelled[high]))
        else:
            entries[at : at + step] = labelled[one]
    pairs = entries.reshape(BANDS, PER_BAND)
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(PER_BAND):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + pairs[:, i])
    return keys


def longest_increasing(values: Sequence[int]) -> int:
    tops: list[int] = []
    for v in values:
        at = bisect_left(tops, v)
        if at == len(tops):
            tops.append(v)
        else:
            tops[at] = v
    return len(tops)


def aligned_share(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned k-mers among all of two sequences without repeats, or 0 where it is below ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    need = least * (n + m) / (1 + least)
    if len(i) < need - 1e-9:
        return 0.0
    # an alignment that passes leaves out fewer places than this of either text
    near = np.abs(i - j) <= max(n, m) - need + 1e-9
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    size = len(j) if (np.diff(j) > 0).all() else longest_increasing(j.tolist())
    share = size / (n + m - size)
    return share if share >= least - 1e-12 else 0.0


def bucket_pairs(short: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a bucket's documents to verify, from the keys of their bands (rows)."""
    m = len(short)
    agree = np.zeros((m, m), dtype=np.int16)
    for band in short.T:
        agree += band[:, None] == band[None, :]
    np.fill_diagonal(agree, -1)
    if m <= SMALL_BUCKET:
        found = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(agree >= LEAST_BANDS, 1)))}
        return sorted(found)
    found = set()
    # a tree that takes the most alike document next
    best, origin = agree[0].copy(), np.zeros(m, dtype=np.int64)
    inside = np.zeros(m, dtype=bool)
    inside[0] = True
    for _ in range(m - 1):
        at = int(np.where(inside, -2, best).argmax())
        if best[at] >= LEAST_BANDS:
            found.add((min(at, int(origin[at])), max(at, int(origin[at]))))
        inside[at] = True
        closer = agree[at] > best
        best[closer], origin[closer] = agree[at][closer], at
    for _ in range(NEAREST):
        at = agree.argmax(1)
        value = agree[np.arange(m), at]
        found |= {(min(i, int(j)), max(i, int(j))) for i, j in enumerate(at) if value[i] >= LEAST_BANDS}
        agree[np.arange(m), at] = -1
    return sorted(found)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _words, _keys, _short)``: a digest of all words, the bands' keys, and 16 bits of each."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        words = Words()
        for row in rows:
            found = words.of((row["_text"] or b"").decode("utf-8", "replace"))
            if len(found):
                keys = band_keys(kmers(found))
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                yield row["_id"], digest, keys.astype(np.int64).tolist(), (keys >> np.uint64(48)).astype("<u2").tobytes()
            else:
                yield row["_id"], None, None, None

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    return by_rows(narrow, f"_id {kind}, _words binary, _keys array<bigint>, _short binary", run)


def crowded_buckets(firsts: DataFrame) -> DataFrame:
    """``(_key, _n)`` of the buckets that are too large for ``bucket_pairs`` to give all their pairs."""
    counted = firsts.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > min(SMALL_BUCKET, BUCKET))


def candidate_pairs(firsts: DataFrame, crowded: DataFrame) -> DataFrame:
    """``(a, b)`` with a < b, of the sketches of different texts."""
    banded = firsts.select("_first", "_short", F.explode("_keys").alias("_key"))
    hot = crowded.where(F.col("_n") > BUCKET)
    split = banded.join(hot, "_key", "left")
    parts = F.ceil(F.col("_n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("_first", "_key"), parts).cast("int")
    anchor = F.pmod(F.xxhash64("_key", "_first"), F.ceil(F.col("_n") / ANCHORS)) == 0
    part = F.when(F.col("_n").isNull(), F.array(F.lit(0))).when(anchor, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    dealt = split.select("_key", F.explode(part).alias("_part"), "_first", "_short")
    ranged = dealt.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def pairs(ids: np.ndarray, short: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            low = 0
            for high in ends:
                if high - low > 1:
                    for i, j in bucket_pairs(short[low:high]):
                        a.append(ids[low + i])
                        b.append(ids[low + j])
                low = high
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [
                batch.column("_key").to_numpy(), batch.column("_part").to_numpy(), batch.column("_first").to_numpy(),
                np.frombuffer(b"".join(batch.column("_short").to_pylist()), dtype="<u2").reshape(-1, BANDS),
            ]
            rows = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
            key, part, ids, short = rows
            ends = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            whole = int(ends[-1]) if len(ends) else 0
            yield pairs(ids[:whole], short[:whole], ends)
            kept = [x[whole:] for x in rows]
        if kept is not None:
            yield pairs(kept[2], kept[3], np.array([len(kept[2])]))

    found = ranged.select("_key", "_part", "_first", "_short").mapInArrow(run, "a bigint, b bigint")
    # the rows of a bucket are sorted by id
    return found.where("a <> b").distinct()


def _mark(key: Column) -> Column:
    """One of a bounded number of hashes of an id."""
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(MARKS))


def labelled_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _seq)``: the labelled k-mers, 32 bits of each, of the documents whose ``_id`` is among ``ids``, and of few others."""
    # Which texts to read is told from a hash of their id, of which there are at most MARKS, so that
    # no text is shuffled; the few whose hash agrees by chance are aligned with nothing.
    marks = ids.select(_mark(F.col("_id")).alias("_mark")).distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    texts = texts.withColumn("_mark", _mark(F.col("_id"))).join(F.broadcast(marks), "_mark", "left_semi").select("_id", "_text")

    def labelled(rows: Iterator[dict]) -> Iterator[tuple]:
        words = Words()
        for row in rows:
            found = kmers(words.of((row["_text"] or b"").decode("utf-8", "replace")))
            yield row["_id"], (found >> np.uint64(32)).astype("<u4").tobytes()

    # an id that several rows have stands for each of their texts
    return materialize(by_rows(texts, "_id bigint, _seq binary", labelled), "sequences")


def verified_links(docs: DataFrame, pairs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose aligned share is large enough, from the texts of the documents in them."""
    sequences = labelled_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("_id")), id_col, text_col)
    left = pairs.join(sequences.toDF("a", "_x"), "a")
    both = left.join(sequences.toDF("b", "_y"), "b")

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            x, y = np.frombuffer(row["_x"], "<u4"), np.frombuffer(row["_y"], "<u4")
            if aligned_share(x, y, similarity):
                yield row["a"], row["b"]

    return by_rows(both.select("a", "b", "_x", "_y"), "a bigint, b bigint", run)


def links_apart(
    ids: np.ndarray, classes: np.ndarray, keys: np.ndarray, roles: np.ndarray, band: int, texts: list[np.ndarray], similarity: float
) -> list[tuple[int, int]]:
    """Links that unite classes, of the candidates that meet in a band's bucket.

    Pairs that agree in an earlier band are left to that band's bucket. If
    there are several roles, only pairs of different roles are compared.
    """
    agree, earlier = np.zeros((len(ids), len(ids)), dtype=np.int8), None
    for at, key in enumerate(keys.T):
        if at == band:
            earlier = agree > 0
        agree += key[:, None] == key[None, :]
    meet = np.triu((agree >= LEAST_BANDS) & ~earlier, 1)
    if (roles != roles[0]).any():
        meet &= roles[:, None] != roles[None, :]
    classes, links = classes.copy(), []
    for i in np.flatnonzero((meet & (classes[:, None] != classes[None, :])).any(1)):
        js = np.flatnonzero(meet[i])
        for j in js[np.argsort(-agree[i, js], kind="stable")]:
            if classes[i] != classes[j] and aligned_share(texts[i], texts[j], similarity):
                links.append((int(ids[i]), int(ids[j])))
                classes[classes == classes[j]] = classes[i]
    return links


def further_links(
    docs: DataFrame, firsts: DataFrame, crowded: DataFrame, classes: DataFrame, similarity: float, id_col: str, text_col: str
) -> DataFrame:
    """``(a, b)``: links that unite classes, from all candidates of crowded buckets that are in different classes.

    The largest class of a bucket is not compared with itself. The others are
    dealt into parts, which meet each other and the parts of the largest, so
    that no task gets a whole bucket. Tasks give links, never pairs.
    """
    marks = materialize(crowded.select(_mark(F.col("_key")).alias("_mark")).distinct(), "crowded-marks")
    banded = firsts.select("_first", F.posexplode("_keys").alias("_band", "_key"))
    banded = banded.withColumn("_mark", _mark(F.col("_key"))).join(F.broadcast(marks), "_mark", "left_semi").drop("_mark")
    placed = banded.join(crowded.select("_key"), "_key").join(classes.toDF("_first", "_class"), "_first", "left")
    placed = materialize(placed.withColumn("_class", F.coalesce("_class", "_first")), "crowded")
    sizes = placed.groupBy("_key", "_class").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.groupBy("_key").agg(
        F.max_by("_class", F.struct("_n", "_class")).alias("_main"), F.max("_n").alias("_most"), (F.sum("_n") - F.max("_n")).alias("_rest")
    )
    mains, rests = (F.ceil(F.col(c) / BUCKET).cast("int") for c in ("_most", "_rest"))
    several = sizes.where("_rest > 0").select("_key", "_main", mains.alias("_mains"), rests.alias("_rests"))
    rows = placed.join(materialize(several, "crowded-several"), "_key").withColumn("_is_main", F.col("_class") == F.col("_main"))
    own = F.pmod(F.xxhash64("_first", "_key"), F.when(F.col("_is_main"), F.col("_mains")).otherwise(F.col("_rests")))
    rows = rows.withColumn("_own", own.cast("int"))
    each_rest, each_main = F.sequence(F.lit(0), F.col("_rests") - 1), F.sequence(F.lit(0), F.col("_mains") - 1)
    # parts of the rest with each other, then with parts of the largest class
    tile = lambda kind, i, j, role: F.struct(F.xxhash64(F.col("_key"), F.lit(kind), i, j).alias("_tile"), role.alias("_role"))
    with_rest = F.transform(each_rest, lambda i: tile(0, F.least(i, F.col("_own")), F.greatest(i, F.col("_own")), F.col("_own")))
    with_main = F.transform(each_main, lambda j: tile(1, F.col("_own"), j, F.lit(-1)))
    from_main = F.transform(each_rest, lambda i: tile(1, i, F.col("_own"), F.lit(-2)))
    tiles = F.when(F.col("_is_main"), from_main).otherwise(F.concat(with_rest, with_main))
    dealt = materialize(rows.select("_first", "_class", "_band", F.explode(tiles).alias("_t")).select("_first", "_class", "_band", "_t.*"), "tiles")
    ids = dealt.select(F.col("_first").alias("_id")).distinct()
    sequences = labelled_texts(docs, ids, id_col, text_col).withColumnRenamed("_id", "_first")
    full = dealt.join(firsts.select("_first", "_keys"), "_first").join(sequences, "_first")

    def compare(group: pa.Table) -> pa.Table:
        keys = group["_keys"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        texts = [np.frombuffer(x, "<u4") for x in group["_seq"].to_pylist()]
        links = links_apart(group["_first"].to_numpy(), group["_class"].to_numpy(), keys, group["_role"].to_numpy(),
                            group["_band"][0].as_py(), texts, similarity)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("_tile").applyInArrow(compare, "a bigint, b bigint")


def near_documents(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, class_id bigint, kept boolean)``, one row per input row.

    The class is named by its smallest id, whose row is kept. Texts without a
    word, null texts included, are like nothing; neither are rows without an
    id, whose class is null and which are kept. Texts of fewer than five words
    are one k-mer. Rows that repeat an id are one document, with the texts of
    all of them. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sketched = materialize(sketches(docs, id_col, text_col), "sketches")
    known = sketched.where("_words is not null and _id is not null").withColumn("_id", F.col("_id").cast("bigint"))
    firsts = known.groupBy("_words").agg(
        F.min("_id").alias("_first"), F.first("_keys").alias("_keys"), F.first("_short").alias("_short")
    )
    firsts = materialize(firsts, "first-of-words")
    crowded = materialize(crowded_buckets(firsts), "crowded-buckets")
    pairs = materialize(candidate_pairs(firsts, crowded), "pairs")
    links = verified_links(docs, pairs, similarity, id_col, text_col)
    same = known.select("_id", "_words").join(firsts.select("_words", "_first"), "_words").select("_id", "_first")
    # copies hang on their first; only rows that repeat an id add links between the firsts
    repeated = same.distinct().groupBy("_id").agg(F.min("_first").alias("a"), F.max("_first").alias("b")).where("a <> b")
    classes = materialize(components(links.unionByName(repeated.select("a", "b"))), "classes")
    links = further_links(docs, firsts, crowded, classes, similarity, id_col, text_col)
    # a class is linked to its members, so that it is one with all that they are linked to now
    classes = materialize(components(links.unionByName(classes.toDF("a", "b"))), "all-classes")
    named = same.distinct().join(classes.toDF("_first", "_class"), "_first", "left")
    named = named.select("_id", F.coalesce("_class", "_first").alias("class_id")).groupBy("_id").agg(F.min("class_id").alias("class_id"))
    out = sketched.select(F.col("_id").cast("bigint").alias("_id")).join(named, "_id", "left")
    return out.select(
        F.col("_id").cast(kind).alias(id_col),
        F.coalesce("class_id", "_id").alias("class_id"),
        F.coalesce(F.col("class_id") == F.col("_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their columns, without all but one of each class.

    Of rows that repeat an id, one stays. Rows without an id stay.
    """
    return under_safe_names(docs, [id_col, text_col], lambda rows: _one_of_each(rows, similarity, id_col, text_col))


def _one_of_each(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    classes = near_documents(docs.where(F.col(id_col).isNotNull()), similarity, id_col, text_col)
    gone = materialize(classes.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct(), "duplicates")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = materialize(repeated.select(F.col(id_col).alias("_twice")), "repeated")
    # Only rows whose id has the hash of one of these are looked up, and so shuffled.
    doubtful = gone.toDF("_x").unionByName(repeated.toDF("_x"))
    marks = materialize(doubtful.select(_mark(F.col("_x")).alias("_mark")).distinct(), "marks")
    marked = docs.withColumn("_mark", _mark(F.col(id_col)))
    sure = marked.join(F.broadcast(marks), "_mark", "left_anti")
    near = marked.join(F.broadcast(marks), "_mark", "left_semi").join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    once = near.join(repeated, F.col(id_col) == F.col("_twice"), "left_anti")
    twice = near.join(repeated, F.col(id_col) == F.col("_twice"), "left_semi").dropDuplicates([id_col])
    columns = docs.columns
    return sure.select(*columns).unionByName(once.select(*columns)).unionByName(twice.select(*columns))
