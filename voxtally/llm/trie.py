"""The trie of conversation prefixes: who shares how many first turns with whom.

Turns are sorted by conversation and order, and each gets the digest of the
prefix that ends with it, a rolling hash of two 61-bit halves. Rolling hashes
can be joined, so a conversation may run over several partitions: what each
partition ends with is one row, and the next ones are put right from it.

A count-min sketch then counts all prefix digests in a table of bounded size.
Where its estimate is one, the prefix belongs to one conversation alone, and so
does every longer one: these tails are finished where they stand. Only
prefixes that may be shared are shuffled and grouped exactly, so the sketch
decides how much is shuffled and never what comes out.

Sums over a subtree need no walk: each node is charged to its smallest member,
and a node's subtree is what is charged to its members from its depth on.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.llm.common import in_arrow
from voxtally.operators.ordering import with_running_total
from voxtally.session import materialize

PRIME = (1 << 61) - 1
#: Bases of the two halves of a prefix digest.
BASES = (0x0F3A95C1D7B2E469, 0x1B7D03E5A9C8642F)
#: The sketch: rows, cells for each prefix, and the most cells of a row (2**27 bits a row, 64 MB in all).
SKETCH_ROWS = 4
CELLS_PER_PREFIX = 4
MAX_CELLS = 1 << 27
_BLOCK = 1 << 15  # cells of a block of the sketch, the unit that is summed up
#: Members' ids are joined to texts of about so many bytes before a node's texts meet.
SEGMENT_BYTES = 1 << 16
ROWS_AT_ONCE = 8192

_TURN = "conv_id bigint, pos bigint, n_turns bigint, h1 bigint, h2 bigint, n_bytes bigint"
_SCANNED = (
    "conv_id bigint, pos bigint, n_turns bigint, h1 bigint, h2 bigint, n_bytes bigint,"
    " p1 bigint, p2 bigint, q1 bigint, q2 bigint, part int, last boolean"
)
_KEY = ["depth", "p1", "p2"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: bytes, text: bytes) -> tuple[int, int]:
    raw = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little") % PRIME, int.from_bytes(raw[8:], "little") % PRIME


def joined_digest(left: tuple[int, int], right: tuple[int, int], n_right: int) -> tuple[int, int]:
    """The digest of a prefix followed by ``n_right`` turns with the digest ``right``."""
    return tuple((a * pow(b, n_right, PRIME) + c) % PRIME for a, b, c in zip(left, BASES, right))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    for row in rows:
        done.append(row)
        if len(done) == ROWS_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(","))])


def _values(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].to_pylist() for n in names))


def _scan(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Position and prefix digest of each turn within its conversation, by one pass over sorted partitions.

    A partition's first conversation may have begun before it: its rows are
    numbered from the partition's start and carry the partition's number. The
    last row of each partition (``last``) says what the partition ends with.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("conv_id"), *order]
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    hashed = "role" not in rows.columns
    names = ["conv_id", "n_turns", "n_bytes", "h1", "h2"] if hashed else ["conv_id", "role", "text"]
    schema = _arrow(_SCANNED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            now, pos, prefix, head, held = None, 0, (0, 0), True, None
            for row in _values(batches, names):
                if hashed:
                    conv, n_turns, n_bytes, *turn = row
                else:
                    role, text = (x.encode("utf-8", "surrogatepass") for x in row[1:])
                    conv, n_turns, n_bytes, turn = row[0], None, len(text), turn_digest(role, text)
                if conv != now:
                    head = now is None
                    now, pos, prefix = conv, 0, (0, 0)
                before, prefix, pos = prefix, joined_digest(prefix, turn, 1), pos + 1
                if held:
                    yield (*held, False)
                held = (conv, pos, n_turns, *turn, n_bytes, *prefix, *before, part if head else ~part)
            if held:
                yield (*held, True)

        return _batches(rows(), schema)

    # texts come in small batches
    return materialize(ranged.mapInArrow(scan, _SCANNED) if hashed else in_arrow(ranged, scan, _SCANNED), "turns")


def _carried(ends: list[tuple]) -> dict[int, tuple[int, int, tuple[int, int]]]:
    """What each partition's first conversation brought along: ``part -> (conv_id, turns, digest)``.

    ``ends`` has ``(part, whole, first conv_id, last conv_id, pos, digest)`` of each
    partition with rows, ``whole`` if it holds one conversation only.
    """
    carried = {}
    state = None
    for part, whole, first, last, pos, digest in sorted(ends):
        if state and state[0] == first:
            carried[part] = state
            if whole:
                pos, digest = state[1] + pos, joined_digest(state[2], digest, pos)
        state = (last, pos, digest)
    return carried


def _put_right(scanned: DataFrame) -> Callable[[tuple], tuple]:
    """A function that puts right the rows of a partition's first conversation.

    One row for each partition comes to the driver.
    """
    ends = [
        (r["part"] if r["part"] >= 0 else ~r["part"], r["part"] >= 0, r["conv_id"], r["pos"], (r["p1"], r["p2"]))
        for r in scanned.where("last").collect()
    ]
    firsts = dict(scanned.where("part >= 0 and pos = 1").select("part", "conv_id").collect())
    carried = _carried([(part, whole, firsts[part], conv, pos, digest) for part, whole, conv, pos, digest in ends])

    def right(row: tuple) -> tuple:
        conv, pos, n_turns, h1, h2, n_bytes, p1, p2, q1, q2, part = row
        if part in carried:
            _, turns, digest = carried[part]
            p1, p2 = joined_digest(digest, (p1, p2), pos)
            q1, q2 = joined_digest(digest, (q1, q2), pos - 1)
            pos += turns
        return conv, pos, n_turns, h1, h2, n_bytes, p1, p2, q1, q2

    return right


_NAMES = _SCANNED.replace(" bigint", "").replace(" int", "").replace(" boolean", "").replace(" ", "").split(",")[:-1]


def numbered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, pos, n_turns, h1, h2, n_bytes)``: turns as digests with their place, from 1.

    Turns are ordered by number (null first), then role, then text; a null
    role or text is the empty one; repeated rows are turns of their own. Rows
    without a conversation take no part. ``n_turns`` is null here. Other columns
    are ignored.
    """
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    )
    scanned = _scan(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    right = _put_right(scanned)
    schema = _arrow(_TURN)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((right(row)[:6] for row in _values(batches, _NAMES)), schema)

    return materialize(scanned.mapInArrow(place, _TURN), "numbered")


def conversation_sizes(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of each conversation."""
    return materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")), "conversations")


def with_borrowed_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Give each conversation c the first turns of another one, in place of its own.

    With h the crc32 of c in decimal, modulo ``heads``: the first h turns of
    conversation c - c % family (all if fewer, none if it is absent), then the
    turns of c after its own first h. Returns the turns, and ``(conv_id,
    n_turns)`` of all conversations, those that are left without turns
    included.
    """
    sizes = conversation_sizes(turns)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    base = F.col("conv_id") - F.col("conv_id") % family
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    plan = sizes.select("conv_id", F.col("n_turns").alias("n_own"), h.alias("h"), base.alias("base")).join(lent, "base", "left")
    n_head = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = plan.select("conv_id", "base", "h", n_head.alias("n_head"), (n_head + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n"))
    plan = materialize(plan, "heads")
    columns = ["conv_id", "pos", F.col("n").alias("n_turns"), "h1", "h2", "n_bytes"]
    rest = turns.drop("n_turns").join(plan, "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("n_head"))
    # at most heads - 1 turns of a conversation are lent, to family conversations at most
    borrowed = turns.drop("n_turns").where(F.col("pos") < heads).withColumnRenamed("conv_id", "base").join(plan, "base").where("pos <= n_head")
    rebuilt = materialize(rest.select(*columns).unionByName(borrowed.select(*columns)), "rebuilt")
    return rebuilt, plan.select("conv_id", F.col("n").alias("n_turns"))


# --- the sketch ---------------------------------------------------------------


def _cells(p1: np.ndarray, p2: np.ndarray, depth: np.ndarray, width: int) -> list[np.ndarray]:
    """A cell of each row of the sketch; ``width`` is a power of two."""
    out = []
    for i in range(SKETCH_ROWS):
        mixed = p1.astype(np.uint64) * np.uint64(2 * (0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D * i & (1 << 62) - 1) + 1)
        mixed ^= (p2.astype(np.uint64) + depth.astype(np.uint64)) * np.uint64(2 * (0xC2B2AE3D27D4EB4F * (i + 1) & (1 << 62) - 1) + 1)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(32)) & np.uint64(width - 1))
    return out


def sketch_width(prefixes: int) -> int:
    return min(MAX_CELLS, max(_BLOCK, 1 << math.ceil(math.log2(max(1, prefixes) * CELLS_PER_PREFIX))))


class Sketch:
    """Which cells count two prefixes or more; all that an estimate of one needs."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.bits = np.zeros((SKETCH_ROWS, width // 8), dtype=np.uint8)

    def alone(self, p1: np.ndarray, p2: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Whether the estimate of each prefix is one."""
        out = np.zeros(len(p1), dtype=bool)
        for row, cell in zip(self.bits, _cells(p1, p2, depth, self.width)):
            out |= (row[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 0
        return out


def _counted(prefixes: DataFrame, width: int) -> Sketch:
    """Count all prefixes, up to two, in partial sketches that are added block by block.

    The driver gets one bit a cell: 64 MB at most, whatever the input.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SKETCH_ROWS, width), dtype=np.uint8)
        for b in batches:
            columns = (b[c].to_numpy() for c in ("p1", "p2", "depth"))
            for row, cell in zip(counts, _cells(*columns, width)):
                at, n = np.unique(cell, return_counts=True)
                row[at] = np.minimum(2, row[at] + n)
        for i, row in enumerate(counts):
            for j in range(0, width, _BLOCK):
                block = row[j : j + _BLOCK]
                if block.any():
                    packed = np.packbits(block >= 1, bitorder="little").tobytes() + np.packbits(block >= 2, bitorder="little").tobytes()
                    yield pa.RecordBatch.from_pydict({"row": pa.array([i], pa.int32()), "block": pa.array([j // _BLOCK], pa.int32()), "bits": [zlib.compress(packed, 1)]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a stream of the parts of one block after another
        now, ones, twos = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"row": pa.array([now[0]], pa.int32()), "block": pa.array([now[1]], pa.int32()), "bits": [zlib.compress(twos.tobytes(), 1)]})

        for row, block, bits in _values(batches, ["row", "block", "bits"]):
            one, two = np.frombuffer(zlib.decompress(bits), dtype=np.uint8).reshape(2, -1)
            if now == (row, block):
                twos = twos | two | (ones & one)
                ones = ones | one
            else:
                if now:
                    yield done()
                now, ones, twos = (row, block), one, two
        if now:
            yield done()

    ddl = "row int, block int, bits binary"
    parts = prefixes.mapInArrow(partial, ddl).repartition("row", "block").sortWithinPartitions("row", "block")
    sketch = Sketch(width)
    for r in materialize(parts.mapInArrow(added, ddl), "sketch").toLocalIterator():
        at = r["block"] * _BLOCK // 8
        sketch.bits[r["row"], at : at + _BLOCK // 8] = np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8)
    return sketch


# --- nodes --------------------------------------------------------------------

_SCREENED = (
    "conv_id bigint, depth bigint, n_bytes bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint,"
    " final boolean, alone boolean, top boolean, ends_sha256 string"
)


def _screened(prefixes: DataFrame, sketch: Sketch) -> DataFrame:
    """Finish the prefixes of one conversation alone; the others may be shared.

    ``top`` is the first of a tail, as far as its partition shows.
    """
    shared = prefixes.sparkSession.sparkContext.broadcast(sketch)
    schema = _arrow(_SCREENED)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (None, 0)  # the last prefix that was alone

        def rows(b: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal before
            alone = shared.value.alone(*(b[c].to_numpy() for c in ("p1", "p2", "depth")))
            names = ["conv_id", "depth", "n_turns", "n_bytes", "p1", "p2", "q1", "q2"]
            for single, row in zip(alone.tolist(), zip(*(b[c].to_pylist() for c in names))):
                conv, depth, n_turns, n_bytes, *digests = row
                follows = before == (conv, depth - 1)
                ends = None
                if single or follows:
                    before = (conv, depth)
                    ends = hashlib.sha256(str(conv).encode()).hexdigest() if depth == n_turns else _NO_ENDS
                yield (conv, depth, n_bytes, *digests, depth == n_turns, single or follows, (single or follows) and not follows, ends)

        for b in batches:
            yield from _batches(rows(b), schema)

    return materialize(prefixes.mapInArrow(screen, _SCREENED), "screened")


def _ends(members: DataFrame) -> DataFrame:
    """``(depth, p1, p2, ends_sha256)``: the digest of the ids that end at a node, joined by commas.

    A node's ids are range-partitioned with the others, so those that very
    many conversations end at are joined in parts; only such parts meet again,
    to be hashed in order, one after another.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "depth bigint, p1 bigint, p2 bigint, first_id bigint, part binary, ends_sha256 string"
    schema = _arrow(ddl)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, first, ids, size, whole = None, None, [], 0, False
            for *key, conv in _values(batches, [*_KEY, "conv_id"]):
                if key != now or size >= SEGMENT_BYTES:
                    if now:
                        # a whole node lies between two others of this partition
                        done = whole and key != now
                        text = ",".join(ids).encode()
                        yield (*now, first, None if done else text, hashlib.sha256(text).hexdigest() if done else None)
                    whole = key != now and now is not None
                    now, first, ids, size = key, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if now:
                yield (*now, first, ",".join(ids).encode(), None)

        return _batches(rows(), schema)

    keys = [*_KEY, "conv_id"]
    parts = materialize(members.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(join_ids, ddl), "ends")
    out = "depth bigint, p1 bigint, p2 bigint, ends_sha256 string"
    out_schema = _arrow(out)

    def hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, digest = None, None
            for *key, part in _values(batches, [*_KEY, "part"]):
                if key != now:
                    if now:
                        yield (*now, digest.hexdigest())
                    now, digest = key, hashlib.sha256(part)
                else:
                    digest.update(b"," + part)
            if now:
                yield (*now, digest.hexdigest())

        return _batches(rows(), out_schema)

    split = parts.where("part is not null").repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first_id")
    return parts.where("part is null").select(*_KEY, "ends_sha256").unionByName(split.mapInArrow(hash_parts, out))


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``: each different sequence of first turns, from
    the empty one. ``conv_id`` is the smallest member; ``saved_tokens`` sums, over
    the subtree, the bytes of the last text for every member but one;
    ``ends_sha256`` digests the ids, in ascending order, of the members with no
    further turn.

    ``turns`` are as ``numbered_turns`` gives them, with ``n_turns`` of their
    conversation; ``sizes`` has ``(conv_id, n_turns)`` of every conversation,
    those without turns included. No conversation gives no node.
    """
    scanned = _scan(turns, [F.col("pos")])
    right = _put_right(scanned)
    ddl = "conv_id bigint, depth bigint, n_turns bigint, n_bytes bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint"
    schema = _arrow(ddl)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row in _values(batches, _NAMES):
                conv, pos, n_turns, _, _, n_bytes, *digests = right(row)
                yield (conv, pos, n_turns, n_bytes, *digests)

        return _batches(rows(), schema)

    prefixes = materialize(scanned.mapInArrow(settle, ddl), "prefixes")
    screened = _screened(prefixes, _counted(prefixes, sketch_width(prefixes.count())))

    zero = F.lit(0).cast("bigint")
    roots = sizes.select(
        "conv_id", zero.alias("depth"), zero.alias("n_bytes"), zero.alias("p1"), zero.alias("p2"),
        F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"), (F.col("n_turns") == 0).alias("final"),
    )
    tails = screened.where("alone")
    members = screened.where("not alone").select(*roots.columns).unionByName(roots)
    grouped = members.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    nodes = materialize(grouped.withColumn("saves", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")

    # children: each shared node and each top of a tail is one of its parent
    born = nodes.select("depth", "q1", "q2").unionByName(tails.where("top").select("depth", "q1", "q2")).where("depth > 0")
    children = born.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    children = children.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))

    # what is charged to a conversation from a depth on, as a running sum over all nodes
    summed = materialize(with_running_total(nodes, [F.col("conv_id"), F.col("depth").desc()], "saves", "running"), "charged")
    leaf = (F.col("n_children") == 0).cast("bigint")
    charged = summed.groupBy("conv_id").agg(
        F.min(F.col("running") - F.col("saves")).alias("base"), F.max("running").alias("top_sum"), F.sum(leaf).alias("leaves")
    ).select("conv_id", "base", (F.col("top_sum") - F.col("base")).alias("charge"), "leaves")
    alone = tails.where("final").select("conv_id", zero.alias("base"), zero.alias("charge"), F.lit(1).cast("bigint").alias("leaves"))
    charged = materialize(
        charged.unionByName(alone).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("base", "charge", "leaves")]), "charges"
    )
    below = members.join(charged.where("charge > 0 or leaves > 0"), "conv_id").groupBy(*_KEY).agg(
        F.sum("charge").alias("charge"), F.sum("leaves").alias("n_leaves")
    )
    own = charged.select("conv_id", "base", F.col("charge").alias("own_charge"))
    whole = summed.join(below, _KEY, "left").join(own, "conv_id")
    # the smallest member's charge counts from this depth on only
    saved = F.coalesce("charge", zero) - F.col("own_charge") + F.col("running") - F.col("base")

    ends = _ends(members.where("final"))
    shared = whole.join(ends, _KEY, "left").select(
        "conv_id", "depth", "q1", "q2", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"), F.lit(True).alias("asks"),
    )
    one = F.lit(1).cast("bigint")
    single = tails.select(
        "conv_id", "depth", "q1", "q2", one.alias("n_convs"), F.when(F.col("final"), zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256", F.col("top").alias("asks"),
    )
    every = shared.unionByName(single)
    # a parent that is no shared node is of the same conversation alone
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    asking = every.where("asks and depth > 0").join(parents, ["depth", "q1", "q2"], "left")
    others = every.where("not asks or depth = 0").withColumn("parent", F.lit(None).cast("bigint"))
    out = asking.unionByName(others)
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
