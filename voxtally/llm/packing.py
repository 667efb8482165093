"""Token ids packed into rows of one width, by best fit decreasing.

Documents longer than a row are cut into whole rows and a rest, so that no id
is lost. The pieces of a shard are placed longest first, each into the open
row with the least room that still holds it; a segment tree over the amounts
of room finds that row in logarithmic time. A shard is as many neighbouring
documents of a partition as make up ``shard_tokens`` ids, which bounds a
task's memory whatever the partition's size; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxtally.llm import bpe
from voxtally.llm.common import by_rows

WIDTH = 2048
SHARD_TOKENS = 1 << 21
#: The free id after the vocabulary: it ends documents and fills up rows.
END_ID = 50_256


class Rooms:
    """Open rows by the room they have left, as a segment tree of counts."""

    def __init__(self, width: int):
        self._leaves = 1 << width.bit_length()
        self._counts = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self._leaves
        while at:
            self._counts[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self._rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, and that room."""
        at = need + self._leaves
        if not self._counts[at]:
            while at > 1 and (at & 1 or not self._counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self._leaves:
                at = 2 * at if self._counts[2 * at] else 2 * at + 1
        room = at - self._leaves
        self._add(room, -1)
        return self._rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; equally long pieces keep their order."""
    rows: list[list[int]] = []
    rooms = Rooms(width)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[piece]
        found = rooms.take(need)
        if found is None:
            rows.append([piece])
            row, room = len(rows) - 1, width
        else:
            row, room = found
            rows[row].append(piece)
        if room > need:
            rooms.put(row, room - need)
    return rows


Piece = tuple[object, int, np.ndarray]


def _packed(pieces: list[Piece], width: int, fill: int, name: str) -> Iterator[tuple]:
    for k, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], width)):
        ends = np.cumsum([len(pieces[i][2]) for i in row])
        ids = np.full(width, fill, dtype="<u4")
        ids[: ends[-1]] = np.concatenate([pieces[i][2] for i in row])
        yield (
            f"{name}-{k}", int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()],
            [pieces[i][0] for i in row], [pieces[i][1] for i in row],
        )


def pack(
    docs: DataFrame, width: int = WIDTH, vocabulary: str = bpe.VOCABULARY, end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per packed row of the id matrix.

    ``row_id`` string; ``n_tokens`` int, the ids that are not filling;
    ``ids`` binary, ``width`` little-endian unsigned 32-bit integers;
    ``cu_seqlens`` array<int>, 0 and the end of each segment; ``resets``
    array<int>, where positions start at 0 again; ``doc_ids``, and
    ``doc_offsets`` array<bigint>, the place of a segment's first id in its
    document. The segments of a document, by offset, are its ids and one end
    id: a null or empty text is the end id alone. Repeated rows are packed as
    often as they occur, a null id stays null, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        own = bpe.codec(bpe._path(vocabulary))
        part, shard, held = TaskContext.get().partitionId(), 0, 0
        pieces: list[Piece] = []
        for row in rows:
            ids = np.append(own.encode((row["_text"] or b"").decode("utf-8", "replace")), np.uint32(end_id))
            pieces += [(row["_id"], at, ids[at : at + width]) for at in range(0, len(ids), width)]
            held += len(ids)
            if held >= shard_tokens:
                yield from _packed(pieces, width, end_id, f"{part}-{shard}")
                pieces, held, shard = [], 0, shard + 1
        yield from _packed(pieces, width, end_id, f"{part}-{shard}")

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    return by_rows(
        narrow,
        "row_id string, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>,"
        f" doc_ids array<{kind}>, doc_offsets array<bigint>",
        run,
    )
