"""WARC archives with an index, read back by byte ranges.

Writing comes first and leaves an index: file, offset, length, URL and digest
of each record. Reading takes rows of the index, sorts them by place, joins
neighbouring ranges into one read, and cuts the records out of it.

Each record is a gzip member of its own, so that a range of bytes is enough to
read it. A task writes to files that only its attempt uses, and the index has
those of the attempts that succeeded, so lost executors leave stray files but
no wrong entries. Files go through Arrow's file systems, by the same URI on
every machine.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.common import by_rows
from voxtally.session import materialize, scratch_dir

FILE_BYTES = 256 << 20
#: Archive bytes that one task reads.
TASK_BYTES = 128 << 20
MAX_GAP = 64 << 10
MAX_READ = 8 << 20
ROWS_AT_ONCE = 64
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_INDEX = (
    "file string, offset bigint, length bigint, url string, payload_digest string, page_id {kind}"
)


def _urn(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def _record(row: dict, digest: str) -> bytes:
    payload = row["_payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = row["_revisit"]
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(row["_page"])),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Payload-Length", str(len(payload))),
    ]
    if row["_url"] is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(row["_url"], safe="".join(map(chr, range(33, 127))))))
    if revisit:
        head += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", _urn(row["_first"])),
            ("X-Refers-To-Page", str(row["_first"])),
        ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _first_of_payload(pages: DataFrame, min_payload: int) -> DataFrame:
    """Digests of several rows, with the smallest page id of each.

    Counted before anything is shuffled by digest, so a payload that a third
    of all pages share is one row per task. Written once, so that Spark knows
    its size: small, it is broadcast and no page is shuffled; large, the join
    is a shuffle join whose skewed side AQE splits.
    """
    counted = pages.where(F.octet_length("_payload") >= min_payload).groupBy("_sha1")
    found = counted.agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return materialize(found.where("_n > 1 and _first is not null").drop("_n"), "payloads")


def write_archives(
    pages: DataFrame, folder: str | None = None, min_payload: int = 0,
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write one record per row, and return the index as a written table.

    ``(file, offset, length, url, payload_digest, page_id)``. A null payload
    is the empty one; a null url leaves the field out. Of rows with equal
    payloads of at least ``min_payload`` bytes, the one with the smallest id
    is the response (each row that repeats this id as well) and the others
    revisit it, rows without an id included; payloads that only rows without
    an id have are responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}"
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("_page"),
        F.col(url_col).cast("string").alias("_url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("_payload"),
    ).withColumn("_sha1", F.sha1("_payload"))
    marked = rows.join(_first_of_payload(rows, min_payload), "_sha1", "left").withColumn(
        "_revisit", F.col("_first").isNotNull() & ~F.col("_page").eqNullSafe(F.col("_first"))
    )

    def run(found: Iterator[dict]) -> Iterator[tuple]:
        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        try:
            for row in found:
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{top}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(row["_sha1"])).decode()
                packer = zlib.compressobj(3, wbits=31)
                member = packer.compress(_record(row, digest)) + packer.flush()
                out.write(member)
                yield name, at, len(member), row["_url"], digest, row["_page"]
                at += len(member)
        finally:
            if out is not None:
                out.close()

    index = materialize(by_rows(marked, _INDEX.format(kind=kind), run, ROWS_AT_ONCE), "warc-index")
    return index.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file")))


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    record = zlib.decompress(member, wbits=31)
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) < size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def coalesced(places: list[tuple[int, int]], max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> list[tuple[int, int, int]]:
    """Reads ``(start, end, number of records)`` that cover sorted ranges ``(offset, length)``."""
    reads: list[tuple[int, int, int]] = []
    for offset, length in places:
        end = offset + length
        if reads and offset - reads[-1][1] <= max_gap and end - reads[-1][0] <= max_read:
            reads[-1] = (reads[-1][0], max(end, reads[-1][1]), reads[-1][2] + 1)
        else:
            reads.append((offset, end, 1))
    return reads


def read_records(index: DataFrame) -> DataFrame:
    """The records of rows of an index, which may be any selection of them.

    ``(page_id, url, record_type, refers_to, payload, payload_bytes,
    payload_digest)``. Of a response, bytes and digest are computed from what
    was read, and a payload that differs from its digest fails the job; a
    revisit has no payload, and both are those that its fields name.
    """
    kind = index.schema["page_id"].dataType.simpleString()

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        opened, pending = "", []

        def flush(source) -> Iterator[tuple]:
            at = 0
            for start, end, n in coalesced([(r["offset"], r["length"]) for r in pending]):
                source.seek(start)
                data = source.read(end - start)
                for r in pending[at : at + n]:
                    low = r["offset"] - start
                    yield r, data[low : low + r["length"]]
                at += n

        def finish() -> Iterator[tuple]:
            if pending:
                files, path = fs.FileSystem.from_uri(opened)
                with files.open_input_file(path) as source:
                    for r, member in flush(source):
                        fields, payload = _parsed(member)
                        revisit = fields["WARC-Type"] == "revisit"
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if not revisit:
                            size = len(payload)
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                        yield (
                            r["page_id"], r["url"], fields["WARC-Type"], fields.get("X-Refers-To-Page"),
                            None if revisit else payload, size, digest,
                        )
                pending.clear()

        for row in rows:
            if row["file"] != opened or len(pending) >= 1024:
                yield from finish()
                opened = row["file"]
            pending.append(row)
        yield from finish()

    placed = index.select("file", "offset", "length", "url", "page_id")
    # tasks by the bytes of the records, not by those of the index
    whole = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-whole // TASK_BYTES))
    ranged = placed.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    out = by_rows(
        ranged,
        f"page_id {kind}, url string, record_type string, refers_to string, payload binary,"
        " payload_bytes bigint, payload_digest string",
        run,
        ROWS_AT_ONCE,
    )
    return out.withColumn("refers_to", F.col("refers_to").cast(kind))
