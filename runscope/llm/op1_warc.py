"""Web archives packed in ZIP files: records written, indexed, and read by range.

An archive is a ZIP file of two stored (not compressed) members: WARC records, each a gzip member
of its own, and an index with a line per record. A reader parses the end of the file, the ZIP64
end record if there is one, and the central directory; it finds where the members' bytes begin
from their local headers, reads the index, and then reads records by range. Nothing is extracted.

Pages with equal payloads of ``min_revisit_bytes`` or more are stored once: the one with the
largest id is the response, others revisit it and repeat its headers only. Null payloads are
empty; pages with a null id count as smaller than all others; several rows of the keeping id are
all responses. Archives go to the shared folder, and the list of those of successful
tasks is written before anything reads them, so a repeated task does no harm. Long payloads are whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from runscope.joins import join_per_key
from runscope.llm.common import pieces
from runscope.llm.tables import written
from runscope.session import fresh_path

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads from this size are stored once.
MIN_REVISIT_BYTES = 1000
#: An archive is closed beyond so many bytes of records. A range read covers neighbours up to so many.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Compressed records that a reading task gets, about.
TASK_BYTES = 16 << 20
#: Keepers of repeated payloads are broadcast up to this size, else joined by shuffle.
BROADCAST_BYTES = 8 << 20

# fixed by the formats
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, payload: bytes, keeper: int | None) -> tuple[str, bytes]:
    """The type and the bytes of a page's record; ``keeper``: the page it revisits."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if keeper is None else "revisit"
    block = head + (payload if keeper is None else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
        *([] if keeper is None else [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{keeper}>")]),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    header = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return kind, header.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record. ``payload`` is None for a revisit; the digest of a response is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    page_id = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    refers_to = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
        raise ValueError(f"damaged record of page {page_id}")
    return {
        "page_id": int(page_id) if page_id else None, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "refers_to": int(refers_to) if refers_to else None, "payload_bytes": size, "payload_digest": digest.hex(),
        "payload": None if revisit else payload,
    }


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, by its scheme."""
    return fs.FileSystem.from_uri(path)


def _marked(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """``pages(page_id, url, html)`` with ``keeper``: the page whose payload it repeats, or null."""
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    keepers = (
        rows.where(F.col("size") >= min_revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1 and kept is not null")
        .drop("n")
    )
    marked = join_per_key(rows, keepers, ["digest", "size"], "left", BROADCAST_BYTES)
    return marked.select("page_id", "url", "payload", F.when(~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept")).alias("keeper"))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; the written list ``(path, records)``."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row for piece in pieces(batches, "payload") for row in zip(*(c.to_pylist() for c in piece.columns), strict=True)
        )
        row = next(rows, None)
        while row is not None:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            files, place = open_path(path)
            files.create_dir(place.rpartition("/")[0])
            lines, at = [], 0
            # a member of unknown size, so sizes are 64 bits wide and behind the data
            with files.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(RECORDS, "w", force_zip64=True) as member:
                    while row is not None and (at < ARCHIVE_BYTES or not lines):
                        kind, plain = record(*row)
                        data = gzip.compress(plain, 1, mtime=0)
                        member.write(data)
                        lines.append(f"{'' if row[0] is None else row[0]} {kind} {at} {len(data)}\n")
                        at += len(data)
                        row = next(rows, None)
                archive.writestr(INDEX, "".join(lines))
            yield pa.record_batch([pa.array([path]), pa.array([len(lines)], pa.int64())], ["path", "records"])

    table = fresh_path(spark, "archives")
    _marked(pages, min_revisit_bytes).mapInArrow(run, "path string, records long").write.parquet(table)
    return spark.read.parquet(table)


def members(source) -> dict[str, tuple[int, int]]:
    """Name → (offset of the bytes, size) of the stored members of a ZIP file open for random reads."""
    size = source.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(_END)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP file")
    n, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == _LOCATOR:
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record64 = source.read_at(56, at)
        if record64[:4] != _END64:
            raise ValueError("damaged ZIP64 end record")
        n, length, offset = struct.unpack_from("<QQQ", record64, 32)
    directory, at, found = source.read_at(length, offset), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", directory, at + 20)
        start, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_size].decode()
        extra, e = directory[at + 46 + name_size : at + 46 + name_size + extra_size], 0
        while e + 4 <= len(extra):
            kind, extent = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit values of those fields that have no room
                wide = iter(struct.unpack_from(f"<{extent // 8}Q", extra, e + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                start = next(wide) if start == 0xFFFFFFFF else start
            e += 4 + extent
        if method == 0:
            local = source.read_at(30, start)
            if local[:4] != _LOCAL:
                raise ValueError("damaged local header")
            found[name] = (start + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + name_size + extra_size + comment_size
    return found


def index_of(archives: DataFrame) -> DataFrame:
    """``archives(path)`` → one row per record: where its bytes lie in the archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = open_path(path)
                with files.open_input_file(place) as source:
                    where = members(source)
                    base, size = where[RECORDS]
                    begin, length = where[INDEX]
                    lines = source.read_at(length, begin).decode().splitlines()
                rows = [line.rsplit(" ", 3) for line in lines]
                at = [int(r[2]) for r in rows]
                sizes = [int(r[3]) for r in rows]
                if any(a + s > size for a, s in zip(at, sizes, strict=True)):
                    raise ValueError(f"the index of {path} points past its records")
                yield pa.record_batch(
                    [pa.array([path] * len(rows)), pa.array([base + a for a in at], pa.int64()), pa.array(sizes, pa.int64())],
                    ["path", "offset", "length"],
                )

    return archives.select("path").mapInArrow(run, "path string, offset long, length long")


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ``archives(path)``, read by range; neighbours in an archive share a read."""
    # ranges of about READ_BYTES go to any task, in order within it; the index says little of how much there is
    # to read, so its own size must not decide the number of tasks
    index = written(index_of(archives), "record-index")
    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / READ_BYTES)
    ranges = index.repartition(max(1, -(-total // TASK_BYTES)), "path", stretch).sortWithinPartitions("path", "offset")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            begin = 0
            while begin < len(rows):
                path, start, _ = rows[begin]
                end = begin + 1
                while end < len(rows) and rows[end][0] == path and rows[end][1] == sum(rows[end - 1][1:]) and rows[end][1] - start < READ_BYTES:
                    end += 1
                files, place = open_path(path)
                with files.open_input_file(place) as source:
                    data = source.read_at(sum(rows[end - 1][1:]) - start, start)
                found = [parse_record(zlib.decompress(data[a - start : a - start + n], 31)) for _, a, n in rows[begin:end]]
                yield pa.record_batch([pa.array([f[c] for f in found], _KINDS[c]) for c in names], names)
                begin = end

    return ranges.mapInArrow(run, ", ".join(f"{c} {_SQL[c]}" for c in names))


_KINDS = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
}
_SQL = {
    "page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_bytes": "long",
    "payload_digest": "string", "payload": "binary",
}


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, and what their records say when read back."""
    archives = write_archives(pages, fresh_path(spark, "warc"))
    records = read_records(archives, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
