"""WARC archives, index first: every record's file, offset, length, URL and digest are written beside the archive;
a read sorts the index rows that it wants, joins neighbouring byte ranges and fetches each joined range once.

Archives are WARC/1.1 with one gzip member per record, so a byte range of the index is a record by itself. A record
whose payload another record holds is a ``revisit``: it carries the HTTP head (with the payload's length) and the
digest, and refers to the record that holds the payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, small, table, tasks

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
#: Up to so many repeated digests (20 bytes and an id each) go to the pages; beyond, pages and digests are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Schemes of Hadoop that Arrow's file systems know by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_DATE = "1970-01-01T00:00:00Z"


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``sha1`` (hex) and ``refers_to``: null for the record that holds its payload, else the page that does.

    Of equal payloads of ``min_bytes`` or more, the largest page_id holds it. Rows that repeat that page_id all hold it.
    A null page_id counts as below all others. Counting is partial before the shuffle. The html does not move, unless more
    than MOST_BROADCAST digests repeat; then Spark splits skewed digests.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    repeated = materialise(
        pages.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("sha1", "holder")
    )
    few = repeated.count() <= MOST_BROADCAST
    refers = F.when(F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder"))
    return pages.join(F.broadcast(repeated) if few else repeated.hint("merge"), "sha1", "left").select("page_id", "url", "html", "sha1", refers.alias("refers_to"))


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder, and the folder in it; Hadoop's names of schemes are understood."""
    scheme, mark, rest = folder.partition("://")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """The bytes of one record before compression. Its id is made from its place, so that rows that repeat a page differ."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    target = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of one record; the digest of a payload at hand is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda v: int(v) if v else None
    out = {"page_id": number(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = number(fields["X-Refers-To-Page"])
    else:
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
            raise ValueError(f"record {out['page_id']}: its payload does not match its length and digest")
        out["payload"] = payload
    return out


def write_archives(pages: DataFrame, folder: str, max_file_bytes: int = 1 << 30) -> DataFrame:
    """Writes one record per row of ``deduplicated`` pages into ``folder`` and returns the index.

    Each task writes its own files under a name that no other attempt takes and renames them when they are complete; only
    attempts that succeed are in the index, which is itself written to the shared folder before it is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        rows: list[tuple] = []
        out, name, at = None, "", 0

        def closed() -> pa.RecordBatch:
            out.close()
            fs.move(f"{base}/{name}.open", f"{base}/{name}")
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in small(batches):
            for page_id, url, html, sha1, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}.open", compression=None)
                digest = base64.b32encode(sha1).decode()
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, html, digest, refers, f"{name}:{at}")) + z.flush()
                out.write(data)
                rows.append((page_id, url, name, at, len(data), digest, "response" if refers is None else "revisit", refers))
                at += len(data)
                if at >= max_file_bytes:
                    yield closed()
                    out, rows = None, []
        if out is not None:
            yield closed()

    given = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"), "sha1", "refers_to")
    return materialise(given.mapInArrow(run, INDEX))


def read_archives(index: DataFrame, folder: str, max_gap: int = 1 << 16, max_range: int = 1 << 23) -> DataFrame:
    """The records of the index rows given, each fetched by its byte range.

    Rows are dealt by (file, offset) so that a task holds neighbours; ranges closer than ``max_gap`` are fetched as one of
    at most ``max_range`` bytes (a longer record is fetched alone).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        opened: tuple[str, object] | None = None

        def fetched(name: str, group: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal opened
            if opened is None or opened[0] != name:
                opened = (name, fs.open_input_file(f"{base}/{name}"))
            first, last = group[0][0], max(a + n for a, n in group)
            data = memoryview(opened[1].read_at(last - first, first))
            got = [parsed(zlib.decompress(data[a - first : a - first + n], 31)) for a, n in group]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], k) for c, k in zip(names, kinds, strict=True)], names=names)

        name, group, end = None, [], 0
        for batch in batches:
            for f, a, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if group and (f != name or a > end + max_gap or a + n - group[0][0] > max_range):
                    yield fetched(name, group)
                    group = []
                name, end = f, a + n
                group.append((a, n))
        if group:
            yield fetched(name, group)

    dealt = index.select("file", "offset", "length").repartitionByRange(tasks(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives all pages and reads all of them back through the index.

    Null html is an empty payload, a null url is written as empty; rows that repeat a page_id are records of their own;
    payloads of any length are kept whole; other columns are ignored; an empty table gives an empty result.
    """
    folder = folder or f"{scratch(pages.sparkSession)}/warc"
    return read_archives(write_archives(deduplicated(pages), folder), folder)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
