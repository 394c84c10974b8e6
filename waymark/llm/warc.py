"""WARC records in ZIP packages: written by Spark, read back by ranges.

A package is a ZIP archive with two stored members, `archive/data.warc` and `indexes/index.cdx` (a line `offset length` for each record). The
reader takes the end of a file, parses the central directory (with its ZIP64 forms), finds where the stored members begin, reads the
index, and then each record by its range; nothing is extracted, and memory holds one record at a time.

Packages are written with Spark's own file writer (a package is a row, and a row is a file), so any store that Spark knows will do, and tasks that are run
again leave no second copy. The line end that the writer adds is the archive's comment.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is a response and the others are revisits that refer to it; smaller ones are
all responses. Defined results: a null payload is empty; a null url has an empty target; line ends in a url are percent-encoded. Rows that repeat the largest
page_id are responses each. A row with a null page_id revisits the largest page_id of its payload, and is a response if there is none. Payloads may have any length up
to 2 GB. Other columns aren't read. An empty table gives no package and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import stash

PACKAGE_BYTES = 8_000_000
DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; for a revisit payload isn't stored, only its HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def package(records: list[bytes], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members, with a line end as its comment."""
    out, at, lines = io.BytesIO(), 0, []
    for r in records:
        lines.append(f"{at} {len(r)}\n")
        at += len(r)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((DATA, records), (INDEX, [x.encode() for x in lines])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as member:
                for part in parts:
                    member.write(part)
        z.comment = b"\n"
    return out.getvalue()


class Ranges:
    """Reads ranges of a file of a store that Arrow knows, or of bytes at hand."""

    def __init__(self, at: str | bytes):
        if isinstance(at, bytes):
            self.file, self.size = pa.BufferReader(at), len(at)
        else:
            store, path = pyarrow.fs.FileSystem.from_uri(uri(at))
            self.file = store.open_input_file(path)
            self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError("the archive is shorter than its directory says")
        return got


def uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def members(file: Ranges) -> dict[str, tuple[int, int, int]]:
    """For each member of a ZIP archive: its local header's offset, its stored size, its method. Follows ZIP64 records where a field is full."""
    tail_at = max(0, file.size - 65_557)
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP archive")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, at):
        mark, _, wide = struct.unpack("<4sIQ", file.read(tail_at + end - 20, 16))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        count, size, at = struct.unpack_from("<QQQ", file.read(wide, 56), 32)
    directory, i, found = file.read(at, size), 0, {}
    for _ in range(count):
        if directory[i : i + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, = struct.unpack_from("<H", directory, i + 10)
        stored, plain, n, extra, comment = struct.unpack_from("<IIHHH", directory, i + 20)
        offset, = struct.unpack_from("<I", directory, i + 42)
        name, j, to = directory[i + 46 : i + 46 + n].decode(), i + 46 + n, i + 46 + n + extra
        while j + 4 <= to:
            kind, length = struct.unpack_from("<HH", directory, j)
            if kind == 1:  # the full fields, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", directory, j + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            j += 4 + length
        found[name] = (offset, stored, method)
        i = to + comment
    return found


def stored_at(file: Ranges, member: tuple[int, int, int]) -> int:
    """Where the bytes of a stored member begin."""
    offset, _, method = member
    if method != 0:
        raise ValueError("only stored members can be read by ranges")
    head = file.read(offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("a broken local header")
    return offset + 30 + sum(struct.unpack_from("<HH", head, 26))


def records(file: Ranges) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC headers (names in lower case) and block of every record that the index lists."""
    found = members(file)
    base, index = stored_at(file, found[DATA]), found[INDEX]
    for line in file.read(stored_at(file, index), index[1]).splitlines():
        at, n = map(int, line.split())
        head, _, rest = file.read(base + at, n).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        yield fields, rest[: int(fields["content-length"])]


def write_pages(pages: DataFrame, path: str, least: int = 0, package_bytes: int = PACKAGE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Packages of WARC records for all pages, in the folder path."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    shared = rows.select("sha1", "size", "page_id").where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    shared = stash(shared.where("n > 1").select(F.col("sha1").alias("same"), F.col("size").alias("alike"), "response"), "payloads")
    rows = rows.join(shared, (F.col("sha1") == F.col("same")) & (F.col("size") == F.col("alike")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    rows = rows.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "sha1", "size", refers.alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, sha1, size, refers_to = (c[i].as_py() for c in batch.columns)
                held.append(record(page_id, url, payload or b"", base64.b32encode(sha1).decode(), size, refers_to))
                n += len(held[-1])
                if n >= package_bytes:
                    yield one(held)
                    held, n = [], 0
        if held:
            yield one(held)

    def one(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([package(held).removesuffix(b"\n")], pa.binary())], names=["value"])

    packages = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packages.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest of every record of the packages in path.

    Digest and size of a response are taken from what was read; those of a revisit stand in its headers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    try:
        pyarrow.fs.FileSystem.from_uri(uri(path if ":/" in path else f"file://{path}"))
        files = files.select("path")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # a store that only Spark knows: packages come whole, PACKAGE_BYTES each
        files = files.select("content")

    def number(name: str) -> int | None:
        own = name.removeprefix("<urn:page:").removesuffix(">")
        return int(own) if own else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for where in batch.column(0):
                out, n = [], 0
                for head, block in records(Ranges(where.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if head["warc-type"] == "response":
                        own = (None, payload, len(payload), base32_sha1(payload))
                    else:
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        own = (number(head["warc-refers-to"]), None, size, head["warc-payload-digest"].removeprefix("sha1:"))
                    out.append((number(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], *own))
                    n += len(block)
                    if n > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out, n = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")
