"""WARC archives: writing pages as gzip members, and a splittable reader.

A writer task puts its records, one gzip member each, into files of its own in
the shared folder. Their names come back as rows; files of a task attempt that
failed are in no row and so are not read. The reader cuts files into byte
ranges. A task looks in its range for gzip magic, takes a candidate for a
record if it decodes to a WARC header, and owns the records that start in the
range; it reads the last one to its end. Text that decodes to nothing, other
members and a cut last member are passed over.

Of pages with equal payloads of MIN_REVISIT bytes or more, those with the
smallest id are responses and the others revisits of it, which carry the length
and digest of the payload but not its bytes. A missing payload is empty; a
missing url is left out of the header. Rows that repeat the smallest id are all
responses. A row without an id becomes a revisit if its payload occurs with one.
Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import join_unique

MIN_REVISIT = 100
FILE_BYTES = 1 << 28
RANGE_BYTES = 1 << 23
# Beyond so many ranges a task reads several.
MAX_TASKS = 20_000
CHUNK = 1 << 18
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NOT_IN_HEADER = re.compile(r"[\x00-\x20\x7F]")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a uri; local, object store or HDFS."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, digest, record_type and refers_to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html").withColumns(
        {"bytes": F.octet_length(payload).cast("long"), "digest": F.sha2(payload, 256)}
    )
    large = F.col("bytes") >= MIN_REVISIT
    # Payloads that occur once need no look-up, small ones meet nothing.
    key = F.when(large, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("small"), F.xxhash64("page_id")))
    rows = rows.withColumn("key", key)
    repeated = (
        rows.where(large).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    rows = join_unique(rows, repeated, "key", "n", "page_id", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.select(
        "page_id", "url", "html", "bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _name(page_id) -> str:
    return "" if page_id is None or page_id != page_id else str(page_id)


def record(page_id, url: str | None, html: str | None, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One record, not yet compressed."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{_name(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = NOT_IN_HEADER.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{_name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(typed: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``with_types`` and return path, bytes and records of each file.

    Lazy: settle the result, and the files it names are complete.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = store(folder)
        files.create_dir(top)
        out, done, count, size, name = None, [], 0, 0, ""
        columns = ["page_id", "url", "html", "digest", "record_type", "refers_to"]
        for batch in batches:
            for row in batch[columns].astype(object).itertuples(index=False, name=None):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, size = files.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                page_id, url, html, digest, kind, refers_to = row
                data = _member(record(page_id, url, html, digest, kind, refers_to, date))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    # Ids as text, since Pandas turns whole numbers with gaps into floats.
    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    return typed.withColumns(ids).mapInPandas(write, "path string, bytes long, records long")


def _read_member(file, at: int, size: int) -> tuple[bytes, int] | None:
    """Content and compressed length of the record at a place, None if there is none."""
    unpacker = zlib.decompressobj(31)
    parts, place, checked = [], at, False
    file.seek(at)
    step = 512
    while place < size and not unpacker.eof:
        data = file.read(step)
        if not data:
            return None
        place += len(data)
        step = CHUNK
        try:
            parts.append(unpacker.decompress(data))
        except zlib.error:
            return None
        if not checked:
            start = b"".join(parts)[:5]
            if not b"WARC/".startswith(start):
                return None
            checked = len(start) == 5
    if not (unpacker.eof and checked):
        return None
    return b"".join(parts), place - len(unpacker.unused_data) - at


def members(file, begin: int, end: int, size: int) -> Iterator[bytes]:
    """Contents of the records that start in a byte range."""
    at = begin
    while at < end:
        file.seek(at)
        data = file.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            break
        member = _read_member(file, at, size)
        if member is None:
            at += 1
        else:
            yield member[0]
            at += member[1]


def parse(content: bytes) -> dict:
    """Fields of a record; the payload of a revisit is None."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)content-length:\s*(\d+)", http)
    kind = fields["warc-type"]
    told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    whole = kind == "response"
    digest = hashlib.sha256(payload).hexdigest() if whole else told
    if whole and told and told != digest:
        raise ValueError(f"the payload of {fields.get('warc-record-id')} does not have its digest")
    name = lambda key: fields.get(key, "").removeprefix("<urn:page:").removesuffix(">") or None
    return {
        "page_id": name("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": len(payload) if whole else int(length[1]) if length else 0,
        "payload_digest": digest,
        "refers_to": name("warc-refers-to"),
        "payload": payload if whole else None,
    }


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of files given by path and bytes. Ids are text, as in the headers."""
    begins = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(begins).alias("begin"))
    # A stated number of tasks, which adaptive execution does not merge although the rows are few.
    number = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes)).alias("n")).first()["n"] or 1
    ranges = ranges.repartition(min(MAX_TASKS, number))
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    columns += ["payload"] if payloads else []

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, begin in batch[["path", "bytes", "begin"]].itertuples(index=False, name=None):
                system, place = store(path)
                with system.open_input_file(place) as file:
                    rows, held = [], 0
                    for content in members(file, begin, min(size, begin + range_bytes), size):
                        rows.append(parse(content))
                        held += len(content)
                        if held > 1 << 24:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=columns)

    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    return ranges.mapInPandas(read, schema + (", payload binary" if payloads else ""))
