"""WARC archives: written as one gzip member per record, read back in sequence.

The writer finds equal payloads by their SHA-256 on narrow rows, composes records and gathers them into
archives of bounded size. The archives are files in the folder, written by Spark's own sink, so a task
that is repeated leaves one copy and any file system will do. The reader inflates an archive step by
step, cuts records by their Content-Length and checks every digest. A revisit names its response by
record id; ``resolve`` looks that up.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from soundcheck.session import shared_path

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20  # an archive ends with the record that reaches this
CHUNK = 1 << 16  # bytes inflated at a time
MAX_HEADER = 1 << 20  # a longer header is damage
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
DATE = "1970-01-01T00:00:00Z"
# An empty member ends each archive, so the sink's line end is part of the format.
LAST_MEMBER = gzip.compress(b"", mtime=0)
MEMBER = b"\x1f\x8b\x08"

RECORDS = ("archive string, member_offset long, record_id string, record_type string, page_id string, uri string, payload_bytes long, "
           "payload_digest string, refers_to_id string, error string")


# -- writing -------------------------------------------------------------------------------------

def record_id(page: str, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name a response that another task writes."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page} {digest}')}>"


def record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None, first_url: str | None) -> bytes:
    """One record: a response, or, when ``first`` is the page with the same payload, a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page or "", digest)),
              ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if url is not None:
        fields.append(("WARC-Target-URI", safe(url)))
    if page is not None:
        fields.append(("X-Page-ID", safe(page)))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Date", DATE)]
        if first_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", safe(first_url)))
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def safe(value: str) -> str:
    """A header value on one line: blanks, controls and other than ASCII as %XX."""
    return quote(value, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write one record per row of ``pages`` into archives in ``folder`` (by default a new one in the shared folder), and return it.

    The payload is the text in UTF-8, null and empty alike without bytes. Of the rows with equal payloads of at
    least ``min_revisit_bytes``, those with the smallest id are responses and the others revisit it; null ids
    come last, and rows that share the smallest id (or all have none) are all responses. A null url has
    no Target-URI. Long payloads are written whole. An empty table gives a folder without records. Other columns
    are not read.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    # Copies are combined map-side, so a payload that a third of the pages have is one row per task here.
    firsts = (rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest")
              .agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1 AND first IS NOT NULL").select("digest", "first"))
    found = rows.join(firsts, "digest", "left").select(
        F.col("id").cast("string").alias("id"), "url", "html", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("first.id")), F.col("first.id").cast("string")).alias("first"), F.col("first.url").alias("first_url"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, first, first_url = (c[i].as_py() for c in batch.columns)
                held.append(gzip.compress(record(page, url, html.encode(), digest, first, first_url), 6, mtime=0))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    archives = found.mapInArrow(gather, "archive binary").select(F.col("archive").cast("string"))  # the bytes as they are
    archives.write.options(encoding="ISO-8859-1", lineSep=LAST_MEMBER.decode("latin-1"), maxRecordsPerFile=1).text(folder)
    return folder


# -- reading -------------------------------------------------------------------------------------

class Damage(ValueError):
    """A record that can't be read as it was written."""


class Member:
    """One gzip member of an archive, inflated as it is read."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.inflater, self.ready = data, at, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate the next chunk; false at the member's end."""
        while not self.inflater.eof:
            given = self.inflater.unconsumed_tail or self.data[self.at:self.at + CHUNK]
            if not given:
                raise Damage("the archive ends inside a member")
            if not self.inflater.unconsumed_tail:
                self.at += len(given)
            try:
                out = self.inflater.decompress(given, CHUNK)
            except zlib.error as error:
                raise Damage(f"not a gzip member: {error}") from None
            if self.inflater.eof:
                self.at -= len(self.inflater.unused_data)
            if out:
                self.ready += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``."""
        while (found := self.ready.find(mark)) < 0:
            if len(self.ready) > MAX_HEADER:
                raise Damage("a header without end")
            if not self.more():
                raise Damage("the member ends inside a header")
        out, self.ready = self.ready[:found + len(mark)], self.ready[found + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in parts."""
        while n:
            if not self.ready and not self.more():
                raise Damage(f"{n} bytes short of Content-Length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part


HEADER_END = b"\r\n\r\n"


def header(lines: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the named fields, names in lower case."""
    first, *rest = lines[:-len(HEADER_END)].decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damage(f"no header field: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def read_record(member: Member, with_payload: bool) -> dict:
    """The record of a member; ``Damage`` where framing or a digest does not hold."""
    version, fields = header(member.until(HEADER_END))
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise Damage(f"not a record: {version[:80]}")
    if not re.fullmatch(r"[0-9]+", fields.get("content-length", "")):
        raise Damage("no Content-Length")
    block, payload, kept, head, n = hashlib.sha256(), hashlib.sha256(), [], b"", 0
    inside = "msgtype" not in fields.get("content-type", "")  # a block without an HTTP header is all payload
    for part in member.take(int(fields["content-length"])):
        block.update(part)
        if not inside:
            head += part
            if (end := head.find(HEADER_END)) < 0:
                if len(head) > MAX_HEADER:
                    raise Damage("an HTTP header without end")
                continue
            part, head, inside = head[end + 4:], head[:end + 4], True
        payload.update(part)
        n += len(part)
        if with_payload:
            kept.append(part)
    if b"".join(member.take(4)) != HEADER_END or member.ready or member.more():
        raise Damage("the record does not end where its Content-Length says")
    claimed = {k: fields[f"warc-{k}-digest"].lower() for k in ("block", "payload") if f"warc-{k}-digest" in fields}
    kind, digest = fields.get("warc-type", ""), payload.hexdigest()
    if claimed.get("block", "").startswith("sha256:") and claimed["block"] != f"sha256:{block.hexdigest()}":
        raise Damage("the block digest differs")
    if kind == "revisit":  # it stands for a payload that another record holds
        digest = claimed.get("payload", "").removeprefix("sha256:") or None
        length = header(head)[1].get("content-length", "") if head else ""
        n = int(length) if re.fullmatch(r"[0-9]+", length) else None
    elif claimed.get("payload", "").startswith("sha256:") and claimed["payload"] != f"sha256:{digest}":
        raise Damage("the payload digest differs")
    return dict(record_id=fields.get("warc-record-id"), record_type=kind or None, page_id=fields.get("x-page-id"),
                uri=fields.get("warc-target-uri"), payload_bytes=n, payload_digest=digest, refers_to_id=fields.get("warc-refers-to"),
                payload=b"".join(kept) if with_payload and kind != "revisit" else None)


def records(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """Every record of an archive in order, with its offset; a damaged one has ``error`` and reading goes on at the next member."""
    view, at = memoryview(data), 0
    while at < len(data):
        member = Member(view, at)
        try:
            if not member.ready and not member.more():  # an empty member holds no record
                at = member.at
                continue
            found, after = read_record(member, with_payload), member.at
            yield dict(found, member_offset=at, error=None)
        except Damage as damage:
            yield dict(member_offset=at, error=str(damage))
            after = data.find(MEMBER, at + 1)
            after = len(data) if after < 0 else after
        at = after


def read_warc(spark: SparkSession, folder: str, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``folder``: where it is, its ids, type, payload size and digest, error[, payload].

    A response's size and digest are measured; a revisit's are those it states. A member that is damaged, cut off, wrongly
    framed or has another digest is a row with ``error`` and nulls. A folder without records gives no rows.
    """
    schema = RECORDS + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string()) for c in schema.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in records(content.as_py(), with_payload):
                    rows.append(dict(row, archive=path.as_py()))
                    size += len(row.get("payload") or b"")
                    if len(rows) >= 1000 or size > CHUNK << 6:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(read, schema).withColumn("page_id", F.col("page_id").try_cast(id_type))


def resolve(found: DataFrame) -> DataFrame:
    """Records with ``refers_to`` (the response's page id) for revisits; ``error`` tells one whose response is absent or differs.

    Several responses may have one record id (rows that repeat a page); any of them answers.
    """
    targets = found.where("record_type = 'response'").groupBy("record_id").agg(
        F.min("page_id").alias("refers_to"), F.min("payload_digest").alias("_digest"), F.min("payload_bytes").alias("_bytes"))
    joined = found.join(targets.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    wrong = (F.col("record_type") == "revisit") & ~(F.col("_digest").eqNullSafe(F.col("payload_digest"))
                                                    & F.col("_bytes").eqNullSafe(F.col("payload_bytes")))
    return joined.withColumn("error", F.coalesce("error", F.when(wrong, F.lit("no response with this payload")))).drop("_digest", "_bytes")
