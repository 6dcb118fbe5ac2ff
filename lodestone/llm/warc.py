"""WARC archives: writing, and a sequential reader.

An archive holds one gzip member per record. Tasks write their archives to the
folder that the cluster shares, each attempt under names of its own, and return
which files they finished; only those are read, so that what a lost executor
left behind does not count. The reader inflates a file piece by piece, member
by member, takes a record's block by its Content-Length, and checks digests.

Of records with equal payloads of at least ``least`` bytes, that with the
largest id is written in full and the others as revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, shared_dir, slices

#: Payloads below this many bytes are never revisits. An archive is closed beyond ARCHIVE_BYTES.
LEAST, ARCHIVE_BYTES, READ_BYTES = 1000, 64 << 20, 1 << 20
#: Repeated payloads up to this many (32 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:record:"


class WarcError(ValueError):
    """An archive that does not keep to the format."""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def told(labelled: str | None) -> tuple[str, str | None] | None:
    """(algorithm, hex digits) of a digest header in base 32, base 64 or hex; no digits if its form is none of these; None without one."""
    if not labelled:
        return None
    kind, _, value = labelled.strip().rpartition(":")
    kind, value = kind.lower().replace("-", "") or "sha1", value.strip()
    if kind not in hashlib.algorithms_available:
        return kind, None
    size = hashlib.new(kind).digest_size
    if len(value) == 2 * size and set(value) <= set("0123456789abcdefABCDEF"):
        return kind, value.lower()
    for decode in (base64.b32decode, base64.b64decode):
        try:
            raw = decode(value.upper() if decode is base64.b32decode else value)
        except ValueError:
            continue
        if len(raw) == size:
            return kind, raw.hex()
    return kind, None


def agrees(labelled: str | None, data: bytes) -> bool:
    """Whether a digest header is that of ``data``; one that is absent or of an unknown form says nothing against it."""
    kind = told(labelled)
    return kind is None or kind[1] is None or hashlib.new(kind[0], data).hexdigest() == kind[1]


def record(headers: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(key: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """A page as a response, or as a revisit of record ``refers_to``, whose HTTP head still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{quote(key)}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if revisit:
        headers += [("WARC-Refers-To", f"<{URN}{quote(refers_to)}>"), ("WARC-Profile", PROFILE)]
    headers += [("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, http if revisit else http + payload)


class Members:
    """The gzip members of a file, inflated no further than is asked for: ``READ_BYTES`` of either side at a time."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.data, self.z = stream, b"", None

    def open(self) -> bool:
        """Begins the next member; False at the end of the file."""
        if not self.data:
            self.data = self.stream.read(READ_BYTES)
        self.z = zlib.decompressobj(31) if self.data else None
        return bool(self.data)

    def read(self, most: int) -> bytes:
        """Up to ``most`` more bytes of the member; none at its end."""
        while not self.z.eof:
            self.data = self.data or self.stream.read(READ_BYTES)
            if not self.data:
                raise WarcError("the last gzip member is cut off")
            try:
                out = self.z.decompress(self.data, min(most, READ_BYTES))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            self.data = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first of each; folded lines belong to the field before, lines without a colon to none."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        name, sep, value = line.partition(":")
        if line[:1] in (" ", "\t"):
            if last:
                out[last] = f"{out[last]} {line.strip()}".strip()
        elif sep and name.strip():
            last = name.strip().lower()
            if last in out:
                last = None
            else:
                out[last] = value.strip()
    return out


def records(stream: BinaryIO, most_head: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers by lower-case name, block, whether its digest is right) of each record of an archive.

    A block is read by its Content-Length, so that no more than a record is
    held. What breaks the framing raises: no WARC head, no length, a block that
    ends early, anything but line ends behind it.
    """
    member = Members(stream)
    while member.open():
        buffer = b""
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if len(buffer) > most_head or not (more := member.read(READ_BYTES)):
                raise WarcError("a member does not begin with a WARC head")
            buffer += more
        first, _, head = buffer[:end].partition(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise WarcError("a member does not begin with a WARC head")
        headers = fields(head)
        if not (size := headers.get("content-length", "")).isdecimal():
            raise WarcError("a record does not tell its length")
        parts, left = [buffer[end + 4 :]], int(size) + 4 - (len(buffer) - end - 4)
        while left > 0 and (more := member.read(left)):
            parts.append(more)
            left -= len(more)
        data = b"".join(parts)
        block, rest = data[: int(size)], data[int(size) :]
        while more := member.read(READ_BYTES):
            rest = (rest + more)[:64]
        if len(block) != int(size) or rest.strip(b"\r\n"):
            raise WarcError("a block does not have the length that its head tells")
        yield headers, block, agrees(headers.get("warc-block-digest"), block)


def unchunked(body: bytes) -> bytes:
    """The body that chunks spell; as it is if they are broken."""
    out, at = [], 0
    while True:
        line, sep, _ = body[at : at + 64].partition(b"\r\n")
        try:
            size = int(line.split(b";")[0].strip(), 16)
        except ValueError:
            return body
        at += len(line) + 2
        if not sep or size < 0 or at + size > len(body):
            return body
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + 2


def page(headers: dict[str, str], block: bytes, sound: bool) -> tuple[str | None, int | None, str | None, str, str | None, bytes | None, bool]:
    """(id, payload bytes, payload SHA-1 in hex, record type, id referred to, payload, verified) of a page's record.

    An HTTP response's payload is its body, chunks put together; that of other
    responses is the whole block. A revisit has the bytes and digest that its
    heads tell, null where they tell none.
    """
    key = lambda h: unquote(headers[h].strip("<>").removeprefix(URN)) if h in headers else None
    label, http = headers.get("warc-payload-digest"), {}
    body = block
    if headers.get("content-type", "application/http").lower().startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        http = fields(head.partition(b"\r\n")[2])
    size = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
    if headers["warc-type"] != "response":
        known = told(label)
        return key("warc-record-id"), size, known[1] if known and known[0] == "sha1" else None, headers["warc-type"], key("warc-refers-to"), None, sound
    chunked = "chunked" in http.get("transfer-encoding", "").lower()
    payload = unchunked(body) if chunked else body
    sound = sound and (chunked or size in (None, len(body))) and (agrees(label, payload) or agrees(label, body))
    return key("warc-record-id"), len(payload), hashlib.sha1(payload).hexdigest(), headers["warc-type"], key("warc-refers-to"), payload, sound


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, payload binary, refers_to): null payloads are empty. Of equal payloads all rows with the largest id are written in full.

    Ties: rows that share the largest id are all responses, and the others refer
    to that id. Rows without an id are responses. Repeated rows are records of
    their own, other columns play no part, payloads are taken whole.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.when(F.length("payload") >= least, F.unhex(F.sha1("payload"))))
    again = rows.filter(F.col("sha1").isNotNull()).groupBy("sha1").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    again = cut(again.filter(F.col("n") > 1).select("sha1", "last"))
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    # Payloads that are never revisits have keys of their own, longer than any digest, so that a shuffle does not bring them together.
    alone = F.concat(F.lit("-" * 21), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")
    return rows.withColumn("sha1", F.coalesce("sha1", alone)).join(again, "sha1", "left").select("id", "url", "payload", F.when(F.col("id") < F.col("last"), F.col("last")).alias("refers_to"))


def write(planned: DataFrame, folder: str | None = None, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of planned pages; (path, records, bytes) of each finished file, written once."""
    spark = planned.sparkSession
    root = f"{folder or shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        at = TaskContext.get()
        name, part, out, held, count = f"{at.partitionId():06d}-{at.taskAttemptId()}", 0, None, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{root}/{name}-{part}.warc.gz"], "records": [count], "bytes": [held]})

        for b in slices(batches, 2):
            for key, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out, held, count = store.open_output_stream(f"{base}/{name}-{part}.warc.gz", compression=None), 0, 0
                data = page_record("" if key is None else str(key), url, payload, None if refers_to is None else str(refers_to))
                out.write(data)
                held, count = held + len(data), count + 1
                if held >= most:
                    yield done()
                    out, part = None, part + 1
        if out is not None:
            yield done()

    return cut(planned.mapInArrow(run, "path string, records long, bytes long"))


def read(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(id string, payload_bytes, payload_digest, record_type, refers_to string, payload, verified) of every record of the archives.

    One file is read at a time and one record held; other than responses and
    revisits are passed over. A file that breaks the framing (see
    :func:`records`) raises; what a record may lack by the standard is null.
    """

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    some, held = [], 0
                    for headers, block, sound in records(stream):
                        if headers.get("warc-type") in ("response", "revisit"):
                            some.append(page(headers, block, sound))
                            held += len(block)
                        if held > 4 * READ_BYTES or len(some) >= 5000:
                            yield _batch(some)
                            some, held = [], 0
                    if some:
                        yield _batch(some)

    return files.select(path_col).mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, verified boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "verified"]
    return pa.RecordBatch.from_arrays([pa.array([None if i == 0 and r[0] == "" else r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def through_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes all pages and reads them back: (id_col, payload_bytes, payload_digest, record_type, refers_to, verified).

    Null ids come back null and refer to nothing; no rows give no archives.
    """
    kind = pages.select(id_col).schema[0].dataType
    got = read(write(plan(pages, id_col, url_col, payload_col, least)))
    return got.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "verified")
