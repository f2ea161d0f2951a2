"""WARC derivatives: a metadata and a conversion record for each response record.

A response is (record_id, target_uri, date, http_headers, payload), and may have the payload_digest and
block_digest that its own record states. Both derivatives name it in WARC-Refers-To and keep its URI and
date. The metadata record, which is WARC-Concurrent-To it, has its identifier, its digests, as stated or else
worked out from its bytes, its HTTP header lines, and the conversion record's identifier; the conversion record's
block is the payload as plain text. Identifiers are name-based UUIDs, so that a task that runs again makes the
same records. Digests that are made here are SHA-1 in base 32. WARC files are read and written record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.arrow_text import slices
from voxlake.llm.html import plain_text, title
from voxlake.llm.tables import quoted
from voxlake.operators.components import cut
from voxlake.sources.formats import Path

EOL = "\r\n"
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
COLUMNS = ("warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "block_digest", "headers", "block")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
SOURCE = ("record_id", "target_uri", "date", "http_headers")
DIGESTS = ("payload_digest", "block_digest")
RAW = "path string, warc_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, block_digest string, headers string, block binary"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:\-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def one_line(value: str) -> str:
    """A header value can't hold a line break: each becomes a space."""
    return " ".join(value.splitlines())


def record(kind: str, own: str, source: str, concurrent: str | None, uri: str, date: str, content_type: str, block: str) -> tuple[str | None, ...]:
    data = block.encode("utf-8", "surrogatepass")
    mark = digest(data)
    headers = EOL.join(
        ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Refers-To: {source}", *([f"WARC-Concurrent-To: {concurrent}"] if concurrent else []), f"WARC-Target-URI: {uri}"]
        + [f"WARC-Refers-To-Target-URI: {uri}", f"WARC-Refers-To-Date: {date}", f"WARC-Date: {date}", f"WARC-Block-Digest: {mark}", f"Content-Type: {content_type}", f"Content-Length: {len(data)}"]
    )
    return kind, own, source, concurrent, uri, date, content_type, mark, headers, block


def decoded(payload: bytes | str, http_headers: str) -> str:
    """A payload as text, by the charset that its headers or its first kilobyte name, else as UTF-8; what doesn't fit becomes U+FFFD."""
    if isinstance(payload, str):
        return payload
    found = _CHARSET.search(http_headers) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derive(source: str, uri: str, date: str, http_headers: str, payload: bytes | str, payload_digest: str | None = None, block_digest: str | None = None) -> tuple[tuple[str | None, ...], tuple[str | None, ...]]:
    """The metadata and the conversion record of a response. No value of it can add a header line."""
    data = payload.encode("utf-8", "surrogatepass") if isinstance(payload, str) else payload
    html = decoded(payload, http_headers)
    source, uri, date = one_line(source), one_line(uri), one_line(date)
    meta, text = record_id(source + "#metadata"), record_id(source + "#conversion")
    lines = [line for line in http_headers.splitlines() if line.strip()]
    own_payload = payload_digest or digest(data)
    own_block = block_digest or digest(EOL.join([*lines, "", ""]).encode("utf-8", "surrogatepass") + data)
    fields = [("source-record-id", source), ("source-payload-digest", own_payload), ("source-block-digest", own_block), ("conversion-record-id", text), ("title", title(html))]
    fields += [("http-status-line", lines[0])] if lines else []
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.append(("http-header-" + name.strip().lower(), value.strip()))
    block = "".join(f"{k}: {one_line(v)}{EOL}" for k, v in fields)
    return (
        record("metadata", meta, source, source, uri, date, "application/warc-fields", block),
        record("conversion", text, source, None, uri, date, "text/plain; charset=utf-8", plain_text(html)),
    )


def derivatives(responses: DataFrame, keep: str | None = None) -> DataFrame:
    """Two rows for each response: COLUMNS, with the column `keep` of the response in front if given.

    responses has record_id, target_uri, date and http_headers as strings, payload as a string or bytes, and may have
    payload_digest and block_digest. A null record_id is named after the URI and payload; a null or empty date is 1970;
    other nulls count as empty. Empty, binary and very long payloads are converted like others; line breaks in
    values become spaces. Repeated rows give repeated records, and an empty table none. Other columns are ignored, whatever
    their names. A keep that has the name of one of COLUMNS is an error.
    """
    if keep in COLUMNS:
        raise ValueError(f"{keep} is a column of the records")
    binary = responses.schema["payload"].dataType.simpleString() == "binary"
    own = [F.col(c).cast("string") for c in SOURCE] + [F.col("payload").cast("binary" if binary else "string")]
    own += [F.col(c).cast("string") if c in responses.columns else F.lit(None).cast("string") for c in DIGESTS]
    rows = responses.select(*[c.alias(f"c{k}") for k, c in enumerate(own)], *([F.col(quoted(keep)).alias("kept")] if keep else []))
    lead = f"{quoted(keep)} {rows.schema['kept'].dataType.simpleString()}, " if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "c4", 4 << 20):
                made, which = [], []
                for n, (source, uri, date, headers, payload, *digests) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)):
                    uri, payload = uri or "", payload or ""
                    data = payload if isinstance(payload, bytes) else payload.encode("utf-8", "surrogatepass")
                    made += derive(source or record_id(uri + digest(data)), uri, date or DATE, headers or "", payload, *digests)
                    which += [n, n]
                columns = [pa.array([r[k] for r in made], pa.string()) for k in range(len(COLUMNS))]
                if keep:
                    columns.insert(0, batch.column(7).take(pa.array(which, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [*([keep] if keep else []), *COLUMNS])

    return rows.mapInArrow(run, lead + SCHEMA)


def page_responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages (page_id, url, html), with page_id."""
    name = F.concat_ws("#", F.col("page_id").cast("string"), "url")
    mark = F.md5(name)
    part = lambda a, n: F.substring(mark, a, n)
    return pages.select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")).alias("http_headers"),
        F.col("html").alias("payload"),
    )


def serialised(row) -> bytes:
    """A row of derivatives as the bytes of a WARC record."""
    return (row["headers"] + EOL + EOL).encode("utf-8", "surrogatepass") + row["block"].encode("utf-8", "surrogatepass") + b"\r\n\r\n"


# files


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], str, bytes]]:
    """(fields by lower-case name, header lines, block) of the records of an uncompressed WARC stream, one held at a time."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            if line[:1] in b" \t":  # a value goes on
                head[-1] = head[-1].rstrip() + b" " + line.lstrip()
            else:
                head.append(line)
        lines = [x.decode("utf-8", "replace").rstrip("\r\n") for x in head]
        fields: dict[str, str] = {}
        for x in lines[1:]:
            name, _, value = x.partition(":")
            fields.setdefault(name.strip().lower(), value.strip())
        size = int(fields.get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record is cut off")
        yield fields, EOL.join(lines), block


def read_warc(spark: SparkSession, glob: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """(path, warc_type, record_id, target_uri, date, content_type, payload_digest, block_digest, headers, block) of every record.

    A task reads a file from its beginning to its end as a stream, gzip members one after another, and never holds more
    than some megabytes of it, or one record.
    """
    names = ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-type", "warc-payload-digest", "warc-block-digest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = Path(path if "://" in path else "/" + path.removeprefix("file:").lstrip("/")).parts()
                with fs.open_input_stream(at, compression=None) as plain:
                    stream = io.BufferedReader(plain, 1 << 20)
                    if stream.peek(2)[:2] == b"\x1f\x8b":
                        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
                    rows, held = [], 0
                    for fields, headers, block in records(stream):
                        rows.append((path, *(fields.get(n) for n in names), headers, block))
                        held += len(block)
                        if held > batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 9 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], [f.split()[0] for f in RAW.split(", ")])
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 9 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], [f.split()[0] for f in RAW.split(", ")])

    # the contents aren't read here: only paths are selected
    paths = spark.read.format("binaryFile").load(glob).select("path")
    return paths.mapInArrow(read, RAW)


def responses(raw: DataFrame) -> DataFrame:
    """Rows of read_warc that are responses, as derivatives takes them: HTTP headers and payload apart, digests as stated."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, bodies = [], []
            for block in batch.column(5).to_pylist():
                found = re.search(rb"\r?\n\r?\n", block or b"")
                heads.append((block[: found.start()] if found else b"").decode("utf-8", "replace"))
                bodies.append(block[found.end() :] if found else block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(heads, pa.string()), pa.array(bodies, pa.binary())], ["record_id", "target_uri", "date", "payload_digest", "block_digest", "http_headers", "payload"])

    rows = raw.where("warc_type = 'response'").select("record_id", "target_uri", "date", "payload_digest", "block_digest", "block")
    return rows.mapInArrow(split, "record_id string, target_uri string, date string, payload_digest string, block_digest string, http_headers string, payload binary")


def write_warc(made: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Rows of derivatives as WARC files, one a partition, each record in a gzip member of its own; returns (name, n) of the files.

    A file begins with a warcinfo record. It is written beside and renamed into place, so that a task may run again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"part-{TaskContext.get().partitionId():05d}.warc" + (".gz" if compress else ""), 0
        fs, at = Path(path).parts()
        fs.create_dir(at, recursive=True)
        part = f"{at}/.{name}.{uuid.uuid4().hex}.part"
        pack = (lambda b: gzip.compress(b, mtime=0)) if compress else bytes
        with fs.open_output_stream(part, compression=None) as f:
            info = b"format: WARC File Format 1.1\r\n"
            head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(info)}", "", ""]
            f.write(pack(EOL.join(head).encode() + info + b"\r\n\r\n"))
            for batch in batches:
                for headers, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    f.write(pack(serialised({"headers": headers, "block": block})))
                    n += 1
        fs.move(part, f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["name", "n"])

    return cut(made.select("headers", "block").mapInArrow(write, "name string, n long"))
