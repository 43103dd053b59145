"""Web archives: pages as ARC files, a converter of ARC to WARC, and a reader of WARC.

An ARC file opens with a version block, whose second line names the version and whose third the fields of every later
header line: five in version 1, ten in version 2. A header line is cut from the right, as old URLs may hold blanks, and its last
field declares the length of the block that follows. The converter reads a file record by record and synthesises what WARC asks for:
identifiers (UUIDs of the file's name and the record's number), timestamps (14 digits, or fewer in old files, as
ISO 8601), types (``warcinfo`` for version blocks, ``response`` for HTTP messages, ``resource`` for all else, ``revisit`` for payloads
that another record holds), and SHA-1 digests of block and payload. Records are gzip members of their own.

Which record holds a payload is decided by Spark over all archives: of equal payloads of at least ``least`` bytes, that of the largest
page id (ties: the last file and record). Digests alone are shuffled, a popular payload's rows by salted keys.

Files are written by tasks into the shared folder under names that no other attempt uses; those that count are listed in a
DataFrame cut from its lineage, so what a lost executor left behind is never read. A file ends at ``FILE_BYTES`` or ``FILE_RECORDS``,
and a task holds one record at a time.

Cases: a null url is a missing target (``-``); blanks and control characters in one are written as %XX; a null html is an empty payload; a null
page id stays null, and so does ``refers_to`` if the response's is; rows that repeat are records each; an ARC block that ends before its declared
length is marked ``WARC-Truncated``; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir

#: Payload bytes and records at which a file is closed.
FILE_BYTES, FILE_RECORDS = 64 << 20, 50_000
#: Rows that are handed on at a time, and parts that a popular payload's rows are joined in.
ROWS, SALTS = 512, 32
#: Header fields of both ARC versions, and the profile of a record without its payload.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def located(folder: str) -> tuple[files.FileSystem, str]:
    """The file system of a folder that Spark names, and the folder's path there."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return files.FileSystem.from_uri(folder)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso(digits: str, otherwise: str = "1970-01-01T00:00:00Z") -> str:
    """An ARC date of 4 to 14 digits as a WARC date; months and days that are missing or zero become 1."""
    m = re.fullmatch(r"(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?", digits)
    if not m or m[1] == "0000":
        return otherwise
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups())
    return f"{year:04d}-{max(1, min(month, 12)):02d}-{max(1, min(day, 31)):02d}T{min(hour, 23):02d}:{min(minute, 59):02d}:{min(second, 59):02d}Z"


# ARC ----------------------------------------------------------------------------------------------------------------


def arc_head(name: str, version: int, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 quillspan\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    return arc_line(version, fields, len(body)) + body + b"\n"


def arc_line(version: int, fields: dict[str, str], length: int) -> bytes:
    return (" ".join([fields.get(f, "-") for f in ARC_FIELDS[version][:-1]] + [str(length)]) + "\n").encode()


def arc_url(url: str | None) -> str:
    """A URL as one field: blanks and control characters as %XX, nothing as ``-``."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Header fields, block, and whether the block ends before its declared length, of each record of an ARC file.

    A version block, which a file may have several of, also has ``version``.
    """
    names = ARC_FIELDS[1]
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text.startswith("filedesc:"):  # its own line may have either number of fields
            names = ARC_FIELDS[1 if len(text.split(" ")) < len(ARC_FIELDS[2]) else 2]
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {text[:200]!r}")
        fields = dict(zip(names, parts, strict=True))
        length = int(parts[-1])
        block = stream.read(length)
        if text.startswith("filedesc:") and not block.startswith(b"HTTP/"):
            listed = block.decode("utf-8", "replace").splitlines()
            fields["version"] = listed[0].split(" ")[0] if listed else "1"
            if len(listed) > 1 and listed[1].split(" ")[-1].lower() == "archive-length":
                names = listed[1].split(" ")
        yield fields, block, len(block) < length


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, with the empty line that ends it, and its body."""
    ends = [(at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    cut_at = min(ends, default=len(block))
    return block[:cut_at], block[cut_at:]


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def write_arc(pages: DataFrame, folder: str, versions: tuple[int, ...] = (1, 2), date: str = "20000101000000") -> DataFrame:
    """``file`` and ``records`` of the ARC files that ``pages`` (page_id, url, html) are written to, of the versions in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        out, name, size, count, made = None, "", 0, 0, TaskContext.get().partitionId()  # tasks begin with different versions
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html = (batch.column(n)[row].as_py() for n in range(3))
                if out is None:
                    version, name = versions[made % len(versions)], f"{uuid.uuid4().hex}.arc.gz"
                    out, size, count, made = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0, made + 1
                    out.write(gzip.compress(arc_head(name, version, date), mtime=0))
                body = (html or "").encode()
                own = "" if page is None else f"X-Page-Id: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body
                fields = {"URL": arc_url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Offset": str(out.tell()), "Filename": name}
                out.write(gzip.compress(arc_line(version, fields, len(block)) + block + b"\n", mtime=0))
                size, count = size + len(body), count + 1
                if size >= FILE_BYTES or count >= FILE_RECORDS:
                    out.close()
                    out = None
                    yield _listed(name, count)
        if out is not None:
            out.close()
            yield _listed(name, count)

    located(folder)[0].create_dir(located(folder)[1], recursive=True)
    return cut(pages.select("page_id", "url", "html").mapInArrow(run, "file string, records long"))


def _listed(name: str, count: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64())})


# ARC to WARC --------------------------------------------------------------------------------------------------------


def record_id(name: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{n}')}>"


def scan_arc(listed: DataFrame, folder: str) -> DataFrame:
    """``file``, ``n``, ``page_id``, ``url``, ``date``, ``digest``, ``bytes`` of the HTTP messages in ARC files (``file``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with system.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for n, (fields, block, _) in enumerate(arc_records(stream)):
                        if block.startswith(b"HTTP/"):
                            head, body = http_payload(block)
                            page = http_header(head, "X-Page-Id")
                            rows.append((name, n, None if page is None else int(page), fields["URL"], iso(fields["Archive-date"]), sha1(body), len(body)))
                        if len(rows) >= ROWS:
                            yield _rows(rows, SCANNED)
                            rows = []
                if rows:
                    yield _rows(rows, SCANNED)

    return listed.select("file").mapInArrow(run, "file string, n long, page_id long, url string, date string, digest string, bytes long")


SCANNED = pa.schema([("file", pa.string()), ("n", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("bytes", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("target", pa.string()), ("date", pa.string()), ("truncated", pa.bool_())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def salted(left: DataFrame, right: DataFrame, key: str, salt: F.Column) -> DataFrame:
    """``left`` with the one row of ``right`` that has its key, or nulls: each key's rows in ``SALTS`` parts."""
    more = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(more, [key, "_salt"], "left").drop("_salt")


def convert(listed: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """``file`` and ``records`` of the WARC files made of the ARC files (``file``) in ``folder``, one each."""
    found = cut(scan_arc(listed, folder))
    held = found.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("copies"), F.max(F.struct("page_id", "file", "n", "url", "date")).alias("held"))
    held = held.where("copies > 1").drop("copies")
    enough = F.col("bytes") >= least
    same = (F.col("held.file") == F.col("file")) & (F.col("held.n") == F.col("n"))
    decided = salted(found, held, "digest", F.xxhash64("file", "n")).withColumn("held", F.when(enough & ~same, F.col("held")))

    def run(rows: pa.Table) -> pa.Table:
        system, root = located(folder)
        source = rows.column("file")[0].as_py()
        others = {n: h for n, h in zip(rows.column("n").to_pylist(), rows.column("held").to_pylist(), strict=True) if h}
        name = f"{source.removesuffix('.arc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
        count = 0
        with system.open_input_stream(f"{root}/{source}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream, system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for n, record in enumerate(arc_records(stream)):
                out.write(gzip.compress(warc_record(source, n, *record, others.get(n)), mtime=0))
                count += 1
        return pa.table({"file": [name], "records": pa.array([count], pa.int64())})

    # a task for each file: decisions are so few bytes that Spark would put all into one
    return cut(decided.select("file", "n", "held").repartition(max(1, listed.count()), "file").groupBy("file").applyInArrow(run, "file string, records long"))


def warc_record(source: str, n: int, fields: dict[str, str], block: bytes, truncated: bool, held: dict | None) -> bytes:
    """The WARC record of an ARC record; ``held`` names the record that already holds its payload."""
    date = iso(fields["Archive-date"])
    headers = [("WARC-Record-ID", record_id(source, n)), ("WARC-Date", date)]
    if "version" in fields:
        kind, mime = "warcinfo", "application/warc-fields"
        headers.append(("WARC-Filename", fields["URL"].removeprefix("filedesc://")))
        block = f"software: quillspan\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {fields.get('version', '1')}\r\n".encode()
    else:
        if fields["URL"] != "-":
            headers.append(("WARC-Target-URI", fields["URL"]))
        if fields.get("IP-address", "-") not in ("-", "0.0.0.0"):
            headers.append(("WARC-IP-Address", fields["IP-address"]))
        if block.startswith(b"HTTP/"):
            kind, mime = "response", "application/http; msgtype=response"
            head, body = http_payload(block)
            headers.append(("WARC-Payload-Digest", f"sha1:{sha1(body)}"))
            if held:
                kind, block = "revisit", head
                headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(held["file"], held["n"])), ("WARC-Refers-To-Date", held["date"])]
                if held["url"] != "-":
                    headers.append(("WARC-Refers-To-Target-URI", held["url"]))
        else:
            kind, mime = "resource", fields.get("Content-type", "application/octet-stream")
        if truncated:
            headers.append(("WARC-Truncated", "unspecified"))
    headers = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in headers], "\r\n"]).encode() + block + b"\r\n\r\n"


# WARC ---------------------------------------------------------------------------------------------------------------


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record of a WARC file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"a WARC record of {length} bytes ends after {len(block)}")
        yield headers, block


def read_warc(listed: DataFrame, folder: str) -> DataFrame:
    """A row for each HTTP message in the WARC files (``file``): see ``READ``. Digests are computed again; one that differs is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with system.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in warc_records(stream):
                        if headers["warc-block-digest"] != f"sha1:{sha1(block)}":
                            raise ValueError(f"a record of {name} has another digest than it says")
                        kind = headers["warc-type"]
                        if kind in ("response", "revisit"):
                            head, body = http_payload(block)
                            page, digest = http_header(head, "X-Page-Id"), headers["warc-payload-digest"].removeprefix("sha1:")
                            size = len(body) if kind == "response" else int(http_header(head, "Content-Length") or 0)
                            if kind == "response" and digest != sha1(body):
                                raise ValueError(f"a payload of {name} has another digest than it says")
                            rows.append((None if page is None else int(page), size, digest, kind, headers["warc-record-id"], headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers["warc-date"], "warc-truncated" in headers))
                        if len(rows) >= ROWS:
                            yield _rows(rows, READ)
                            rows = []
                if rows:
                    yield _rows(rows, READ)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, target string, date string, truncated boolean"
    return listed.select("file").mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the page id of the response that a revisit names."""
    asked = records.where("refers_to_id IS NOT NULL").select("refers_to_id").distinct()
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).join(asked, "refers_to_id", "left_semi")
    revisits = salted(records.where("refers_to_id IS NOT NULL"), held, "refers_to_id", F.xxhash64("record_id"))
    return records.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def archive(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """``pages`` through ARC and WARC files and back: the records that ``read_warc`` gives, with ``refers_to``.

    The archives stay in ``folder`` where one is named; else they are removed from the shared folder when they have been read.
    """
    spark = pages.sparkSession
    own = folder or f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    records = cut(read_warc(convert(write_arc(pages, own), own, least), own))
    if not folder:
        located(own)[0].delete_dir(located(own)[1])
    return resolved(records)
