"""Legacy archive converter: ARC version 1 and 2 to WARC 1.1.

``write_arc`` lays pages out as ARC files (the legacy form, one gzip member per record);
``convert`` parses every ARC file by the header line of its version and the declared lengths,
synthesises WARC identifiers (name-based UUIDs), timestamps (from the 14-digit archive date), record types
and digests, and writes a WARC file per ARC file; ``read_warc`` reads WARC files back.

Payloads that are equal and at least REVISIT_BYTES long are stored once: the record with the
largest page_id is the response, the others are revisit records that carry the HTTP head (with
the payload's length) and refer to the response.  Smaller payloads are all responses.

ARC header lines (fixed formats of the ARC specification):

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The page_id travels as an ``X-Page-Id`` head of the archived HTTP answer.

Edge cases: null html is an empty payload, null url is ``-`` and white space in URLs is percent-encoded; a
null page_id has no head and sorts before all others; payloads of any length are written whole, one in memory at a time; records
of other archives may have heads of any bytes, folded or without a colon, short dates, blanks in URLs, or no HTTP
answer at all (``dns:``), which become resource records and are never revisits; rows with equal page_id and payload stay
separate records, the last in the archives is the response; an empty table writes no archive
and gives an empty result; extra columns are ignored.  Files are written whole under a task's own
name and then renamed, so a task that is run again replaces its file by the same bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, new_dir, partitions_of, read_table, utf8, written

#: Payloads of fewer bytes are always responses.
REVISIT_BYTES = 1000
#: An archive file is closed when its content reaches this size.
FILE_BYTES = 16 << 20
ARC_FIELDS = {1: 5, 2: 10}
CRAWL_START = 946_684_800  # 2000-01-01, the archive date of page 0; each page_id is a second later
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


class Output:
    """A file in any store that pyarrow can write to, of gzip members, whole or not there."""

    def __init__(self, path: str):
        self.fs, self.name = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.name.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.out, self.at = self.fs.open_output_stream(self.part), 0

    def member(self, record: bytes) -> None:
        data = gzip.compress(record, 6, mtime=0)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.name)


def open_members(path: str) -> gzip.GzipFile:
    """The content of all gzip members of a file, one after another, as a stream."""
    fs, name = pafs.FileSystem.from_uri(path)
    return gzip.GzipFile(fileobj=fs.open_input_file(name))


def safe_url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def http_answer(page_id: int | None, payload: bytes) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join([*head, "", ""]).encode() + payload


def arc_date(page_id: int | None) -> str:
    from datetime import UTC, datetime, timedelta

    return (datetime.fromtimestamp(CRAWL_START, UTC) + timedelta(seconds=abs(page_id or 0) % (1 << 32))).strftime("%Y%m%d%H%M%S")


def arc_head(version: int, name: str) -> bytes:
    """The version block that opens an ARC file."""
    fields = "URL IP-address Archive-date Content-type Archive-length"
    if version == 2:
        fields = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 loomwork\n{fields}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 20000101000000 text/plain"
    line += f" {len(body)}" if version == 1 else f" 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    block = http_answer(page_id, payload)
    line = f"{safe_url(url)} 0.0.0.0 {arc_date(page_id)} text/html"
    if version == 2:
        line += f" 200 {hashlib.md5(payload).hexdigest()} - {offset} {name}"
    return f"{line} {len(block)}\n".encode() + block + b"\n"


def read_arc(path: str) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record after the version block, by the declared lengths."""
    with open_members(path) as f:
        version = None
        while line := f.readline():
            if line == b"\n":
                continue
            line = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
            if version is None:
                size = int(line.rsplit(" ", 1)[-1])
                version = int(f.read(size).split(b" ", 1)[0])
                if version not in ARC_FIELDS:
                    raise ValueError(f"{path}: ARC version {version}")
                continue
            parts = line.rsplit(" ", ARC_FIELDS[version] - 1)  # a URL may hold blanks
            if len(parts) != ARC_FIELDS[version]:
                raise ValueError(f"{path}: {len(parts)} fields in a header line of version {version}")
            size = int(parts[-1])
            block = f.read(size)
            if len(block) != size:
                raise ValueError(f"{path}: a record ends before its declared length")
            head = {"url": parts[0], "ip": parts[1], "date": parts[2], "type": parts[3], "version": version}
            yield head, block


def split_http(block: bytes) -> tuple[dict[str, str] | None, bytes, bytes]:
    """(heads in lower case, head bytes with the blank line, payload) of an HTTP answer; of any other block the heads
    are None and the payload is the block.  Heads may be folded, lack their colon (then they are left out) and hold any bytes."""
    if not block.startswith(b"HTTP/"):
        return None, b"", block
    ends = [(at, len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (at := block.find(gap)) >= 0]
    at, gap = min(ends, default=(len(block), 0))
    heads, last = {}, None
    for line in block[:at].decode("utf-8", "surrogateescape").replace("\r\n", "\n").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last is not None:
            heads[last] += " " + line.strip()
        elif colon:
            last = name.strip().lower()
            heads[last] = value.strip()
    return heads, block[: at + gap], block[at + gap :]


def page_of(heads: dict[str, str] | None) -> int | None:
    page = (heads or {}).get("x-page-id", "")
    return int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None


def warc_date(date: str) -> str:
    date = date + "00000101000000"[len(date) :]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_info(name: str) -> bytes:
    """The record that describes the file."""
    body = b"software: loomwork\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(name)}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Filename: {name}"]
    lines += ["Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def warc_record(head: dict, block: bytes, place: str, refers_to: tuple[int | None, str] | None, digest: str) -> bytes:
    """A response record, or a revisit record that refers to (page_id, record id); what is no HTTP answer is a resource."""
    heads, http, payload = split_http(block)
    body = block if refers_to is None else http
    kind = "revisit" if refers_to is not None else "resource" if heads is None else "response"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(place)}>",
        f"WARC-Date: {warc_date(head['date'])}",
        f"WARC-Target-URI: {head['url']}",
        f"WARC-IP-Address: {head['ip']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}",
    ]
    if refers_to is not None:
        page, rid = refers_to
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{rid}>", f"X-Payload-Length: {len(payload)}"]
        if page is not None:
            lines.append(f"X-Refers-To-Page-Id: {page}")
    content = head["type"] if kind == "resource" else "application/http; msgtype=response"
    lines += [f"Content-Type: {content}", f"Content-Length: {len(body)}"]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "surrogateescape") + body + b"\r\n\r\n"


def record_id(place: str) -> str:
    """Identifier of the record at a place (file name and number) of the legacy archives."""
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, place)}"


def parse_warc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    with open_members(path) as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: {line[:40]!r} instead of a version line")
            heads = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(":")
                heads[k.lower()] = v.strip()
            body = f.read(int(heads["content-length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record is longer than its declared length")
            yield heads, body


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """ARC files of the pages, versions 1 and 2 in turn; returns the written table of their paths."""
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            for page, url, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                if out is None:
                    name, version = f"part-{part:06d}-{number:04d}.arc.gz", 1 + (part + number) % 2
                    out, size, number = Output(f"{folder}/{name}"), 0, number + 1
                    out.member(arc_head(version, name))
                record = arc_record(version, name, out.at, page, url, payload)
                out.member(record)
                size += len(record)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    return written(src.mapInArrow(run, "path string"), "arc-paths")


def scan_arc(files: DataFrame) -> DataFrame:
    """(path, no, page_id, bytes, digest, http) of every ARC record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for no, (_, block) in enumerate(read_arc(path)):
                    heads, _, payload = split_http(block)
                    rows.append((path, no, page_of(heads), len(payload), hashlib.sha1(payload).hexdigest(), heads is not None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if i != 2 else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], ["path", "no", "page_id", "bytes", "digest", "http"])

    return files.mapInArrow(run, "path string, no long, page_id long, bytes long, digest string, http boolean")


def convert(files: DataFrame, folder: str) -> DataFrame:
    """A WARC file for each ARC file; returns the written table of their paths."""
    parts = partitions_of(files.sparkSession)
    spread = files.repartition(4 * parts, "path")
    records = written(scan_arc(spread), "arc-records")
    place = F.struct("page_id", "path", "no")  # nulls first: the largest page_id, then the last place
    large = records.where((F.col("bytes") >= REVISIT_BYTES) & F.col("http"))
    first = large.groupBy("digest").agg(F.max(place).alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    # written, so that Spark may split a very common payload
    again = large.join(broadcast_if_small(written(first, "arc-first")), "digest").where((F.col("path") != F.col("kept.path")) | (F.col("no") != F.col("kept.no")))
    revisits = again.select("path", "no", F.col("kept.page_id").alias("to_page"), F.col("kept.path").alias("to_path"), F.col("kept.no").alias("to_no"))
    plan = files.select("path", F.lit(-1).cast("long").alias("no"), F.lit(None).cast("long").alias("to_page"), F.lit(None).cast("string").alias("to_path"), F.lit(None).cast("long").alias("to_no"))
    plan = plan.unionByName(revisits).repartition(4 * parts, "path").sortWithinPartitions("path", "no")

    def place_name(path: str, no: int) -> str:
        return f"{path.rsplit('/', 1)[1]}#{no}"

    def one(path: str, to: dict[int, tuple[int | None, str]]) -> str:
        made = f"{folder}/{path.rsplit('/', 1)[1].replace('.arc.gz', '.warc.gz')}"
        out = Output(made)
        out.member(warc_info(made.rsplit("/", 1)[1]))
        for no, (head, block) in enumerate(read_arc(path)):
            payload = split_http(block)[2]
            out.member(warc_record(head, block, place_name(path, no), to.get(no), hashlib.sha1(payload).hexdigest()))
        out.close()
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, to = None, {}
        for b in batches:
            for path, no, page, to_path, to_no in zip(*[c.to_pylist() for c in b.columns]):
                if path != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"path": [one(now, to)]})
                    now, to = path, {}
                if no >= 0:
                    to[no] = (page, record_id(place_name(to_path, to_no)))
        if now is not None:
            yield pa.RecordBatch.from_pydict({"path": [one(now, to)]})

    return written(plan.mapInArrow(run, "path string"), "warc-paths")


READ = "page_id long, url string, warc_date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_record string"


def read_warc(files: DataFrame) -> DataFrame:
    """A row of READ per record; the digest of every stored payload is checked against its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.string() for x in READ.split(", ")]
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for w, body in parse_warc(path):
                    if w["warc-type"] == "warcinfo":
                        continue
                    heads, _, payload = split_http(body) if w["warc-type"] != "resource" else (None, b"", body)
                    digest = w["warc-payload-digest"].removeprefix("sha1:")
                    if hashlib.sha1(body).hexdigest() != w["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError(f"{path}: block digest of {w['warc-record-id']}")
                    if w["warc-type"] != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: payload digest of {w['warc-record-id']}")
                    to = w.get("x-refers-to-page-id")
                    rows.append(
                        (page_of(heads), w["warc-target-uri"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), w["warc-date"], w["warc-record-id"][1:-1], int(w.get("x-payload-length", len(payload))), digest,
                         w["warc-type"], None if to is None else int(to), w.get("warc-refers-to", "")[1:-1] or None)
                    )
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.repartition(4 * partitions_of(files.sparkSession), "path").mapInArrow(run, READ)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = write_arc(read_table(spark, sf_dir, "pages"), new_dir(spark, "arc"))
    back = read_warc(convert(arc, new_dir(spark, "warc")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op1_arc_to_warc": """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep = page_id THEN NULL ELSE keep END AS refers_to
FROM k
"""
}

QUERIES = {"op1_arc_to_warc": op1_arc_to_warc}
