"""WARC: a converter of legacy ARC archives, and WARC archives written and read in parallel.

ARC.  An archive begins with a version block whose second line names the version and
whose third line names the fields of every record's header line; version 1 has five
fields, version 2 ten.  A header line declares how many bytes follow.  `parse_arc` reads
either version; `to_warc` synthesises what WARC wants and ARC lacks: an identifier
(a name-based UUID of page, target and date), an ISO timestamp from the 14-digit one, the
record type, and SHA-1 digests of block and payload.

Archives.  `write_archives` turns pages into ARC records and converts those; records go,
one gzip member each, to files that a task writes under names of its own in the shared
folder.  The returned manifest lists only the files of tasks that succeeded, so a retried
task leaves nothing that is read.  `read_archives` reads listed files back.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest
page_id is a response and the others revisit it: they hold the HTTP header alone.

Null html is an empty payload; a null url stands as urn:page:<id>; white space in urls is
percent-encoded.  A row without a page_id is archived and comes back without; rows that repeat
one are archived each, and judged by their own payloads.  An empty table gives no archive and an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.session import kept, read, shared_dir

REVISIT_BYTES = 1000
#: A task starts a new file after so many bytes.
FILE_BYTES = 64 << 20
#: Names of the header fields of the two ARC versions.
FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:candlewick:warc")
UNKNOWN_DATE = b"20000101000000"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    header: dict[str, str]
    content: bytes


@dataclass
class WarcRecord:
    header: dict[str, str]
    block: bytes = b""
    payload: bytes = field(default=b"", repr=False)


def arc_archive(version: bytes, records: list[tuple[bytes, bytes]], name: bytes = b"pages.arc") -> bytes:
    """An ARC file of (url, content) records."""
    head = version + b" 0 candlewick\n" + FIELDS[version] + b"\n"
    lines = [arc_line(version, b"filedesc://" + name, b"text/plain", len(head)), head, b"\n"]
    for url, content in records:
        lines += [arc_line(version, url, b"text/html", len(content)), content, b"\n"]
    return b"".join(lines)


def arc_line(version: bytes, url: bytes, kind: bytes, size: int) -> bytes:
    values = {b"URL": url, b"IP-address": b"0.0.0.0", b"Archive-date": UNKNOWN_DATE, b"Content-type": kind, b"Result-code": b"200", b"Checksum": b"-", b"Location": b"-", b"Offset": b"0", b"Filename": b"-", b"Archive-length": str(size).encode()}
    return b" ".join(values[f] for f in FIELDS[version].split(b" ")) + b"\n"


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records after the version block; a record is as long as its header line says."""
    at, names = 0, None
    while at < len(raw):
        if raw[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        stop = raw.index(b"\n", at)
        values = raw[at:stop].split(b" ")
        if names is None:
            size = int(values[-1])
            version, _, rest = raw[stop + 1 : stop + 1 + size].partition(b"\n")
            names = rest.split(b"\n")[0].decode().split(" ")
            if version.split(b" ")[0] not in FIELDS:
                raise ValueError("the version block names an unknown version")
        else:
            if len(values) != len(names):
                raise ValueError(f"a header line has {len(values)} fields; the version block names {len(names)}")
            header = dict(zip(names, (v.decode("utf-8", "replace") for v in values)))
            size = int(header["Archive-length"])
            if stop + 1 + size > len(raw):
                raise ValueError("a record is shorter than declared")
            yield ArcRecord(header, raw[stop + 1 : stop + 1 + size])
        at = stop + 1 + size


def sha1_name(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def hex_digest(name: str) -> str:
    return base64.b32decode(name.removeprefix("sha1:")).hex()


def to_warc(arc: ArcRecord, refers_to: tuple[int, str | None] | None = None) -> WarcRecord:
    """The WARC record of an ARC record: a response, or a revisit of the page (id, url) that it refers to."""
    http, mark, payload = arc.content.partition(b"\r\n\r\n")
    http += mark
    day = arc.header["Archive-date"].ljust(14, "0")
    date = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
    target, page = arc.header["URL"], http_field(http, b"X-Page-Id")
    header = {"WARC-Type": "response", "WARC-Record-ID": record_id(page, target, date), "WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": sha1_name(payload), "Content-Type": "application/http; msgtype=response"}
    if arc.header.get("IP-address", "0.0.0.0") != "0.0.0.0":
        header["WARC-IP-Address"] = arc.header["IP-address"]
    block = arc.content
    if refers_to is not None:
        block = http
        other = page_url(refers_to[1], refers_to[0]).decode()
        header |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(str(refers_to[0]), other, date), "WARC-Refers-To-Target-URI": other, "WARC-Refers-To-Date": date, "X-Refers-To-Page": str(refers_to[0])}
    header |= {"WARC-Block-Digest": sha1_name(block), "Content-Length": str(len(block))}
    return WarcRecord(header, block, payload)


def record_id(page: str, target: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page} {target} {date}')}>"


def http_field(http: bytes, name: bytes) -> str:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", http)
    return m.group(1).decode() if m else ""


def serialised(record: WarcRecord) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in record.header.items())
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + record.block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_warc(stream, step: int = 1 << 20) -> Iterator[WarcRecord]:
    """Records of a file with one gzip member for each."""
    rest, z, parts = b"", zlib.decompressobj(31), []
    while True:
        if not rest:
            rest = stream.read(step)
            if not rest:
                break
        parts.append(z.decompress(rest))
        rest = z.unused_data if z.eof else b""
        if z.eof:
            raw = b"".join(parts)
            head, _, body = raw.partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            header = dict(line.split(": ", 1) for line in lines[1:])
            block = body[: int(header["Content-Length"])]
            yield WarcRecord(header, block, block.partition(b"\r\n\r\n")[2])
            z, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the file ends inside a record")


def page_url(url: str | None, page: int) -> bytes:
    if not url:
        return f"urn:page:{page}".encode()
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url).encode("utf-8", "replace")


def revisits(pages: DataFrame) -> DataFrame:
    """(revisit_id, digest, refers_to, refers_url) of pages whose payload a page of a larger id also has."""
    spark = pages.sparkSession
    own = pages.selectExpr("cast(page_id as bigint) revisit_id", "sha1(cast(html as binary)) digest", "octet_length(html) size", "cast(url as string) url").where(f"size >= {REVISIT_BYTES}")
    groups = own.groupBy("digest").agg(F.max(F.struct("revisit_id", "url")).alias("top"), F.count(F.lit(1)).alias("many"))
    groups = kept(spark, groups.where("many > 1").selectExpr("digest", "top.revisit_id refers_to", "top.url refers_url"), "payloads")
    return own.join(groups, "digest").where("revisit_id <> refers_to").select("revisit_id", "digest", "refers_to", "refers_url").dropDuplicates(["revisit_id", "digest"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for every page below ``folder``, a URI that all executors reach; returns the manifest (path, records, bytes)."""
    seen = kept(pages.sparkSession, revisits(pages), "revisits")
    own = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as binary) html")
    own = own.join(seen, (own.page_id == seen.revisit_id) & (F.sha1(own.html) == seen.digest), "left").select("page_id", "url", "html", "refers_to", "refers_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, many, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([many], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, urls, payloads, refers, others = (part.column(k).to_pylist() for k in range(5))
                # both versions occur; the converter has to tell them apart
                version = b"1" if ids[0] is not None and ids[0] % 2 else b"2"
                records = []
                for i, url, payload in zip(ids, urls, payloads):
                    payload = payload or b""
                    http = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if i is None else i}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    records.append((page_url(url, i), http + payload))
                for arc, to, other in zip(parse_arc(arc_archive(version, records)), refers, others):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        path, many, size = f"{folder.rstrip('/')}/{name}", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    raw = member(serialised(to_warc(arc, None if to is None else (to, other))))
                    out.write(raw)
                    many, size = many + 1, size + len(raw)
                    if size >= FILE_BYTES:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return own.mapInArrow(run, "path string, records long, bytes long")


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, record_date string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the files listed under ``path``; digests of stored payloads are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in RESULT.split(", ")]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                found = []
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in parse_warc(stream):
                        h, digest = r.header, r.header["WARC-Payload-Digest"]
                        http = r.block.partition(b"\r\n\r\n")[0]
                        size = int(http_field(http, b"Content-Length"))
                        if h["WARC-Type"] == "response":
                            if sha1_name(r.payload) != digest or len(r.payload) != size:
                                raise ValueError(f"{h['WARC-Record-ID']} is damaged")
                        to = h.get("X-Refers-To-Page")
                        page = http_field(http, b"X-Page-Id")
                        found.append((int(page) if page else None, size, hex_digest(digest), h["WARC-Type"], int(to) if to else None, h["WARC-Record-ID"].strip("<>"), h["WARC-Target-URI"], h["WARC-Date"]))
                        if len(found) >= 1024:
                            yield batch_of(found)
                            found = []
                if found:
                    yield batch_of(found)

    return manifest.select("path").mapInArrow(run, RESULT)


def archived(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = kept(spark, write_archives(pages, folder), "manifest")
    files = max(1, manifest.count())
    return read_archives(manifest.repartition(files))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest) top from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and top <> page_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and top <> page_id then top end refers_to
from m
"""
