"""Legacy archive converter: ARC to WARC, with duplicate payloads as revisit records.

``write_arc`` makes ARC bytes (version 1 or 2) from pages, ``parse_arc`` reads either
version back by its header lines and declared lengths, and ``convert`` synthesises the
equivalent WARC records: identifiers, timestamps, types and digests. Archives on disk are
written by Spark's text writer, whose line separator is the record end, so that the
cluster's own committer guards against lost executors; they are read back as binary files,
unzipped piece by piece and cut by their declared lengths. ``read_arc`` takes legacy files
from storage the same way.

Files are bounded by bytes: pages are written in classes of size, with fewer records in a
file the larger they are, so neither side ever holds more than a file of about
``FILE_BYTES``, or one record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import KeyFilter, shared_folder, staged

#: Fixed values of the formats.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
#: Names of this engine: the source row's key inside an HTTP header, and the key a revisit refers to.
KEY_HEADER, REFERS_HEADER = "X-Source-Key", "X-Refers-To-Source-Key"
#: Archive date of rows that have none.
UNDATED = "19700101000000"
#: Bytes of payload in an archive file, about, and of a page of the smallest class of size; each class is four times the one before.
FILE_BYTES, SMALL_PAGE = 128 << 20, 64 << 10
#: Bytes unzipped at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    code: str
    body: bytes

    @property
    def is_http(self) -> bool:
        return self.body.startswith(b"HTTP/")

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers, by lower-case name, and the payload of an http record."""
        head, _, payload = self.body.partition(RECORD_END)
        lines = head.decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, payload


def arc_url(url: str | None) -> str:
    """A URL as an ARC field, which ends at a space."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "-"


def write_arc(rows: Iterable[tuple[int | None, str | None, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of one http response per (key, url, payload)."""
    about = b"%d 0 quire\n%s\n" % (version, ARC_FIELDS[version])
    extra = b"" if version == 1 else b" 200 - - 0 " + name.encode()
    out = [b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s\n" % (name.encode(), UNDATED.encode(), extra, len(about), about)]
    for key, url, payload in rows:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{KEY_HEADER}: {'' if key is None else key}\r\nContent-Length: {len(payload)}".encode()
        body = head + RECORD_END + payload
        out.append(b"%s 0.0.0.0 %s text/html%s %d\n" % (arc_url(url).encode(), UNDATED.encode(), extra, len(body)) + body + b"\n")
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version block first. Fields follow the file's own version; lengths are the declared ones."""
    at, version = 0, 0
    while at < len(data):
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        length = int(fields[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at byte {at} is shorter than the {length} bytes it declares")
        at = end + 1 + length + 1
        if not version:
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            yield ArcRecord(version, fields[0], fields[1], fields[2], fields[3], "-", body)
            continue
        if len(fields) != len(ARC_FIELDS[version].split(b" ")):
            raise ValueError(f"version {version} header line of {len(fields)} fields")
        yield ArcRecord(version, fields[0], fields[1], fields[2], fields[3], fields[4] if version == 2 else "-", body)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(record: ArcRecord, key: str) -> str:
    """The same identifier for the same capture, however often it is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.url} {record.date} {key}')}"


def stamp(date: str) -> str:
    """An archive date of 14 digits, or the first of them, as a WARC date."""
    date = date + UNDATED[len(date) :] if len(date) < 14 else date
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def convert(record: ArcRecord, refers_to: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the record end; with ``refers_to``, the key and URL of another row, a revisit of that.

    The version block becomes a warcinfo, http captures responses or revisits, and captures by other protocols resources.
    """
    headers, payload = record.http if record.is_http else ({}, record.body)
    key, block, content = headers.get(KEY_HEADER.lower(), ""), record.body, record.content_type
    extra: list[str] = []
    if record.url.startswith("filedesc:"):
        kind, content = "warcinfo", "application/warc-fields"
        block = b"software: quire\r\nformat: WARC File Format 1.1\r\ndescription: converted from an ARC file of version %d\r\n" % record.version
        extra = [f"WARC-Filename: {record.url.removeprefix('filedesc://')}"]
    elif not record.is_http:
        kind = "resource"
    else:
        kind, content = "response", "application/http;msgtype=response"
        if refers_to is not None:
            other = ArcRecord(record.version, refers_to[1], record.ip, record.date, "", "-", b"")
            kind, block = "revisit", record.body[: len(record.body) - len(payload)]
            extra = [
                f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(other, refers_to[0])}>", f"WARC-Refers-To-Target-URI: {other.url}",
                f"WARC-Refers-To-Date: {stamp(record.date)}", f"{REFERS_HEADER}: {refers_to[0]}",
            ]
        extra.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    target = [] if kind == "warcinfo" else [f"WARC-Target-URI: {record.url}", f"WARC-IP-Address: {record.ip}"]
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(record, key)}>", f"WARC-Date: {stamp(record.date)}", *target, *extra,
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Type: {content}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + RECORD_END + block


def pieces(content: bytes) -> Iterator[bytes]:
    """The bytes of a file, plain or gzip - of one member or many - in bounded pieces."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), PIECE):
            yield content[at : at + PIECE]
        return
    member, begun = zlib.decompressobj(31), False
    for at in range(0, len(content), PIECE // 4):
        rest = content[at : at + PIECE // 4]
        while rest:
            begun = True
            if made := member.decompress(rest, PIECE):
                yield made
            rest = member.unconsumed_tail or member.unused_data
            if member.eof:
                member, begun = zlib.decompressobj(31), False
    while begun and (made := member.decompress(b"", PIECE)):
        yield made
    if begun and not member.eof:
        raise ValueError("a gzip member ends too soon")


def parse_warc(content: Iterable[bytes] | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and the block of each record, by the declared lengths; the file comes in pieces, of which one record is held."""
    source = iter([content] if isinstance(content, bytes) else content)
    held = bytearray()

    def filled(size: int) -> bool:
        while len(held) < size and (piece := next(source, None)) is not None:
            held.extend(piece)
        return len(held) >= size

    while filled(1):
        looked = 0
        while (end := held.find(RECORD_END, looked)) < 0:
            looked = max(0, len(held) - len(RECORD_END))
            if not filled(len(held) + 1):
                raise ValueError("a record's header does not end")
        first, *lines = held[:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + len(RECORD_END)
        over = start + int(headers["content-length"])
        if not filled(over + len(RECORD_END)) or held[over : over + len(RECORD_END)] != RECORD_END:
            raise ValueError(f"{headers.get('warc-record-id')} does not end where it declares")
        yield headers, bytes(held[start:over])
        del held[: over + len(RECORD_END)]


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files under ``path``, plain or gzip: file, version, url, ip, date, content_type, code, body, and warc, the converted record."""
    names = ["file", "version", "url", "ip", "date", "content_type", "code", "body", "warc"]
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 5, pa.binary(), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for record in parse_arc(b"".join(pieces(content.as_py()))):
                    row = (file, record.version, record.url, record.ip, record.date, record.content_type, record.code, record.body, convert(record))
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, version int, url string, ip string, date string, content_type string, code string, body binary, warc binary")


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes ``pages`` (page_id, url, html) through the converter as WARC files, gzip-compressed, under ``path``.

    Of rows with equal payloads the one with the largest page_id is a response and the
    others revisit it. Nulls: a null html is an empty payload, a null url is written as
    ``-``, a null page_id is smaller than any other. Rows equal in page_id and payload are
    the same capture: where they are the group's largest, all are responses. Only rows
    whose payload may occur several times take part in a join; the others stay where they
    were read. Pages of any size below 2 GB are written whole; an empty table makes no
    files.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # Payloads are equal if both digests and the length are.
    rows = rows.withColumn("payload", F.concat(F.sha2(F.col("html").cast("binary"), 256), F.lit(":"), F.octet_length("html").cast("string")))
    classes = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), F.octet_length("html")) / SMALL_PAGE) / 2)).cast("int")
    groups = rows.groupBy("payload").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count(F.lit(1)).alias("n"), F.max(classes).alias("kind"))
    groups = staged(groups.where("n > 1 OR kind > 0"), "warc-groups")
    several = groups.where("n > 1").select(F.col("payload").alias("of"), "last")
    kinds = {0, *(r.kind for r in groups.select("kind").distinct().collect())}
    flagged = KeyFilter(several, ["of"], several.count()).flagged(rows, [F.col("payload")], "may")
    met = flagged.where("may").join(several, F.col("payload") == F.col("of"), "left").drop("of")
    labelled = flagged.where("NOT may").withColumn("last", F.lit(None).cast(several.schema["last"].dataType)).unionByName(met)
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id")), F.col("last"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            keys, urls, htmls, lasts = (column.to_pylist() for column in batch.columns)
            # Both versions of the legacy format occur.
            arc = parse_arc(write_arc(zip(keys, urls, htmls, strict=True), 1 + (task + number) % 2, f"pages-{task}-{number}.arc"))
            out = [convert(next(arc))]
            out += [convert(record, None if last is None else (str(last["page_id"]), arc_url(last["url"]))) for record, last in zip(arc, lasts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    for kind in sorted(kinds):
        own = labelled.where(classes == kind) if len(kinds) > 1 else labelled
        made = own.select("page_id", "url", F.col("html").cast("binary"), refers.alias("refers_to")).mapInArrow(records, "record binary")
        writer = made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END.decode()).option("compression", "gzip")
        most = max(1, FILE_BYTES // (SMALL_PAGE * 4**kind))
        writer.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(f"{path}/size={kind}")


def read_warc(df: DataFrame) -> DataFrame:
    """Responses and revisits of WARC files read as binaryFile: page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                for headers, block in parse_warc(pieces(content.as_py())):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(RECORD_END)
                    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                    key, digest = http.get(KEY_HEADER.lower(), ""), headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    if kind == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                    refers = headers.get(REFERS_HEADER.lower())
                    out.append((int(key) if key else None, headers["warc-target-uri"], kind, int(http["content-length"]), digest, None if refers is None else int(refers), headers["warc-record-id"]))
                columns = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return df.select("content").mapInArrow(parse, schema)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the WARC archives of ``pages`` under ``path`` (a new folder of the shared one if None) and reads them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    record_id. See ``write_warc`` for nulls, ties, repeated rows and very long pages; an
    empty table gives no records.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    found = read_warc(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")
