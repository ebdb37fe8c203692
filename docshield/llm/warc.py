"""Conversion of legacy ARC web archives to WARC, with revisits for equal payloads.

``convert`` reads ARC files, plain or gzip: the version block names the fields of the header lines
(version 1: five, version 2: ten), each header line declares its record's length, and the record
is taken by that length, whatever stands in it.  From them a WARC record is synthesised: an
identifier (a name-based UUID of archive and offset, so reruns agree), an ISO timestamp, a type
(``warcinfo`` for the version block, ``response`` for HTTP, else ``resource``), and SHA-256 digests
of block and payload.  ``revisits`` turns the records whose payload another one already has into
revisits of it, ``write`` packs records into archives of one gzip member each, and ``read`` takes
archives back apart by their declared lengths and checks the digests.

Archives are read with Spark's binary file source and written with its text sink (one archive a
row and a file, a zero byte as line end: padding after the last gzip member), so any store that
Spark reads will do, and a retried task replaces its own files.  A task holds one archive file and
one record at a time, besides batches of ``HELD`` bytes.  Equal payloads are grouped by digest and
length without their bytes; only groups of two or more are joined back to the records.

Defined results: a null or missing URL is "-" in ARC and absent in WARC; blanks in a URL are
percent-encoded, and one that was not is read by counting fields from the right; a null page id
stands in no header, comes back as null and comes last in a group; repeated rows are records of
their own, one of which is the response; a null payload counts as empty; very long payloads are
written whole; a date that is no date becomes the archive's own, else 1970; bytes that are no
record are skipped to the next header line and counted; a record cut short is kept as ``truncated``; an empty
table gives an empty table; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield.session import ensure_checkpoint_dir

from .common import cut_lineage, pick, prepare, text_of

#: Shortest payload that a revisit refers to (fixed by the contract).
LEAST = 100
#: Compressed bytes of an archive, bytes of an output batch, and read at a time.
ARCHIVE = 8 << 20
HELD = 4 << 20
CHUNK = 1 << 20
#: Bytes that a gzip member is first looked for in.
STEP = 1 << 12
SALTS = 16
#: Most groups of equal payloads that are broadcast (a few hundred bytes each).
SMALL = 20_000
TAG = "X-Page-Id"
#: Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
NO_DATE = "1970-01-01T00:00:00Z"

_HEADER = re.compile(rb"\S.* \d{1,14} \S+ .*\d+\r?\n?\Z")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_DATE = re.compile(r"\d{4,14}")
_URLS = uuid.NAMESPACE_URL.bytes


# --- bytes of an archive -------------------------------------------------------------------

class Source:
    """The bytes of an archive file, plain or gzip members (with zero padding), as they are needed."""

    def __init__(self, raw: bytes):
        self._parts = self._inflate(raw) if raw[:2] == b"\x1f\x8b" else iter((raw,))
        self._held, self._pos = b"", 0
        self.offset = 0

    @staticmethod
    def _inflate(raw: bytes) -> Iterator[bytes]:
        at, view = 0, memoryview(raw)
        while at < len(raw):
            if raw[at] == 0:
                at += 1
                continue
            member = zlib.decompressobj(31)
            try:
                while not member.eof and at < len(raw):
                    # in growing steps: what a step holds beyond the member's end is copied in vain
                    got, size, step, end = [], 0, STEP, min(at + CHUNK, len(raw))
                    while not member.eof and at < end:
                        some = view[at:min(at + step, end)]
                        at, step = at + len(some), 2 * step
                        while not member.eof:
                            got.append(member.decompress(some, CHUNK - size))
                            size += len(got[-1])
                            some = member.unconsumed_tail
                            if size == CHUNK:
                                yield b"".join(got)
                                got, size = [], 0
                            elif not some:
                                break
                    yield b"".join(got)
            except zlib.error:  # a broken member ends the archive; its record is cut short
                return
            at -= len(member.unused_data)

    def _more(self, n: int) -> bool:
        """Whether ``n`` bytes are at hand, after reading on if needed."""
        if len(self._held) - self._pos >= n:
            return True
        got, size = [self._held[self._pos:]], len(self._held) - self._pos
        for part in self._parts:
            got.append(part)
            size += len(part)
            if size >= n:
                break
        self._held, self._pos = b"".join(got), 0
        return size >= n

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or what is left."""
        out = self._held[self._pos:self._pos + n]
        if len(out) < n:
            self._more(n)
            out = self._held[self._pos:self._pos + n]
        self._pos += len(out)
        self.offset += len(out)
        return out

    def line(self) -> bytes:
        """The next line with its end; empty at the end of the archive."""
        at, end, want = self._pos, self._held.find(b"\n", self._pos) + 1, 4096
        while not end:  # most lines are at hand
            full = self._more(want)
            at, end = self._pos, self._held.find(b"\n", self._pos) + 1
            if not full:
                end = end or len(self._held)
                break
            want *= 2
        self._pos = end
        self.offset += end - at
        return self._held[at:end]


def payload_start(block: bytes, http: bool) -> int:
    """Where the payload of a block begins: after the head of an HTTP message."""
    head = _HEAD_END.search(block) if http else None
    return head.end() if head else 0


def http_value(block: bytes, start: int, name: str) -> str | None:
    """A field of an HTTP head."""
    sought = name.lower().encode()
    for line in block[:start].split(b"\n")[1:]:
        key, mark, value = line.partition(b":")
        if mark and key.strip().lower() == sought:
            return value.strip().decode("utf-8", "replace")
    return None


# --- ARC -----------------------------------------------------------------------------------

def arc_line(version: int, url: str, ip: str, date: str, mime: str, length: int, archive: str = "-",
             offset: int = 0, status: str = "200", checksum: str = "-") -> bytes:
    if version == 1:
        return f"{url} {ip} {date} {mime} {length}\n".encode()
    return f"{url} {ip} {date} {mime} {status} {checksum} - {offset} {archive} {length}\n".encode()


def arc_head(version: int, archive: str, date: str) -> bytes:
    """The version block of an archive."""
    body = f"{version} 0 docshield\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{archive}", "0.0.0.0", date, "text/plain", len(body), archive) + body + b"\n"


def url_shown(url: str | None) -> str:
    """A URL as a field between blanks."""
    if not url:
        return "-"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def iso_date(digits: str) -> str | None:
    """An ARC date (up to 14 digits, missing ones lowest) as a WARC date; None if it is no date."""
    if not _DATE.fullmatch(digits):
        return None
    full = digits + "00000101000000"[len(digits):]
    y, mo, d, h, mi, s = full[:4], full[4:6], full[6:8], full[8:10], full[10:12], full[12:14]
    mo, d = ("01" if mo == "00" else mo), ("01" if d == "00" else d)
    if not ("01" <= mo <= "12" and "01" <= d <= "31" and h <= "23" and mi <= "59" and s <= "60"):
        return None
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def arc_records(raw: bytes) -> Iterator[dict]:
    """The records of an ARC file: the header line's fields by name, offset, block, skipped, truncated."""
    src = Source(raw)
    names, skipped, usual = None, 0, ARC_FIELDS[1].split(" ")
    while True:
        at = src.offset
        line = src.line()
        if not line:
            return
        if not line.strip():
            continue
        fields = usual
        if names is None and line.startswith(b"filedesc://") and _HEADER.match(line):
            many = len(line.split(b" "))
            fields = ARC_FIELDS[2 if many >= 10 else 1].split(" ")
        elif names is not None:
            fields = names
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        values = text.rsplit(" ", len(fields) - 1)
        if len(values) < len(fields) or not values[-1].isdecimal() or not values[2].isdecimal():
            skipped += len(line)
            continue
        record = dict(zip(fields, values))
        length = int(values[-1])
        block = src.take(length)
        if names is None and record["URL"].startswith("filedesc://"):
            declared = block.decode("utf-8", "replace").split("\n")
            known = [f.split(" ") for f in ARC_FIELDS.values()]
            names = next((f for f in known if len(declared) > 1 and declared[1].strip().split(" ") == f), fields)
        yield {"fields": record, "offset": at, "block": block, "skipped": skipped, "truncated": len(block) < length}
        skipped = 0


# --- WARC ----------------------------------------------------------------------------------

RECORD = {"record_id": pa.string(), "type": pa.string(), "uri": pa.string(), "date": pa.string(), "ip": pa.string(),
          "mime": pa.string(), "info_id": pa.string(), "block": pa.binary(), "start": pa.int64(),
          "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tag": pa.string(),
          "skipped": pa.int64(), "truncated": pa.bool_()}
RECORD_DDL = ("record_id string, type string, uri string, date string, ip string, mime string, info_id string, "
              "block binary, start bigint, payload_bytes bigint, payload_sha256 string, tag string, skipped bigint, "
              "truncated boolean")


def named_id(name: str) -> str:
    """The text of ``uuid.uuid5(uuid.NAMESPACE_URL, name)``, without the object: every record has one."""
    made = bytearray(hashlib.sha1(_URLS + name.encode(), usedforsecurity=False).digest()[:16])
    made[6], made[8] = made[6] & 0x0F | 0x50, made[8] & 0x3F | 0x80
    x = made.hex()
    return f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


def synthesised(archive: str, raw: bytes, tag: str, blocks: bool = True) -> Iterator[tuple]:
    """The WARC records (``RECORD`` without bytes of the format) of one ARC file."""
    info, own_date = None, NO_DATE
    for r in arc_records(raw):
        f = r["fields"]
        url, mime, block = f["URL"], f["Content-type"], r["block"]
        date = iso_date(f["Archive-date"]) or own_date
        rid = f"urn:uuid:{named_id(f'{archive}#{r['offset']}')}"
        if url.startswith("filedesc://"):
            kind, mime, uri, http = "warcinfo", "application/warc-fields", None, False
            info, own_date = rid, date
            lines = block.decode("utf-8", "replace").split("\n")
            block = (f"software: docshield\r\nformat: WARC File Format 1.1\r\n"
                     f"description: converted from {url} (ARC version {lines[0].split(' ')[0]})\r\n").encode()
        else:
            http = block[:5] == b"HTTP/"
            kind, uri = ("response" if http else "resource"), (None if url == "-" else url)
            mime = HTTP if http else (mime if "/" in mime else "application/octet-stream")
        start = payload_start(block, http)
        payload = memoryview(block)[start:]
        ip = f["IP-address"] if kind != "warcinfo" and f["IP-address"] not in ("-", "0.0.0.0") else None
        yield (rid, kind, uri, date, ip, mime, None if kind == "warcinfo" else info, block if blocks else None, start, len(payload),
               hashlib.sha256(payload).hexdigest(), http_value(block, start, tag), r["skipped"], r["truncated"])


def _batched(rows: Iterable[tuple], fields: dict[str, pa.DataType], weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    made, held = [], 0
    for row in rows:
        made.append(row)
        held += weight(row) + 200
        if held >= HELD:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made), fields.values())], list(fields))
            made, held = [], 0
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made), fields.values())], list(fields))


def _listed(column: pa.Array) -> list:
    """The values of a column; strings at once, which is many times faster than one by one."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the archive files under a folder, in any store that Spark reads.
    Hidden files (commit markers) are not archives."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def convert(files: DataFrame, tag: str = TAG, blocks: bool = True) -> DataFrame:
    """ARC files (path, content) -> one row per WARC record.  ``tag``: an HTTP field handed through
    as a column; without ``blocks`` that column is null (to look for equal payloads)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column("path"), batch.column("content")):
                    name = (path.as_py() or "").rsplit("/", 1)[-1]
                    yield from synthesised(name, content.as_py() or b"", tag, blocks)
        yield from _batched(rows(), RECORD, lambda r: len(r[7] or b""))

    return prepare(files).select("path", "content").mapInArrow(run, RECORD_DDL)


def revisits(records: DataFrame, rank: Column, least: int = LEAST, salts: int = SALTS,
             heads: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """Adds ``first`` (record_id, uri, date of the response that has the same payload; null for
    records that are kept whole).  The smallest ``rank`` is the first, null last.

    The groups of two or more are found from ``heads`` (the same records, without blocks) and
    written.  If there are at most ``small`` of them, they are broadcast and the records stay where
    they are; else both sides are shuffled by payload and salt.  The result is the same."""
    able = (F.col("type") == "response") & (F.col("payload_bytes") >= least) & ~F.col("truncated")
    best = F.min(F.struct(rank.isNull().alias("none"), rank.alias("rank"), "record_id", "uri", "date"))
    groups = ((records if heads is None else heads).filter(able).groupBy("payload_sha256", "payload_bytes")
              .agg(best.alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    groups = cut_lineage(groups.select(F.concat_ws(",", "payload_sha256", "payload_bytes").alias("key"),
                                       F.struct("best.record_id", "best.uri", "best.date").alias("first")))
    # a record that takes no part has a key of its own, so that none gather under a common one
    keyed = records.withColumn("key", F.when(able, F.concat_ws(",", "payload_sha256", "payload_bytes")).otherwise(F.col("record_id")))
    if groups.count() <= small:
        out = keyed.join(F.broadcast(groups), "key", "left").drop("key")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
        out = keyed.join(salted, ["key", "salt"], "left").drop("key", "salt")
    own = F.col("first.record_id") == F.col("record_id")
    return out.withColumn("first", F.when(~own, F.col("first")))


def warc_record(r: dict) -> bytes:
    """A record of the format, from a row of ``convert`` with ``first``."""
    block, first = r["block"], r["first"]
    kind = "revisit" if first else r["type"]
    if first:
        block = block[:r["start"]]
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"]),
            ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]),
            ("WARC-Warcinfo-ID", r["info_id"] and f"<{r['info_id']}>")]
    if first:
        head += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{first['record_id']}>"),
                 ("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", first["date"])]
    if kind != "warcinfo":
        head.append(("WARC-Payload-Digest", f"sha256:{r['payload_sha256']}"))
    if r["truncated"]:
        head.append(("WARC-Truncated", "unspecified"))
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", r["mime"]),
             ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v).encode()
    return WARC_VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _sink(blobs: DataFrame, folder: str) -> None:
    """One row, one file; the line end that the sink adds is gzip padding."""
    blobs.select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\0") \
        .option("maxRecordsPerFile", 1).text(folder)


def write(records: DataFrame, folder: str) -> None:
    """Writes rows of ``revisits`` as WARC archives of about ``ARCHIVE`` compressed bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs() -> Iterator[tuple]:
            made, held = [], 0
            for batch in batches:
                # short fields by columns, blocks (possibly long) one at a time
                short = [c for c in batch.schema.names if c != "block"]
                values = zip(*(_listed(batch.column(c)) for c in short))
                for block, row in zip(batch.column("block"), values):
                    made.append(_member(warc_record(dict(zip(short, row), block=block.as_py()))))
                    held += len(made[-1])
                    if held >= ARCHIVE:
                        yield (b"".join(made),)
                        made, held = [], 0
            if made:
                yield (b"".join(made),)
        yield from _batched(blobs(), {"content": pa.binary()}, lambda r: len(r[0]))

    cols = ["record_id", "type", "uri", "date", "ip", "mime", "info_id", "block", "start", "payload_sha256", "truncated", "first"]
    _sink(prepare(records).select(*cols).mapInArrow(run, "content binary"), folder)


READ = {"record_id": pa.string(), "type": pa.string(), "uri": pa.string(), "date": pa.string(), "refers_to_id": pa.string(),
        "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tag": pa.string(),
        "intact": pa.bool_()}
READ_DDL = ("record_id string, type string, uri string, date string, refers_to_id string, payload binary, "
            "payload_bytes bigint, payload_sha256 string, tag string, intact boolean")


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of the records of a WARC file."""
    src = Source(raw)
    while line := src.line():
        if not line.startswith(b"WARC/"):
            continue
        named: dict[str, str] = {}
        while (line := src.line()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            named[k.strip().lower()] = v.strip()
        length = named.get("content-length", "")
        yield named, src.take(int(length) if length.isdecimal() else 0)


def taken_apart(raw: bytes, tag: str, payloads: bool) -> Iterator[tuple]:
    for named, block in warc_records(raw):
        http = named.get("content-type", "").startswith("application/http")
        start = payload_start(block, http)
        kind = named.get("warc-type")
        declared = named.get("warc-payload-digest", "").rpartition(":")[2] or None
        right = named.get("warc-block-digest") in (None, f"sha256:{hashlib.sha256(block).hexdigest()}") \
            and str(len(block)) == named.get("content-length")
        if kind == "revisit":  # the payload stands in the record referred to; its length in the HTTP head
            size = http_value(block, start, "Content-Length")
            size, digest, payload = int(size) if size and size.isdecimal() else None, declared, None
        else:
            payload = block[start:]
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            right = right and declared in (None, digest)
        yield (named.get("warc-record-id", "").strip("<>"), kind, named.get("warc-target-uri"), named.get("warc-date"),
               named.get("warc-refers-to", "").strip("<>") or None, payload if payloads else None, size, digest,
               http_value(block, start, tag), right)


def read(files: DataFrame, tag: str = TAG, payloads: bool = True) -> DataFrame:
    """WARC files (path, content) -> one row per record; ``intact``: lengths and digests hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column("content"):
                    yield from taken_apart(content.as_py() or b"", tag, payloads)
        yield from _batched(rows(), READ, lambda r: len(r[5] or b""))

    return prepare(files).select("path", "content").mapInArrow(run, READ_DDL)


def resolved(records: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds ``refers_to``, the tag of the record that a revisit refers to (salted: very many
    revisits may refer to one)."""
    key, salt = F.coalesce("refers_to_id", "record_id"), F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")
    narrow = records.drop("payload")
    meant = narrow.filter("type = 'revisit'").select("refers_to_id").distinct()
    # most responses are referred to by none: only those that are get copies
    firsts = (narrow.filter("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("tag").alias("refers_to"))
              .join(meant, "refers_to_id")
              .select(F.col("refers_to_id").alias("_key"), "refers_to",
                      F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")))
    out = narrow.withColumn("_key", key).withColumn("_salt", salt).join(firsts, ["_key", "_salt"], "left")
    return out.drop("_key", "_salt").withColumn("refers_to", F.when(F.col("type") == "revisit", F.col("refers_to")))


# --- the pages table as a legacy archive ---------------------------------------------------

def write_arc(pages: DataFrame, folder: str, version: int, date: str = "19970101000000", url: str = "url",
              body: str = "html", page: str = "page_id") -> None:
    """Writes a table of pages as ARC archives of a version, each page an HTTP response."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs() -> Iterator[tuple]:
            made, held, at = [], 0, 0
            for batch in batches:
                for p, u, b in zip(batch.column("page"), batch.column("url"), batch.column("body")):
                    p, b = p.as_py(), b.as_py()
                    if not made:
                        made.append(_member(arc_head(version, "pages.arc.gz", date)))
                        held = at = len(made[0])
                    tag = "" if p is None else f"{TAG}: {p}\r\n"
                    block = (f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{tag}"
                             f"Content-Length: {len(b)}\r\n\r\n").encode() + b
                    line = arc_line(version, url_shown(u.as_py()), "0.0.0.0", date, "text/html", len(block), "pages.arc.gz", at)
                    made.append(_member(line + block + b"\n"))
                    held += len(made[-1])
                    at = held
                    if held >= ARCHIVE:
                        yield (b"".join(made),)
                        made, held = [], 0
            if made:
                yield (b"".join(made),)
        yield from _batched(blobs(), {"content": pa.binary()}, lambda r: len(r[0]))

    rows = pick(prepare(pages), page=pages[page].cast("long"), url=pages[url].cast("string"),
                body=text_of(pages, body).cast("binary"))
    _sink(rows.mapInArrow(run, "content binary"), folder)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Pages -> ARC files of both versions -> WARC files -> one row per page, read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to, intact.  Even pages go into archives of
    version 1, odd ones and those without an id into version 2."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    even = F.coalesce(F.pmod(pages["page_id"].cast("long"), F.lit(2)) == 0, F.lit(False))
    write_arc(pages.filter(even), f"{folder}/arc/version=1", 1)
    write_arc(pages.filter(~even), f"{folder}/arc/version=2", 2)
    files = archives(spark, f"{folder}/arc")
    write(revisits(convert(files), F.col("tag").cast("long"), heads=convert(files, blocks=False)), f"{folder}/warc")
    back = cut_lineage(read(archives(spark, f"{folder}/warc"), payloads=False).filter("type <> 'warcinfo'"))  # no payloads
    rows = resolved(back)
    return rows.select(F.col("tag").cast("long").alias("page_id"), "payload_bytes",
                       F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"),
                       F.col("refers_to").cast("long").alias("refers_to"), "intact")
