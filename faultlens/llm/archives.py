"""Web archives: the legacy ARC format, its conversion to WARC, and a WARC reader.

Archives are written and read by Spark's text source, whose line separator is what ends a record of the format ("\\n"
in ARC, "\\r\\n\\r\\n" in WARC). So files are committed with their tasks, live in any store that Spark knows, and are
read as streams: a task holds one record at a time, never a file. The rows of a file are put together again by the
lengths that records declare, whatever separators their payloads hold.

ARC header lines depend on the version that the version block of a file names, and on the fields it lists. They are
parsed by these, and WARC records with equivalent identifiers, instants, types and digests are made of them; a payload
that an earlier page has is stored once and revisited.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import prepare
from faultlens.llm.common import join_small, store

ARC_END, WARC_END = b"\n", b"\r\n\r\n"
#: The header fields of ARC versions 1 and 2.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of records that refer to an equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Instant of pages that come without one.
ARCHIVED = "20240101000000"
#: Bytes that a task gathers before it hands rows on.
HELD_BYTES = 4 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- text rows as records -------------------------------------------------------------------
class Framing:
    """Records of one file out of the rows that a separator has cut it into.

    `length_of(head)` tells the declared length of the block that follows a header, or None where the header is none:
    then reading goes on behind it. Chunks are joined once a record is whole, so a long one costs no more than its
    bytes.
    """

    def __init__(self, end: bytes, length_of: Callable[[bytes], int | None]):
        self.end, self.length_of = end, length_of
        self.held: list[bytes] = []
        self.size, self.need, self.offset = 0, 1, 0

    def feed(self, chunk: bytes) -> Iterator[tuple[int, bytes, bytes, bool]]:
        """(offset, head, block, whole) of the records that end within what has been fed."""
        self.held.append(chunk)
        self.size += len(chunk)
        if self.size >= self.need:
            yield from self._records(b"".join(self.held), False)

    def close(self) -> Iterator[tuple[int, bytes, bytes, bool]]:
        """A last record that the file cuts short, or that has no separator behind it."""
        yield from self._records(b"".join(self.held), True)

    def _records(self, data: bytes, last: bool) -> Iterator[tuple[int, bytes, bytes, bool]]:
        at, self.need = 0, 1
        while at < len(data):
            stop = data.find(self.end, at)
            if stop < 0:
                self.need = len(data) - at + 1
                break
            head, block = data[at:stop], stop + len(self.end)
            length = self.length_of(head)
            if length is None:
                at = block
                continue
            if block + length + len(self.end) > len(data):
                if last:
                    # The separator after the last row is ours if the file was cut short.
                    rest = data[block:]
                    whole = len(rest) >= length
                    yield self.offset + at, head, rest[:length] if whole else rest.removesuffix(self.end), whole
                    at = len(data)
                self.need = block + length + len(self.end) - at
                break
            yield self.offset + at, head, data[block : block + length], True
            at = block + length + len(self.end)
        self.offset += at
        self.held, self.size = [data[at:]], len(data) - at


def framed(batches: Iterator[pa.RecordBatch], end: bytes, length_of) -> Iterator[tuple[str, int, bytes, bytes, bool]]:
    """(path, offset, head, block, whole) of all records of a task's rows (path, value), file by file."""
    path, framing = None, None
    for batch in batches:
        paths, values = batch["path"].to_pylist(), batch["value"].to_pylist()
        begin = 0
        while begin < len(paths):
            until = begin + 1
            while until < len(paths) and paths[until] == paths[begin]:
                until += 1
            if paths[begin] != path:
                if framing is not None:
                    yield from ((path, *r) for r in framing.close())
                path, framing = paths[begin], Framing(end, length_of)
            yield from ((path, *r) for r in framing.feed(end.join([*values[begin:until], b""])))
            begin = until
    if framing is not None:
        yield from ((path, *r) for r in framing.close())


def _as_batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows and their sizes -> batches of bounded bytes."""
    out, held = [], 0
    for row, size in rows:
        out.append(row)
        held += size + 200
        if held > HELD_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _rows_of(spark: SparkSession, path: str, end: bytes) -> DataFrame:
    """(path, value) of archive files, which are compressed, so that a file is one task's and keeps its order.

    A file that Spark has split among tasks is refused.
    """
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    read = spark.read.schema("value string").option("lineSep", end.decode()).text(path)
    split = F.col("_metadata.file_block_length") < F.col("_metadata.file_size")
    value = F.when(split, F.raise_error(F.lit("compress archives: a plain one is split among tasks"))).otherwise(F.col("value"))
    return read.select(F.col("_metadata.file_path").alias("path"), value.cast("binary").alias("value"))


def _write(rows: DataFrame, path: str, end: bytes) -> None:
    rows.write.option("lineSep", end.decode()).option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


# --- ARC ------------------------------------------------------------------------------------
def arc_header(version: int, url: str, date: str, mime: str, length: int, offset: int = 0, name: str = "-", code: str = "200", checksum: str = "-") -> str:
    """A header line; white space and controls of an address are escaped, as fields are separated by blanks."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "about:blank"
    url = url if ":" in url else f"http://{url}"
    legacy = [url, "0.0.0.0", date, mime]
    return " ".join([*legacy, str(length)] if version == 1 else [*legacy, code, checksum, "-", str(offset), name, str(length)])


def write_arc(pages: DataFrame, path: str, archived: str = ARCHIVED, version: int | None = None) -> None:
    """Write pages (page_id, url, html) as ARC files, one per task: a version block, then one record per page.

    A record holds the response as a crawler stored it, with the page's id and length in its header. Every other file
    is of version 2, unless a version is asked for.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind, name, offset = version or part % 2 + 1, f"part-{part:05d}.arc", 0

        def records():
            nonlocal offset
            block = f"{kind} 0 faultlens\n{ARC_FIELDS[kind]}\n".encode()
            for url, mime, block in ((f"filedesc://{name}", "text/plain", block), *pages_of(batches)):
                checksum = hashlib.md5(block).hexdigest()
                row = arc_header(kind, url, archived, mime, len(block), offset, name, checksum=checksum).encode() + ARC_END + block
                offset += len(row) + len(ARC_END)
                yield (row,), len(row)

        return _as_batches(records(), pa.schema([("value", pa.binary())]))

    def pages_of(batches):
        for batch in batches:
            for page_id, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{named}\r\n"
                yield url, "text/html", head.encode() + html

    prepare(pages.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
    )
    _write(rows.mapInArrow(scan, "value binary").select(F.col("value").cast("string")), path, ARC_END)


def _arc_length(head: bytes) -> int | None:
    """The declared length ends the header line in every version; a line with an address and a length is one."""
    first, _, last = head.rstrip(b"\r").rpartition(b" ")
    return int(last) if b":" in first.partition(b" ")[0] and last.isdigit() else None


def parse_arc_header(head: bytes, fields: list[str]) -> dict[str, str]:
    """Values by field name; blanks of an unescaped address stay in the address."""
    values = head.rstrip(b"\r").decode("utf-8", "replace").split(" ")
    extra = len(values) - len(fields)
    if extra > 0:
        values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
    elif extra < 0:
        # Fields are missing in the middle: the address and the length are there.
        values = [*values[:-1], *["-"] * -extra, values[-1]]
    return dict(zip(fields, values, strict=True))


def iso_instant(digits: str) -> str:
    """14 digits, or fewer in older archives, as an ISO instant; what is no instant becomes the epoch."""
    found = re.fullmatch(r"(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?\d*", digits)
    if not found:
        return "1970-01-01T00:00:00Z"
    year, *rest = (x or d for x, d in zip(found.groups(), ("", "01", "01", "00", "00", "00"), strict=True))
    return "{}-{}-{}T{}:{}:{}Z".format(year, *rest)


def _http(block: bytes) -> tuple[bytes, bytes] | None:
    """Header (with its blank line) and payload of a stored response."""
    if not block.startswith(b"HTTP/"):
        return None
    head, sep, payload = block.partition(b"\r\n\r\n")
    return head + sep, payload


def _head_value(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip().decode("utf-8", "replace") if found else None


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,18}", text) else None


ARC_ROWS = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("warc_type", pa.string()), ("record_id", pa.string()),
        ("info_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("head_digest", pa.string()),
        ("truncated", pa.bool_()),
    ]
)
ARC_BLOCKS = [("head", pa.binary()), ("payload", pa.binary())]


def read_arc(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """One row per record of ARC files of either version, with what its WARC record needs; `blocks` adds its bytes.

    Version blocks become warcinfo rows, stored responses response rows, everything else resource rows. Identifiers
    are drawn from address, instant and place, so reading again finds the same ones. A record that the file cuts
    short is `truncated`; lines that are no header are passed over.
    """
    schema = pa.schema([*ARC_ROWS, *ARC_BLOCKS]) if blocks else ARC_ROWS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            seen, version, fields, info = None, 1, ARC_FIELDS[1].split(), None
            for path, offset, head, block, whole in framed(batches, ARC_END, _arc_length):
                if path != seen:
                    seen, version, fields, info = path, 1, ARC_FIELDS[1].split(), None
                about = head.startswith(b"filedesc:")
                if about:
                    version, fields = _version_block(block)
                got = parse_arc_header(head, fields)
                date, url = iso_instant(got.get("Archive-date", "")), got.get("URL", "")
                record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {path.rsplit('/', 1)[-1]} {offset}"))
                response = None if about else _http(block)
                if about:
                    info = record_id
                kind = "warcinfo" if about else "response" if response else "resource"
                front, payload = response or (b"", block)
                digest = base32_sha1(payload)
                row = (
                    path, offset, version, kind, record_id, None if about else info, url, got.get("IP-address"), date,
                    got.get("Content-type", "application/octet-stream"), _number(_head_value(front, b"X-Page-Id")), len(payload), digest,
                    base32_sha1(block) if front else digest, base32_sha1(front) if front else None, not whole,
                )
                yield (*row, front, payload) if blocks else row, len(block) if blocks else 0

        return _as_batches(records(), schema)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
    return _rows_of(spark, path, ARC_END).mapInArrow(scan, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _version_block(block: bytes) -> tuple[int, list[str]]:
    """Version and fields of a file; one that lists no fields has those of its version."""
    lines = block.decode("utf-8", "replace").splitlines()
    number = re.match(r"\s*(\d+)", lines[0]) if lines else None
    version = int(number[1]) if number and int(number[1]) in ARC_FIELDS else 1
    listed = lines[1].split() if len(lines) > 1 else []
    return version, listed if "URL" in listed and listed[-1] == "Archive-length" else ARC_FIELDS[version].split()


# --- WARC -----------------------------------------------------------------------------------
PAYLOAD = ["payload_digest", "payload_bytes"]


def first_of_equal(index: DataFrame, min_bytes: int) -> DataFrame:
    """(payload_digest, payload_bytes, first): of payloads that several responses have, the one with the least page.

    Pages without an id come last; of equal ids the first by archive and place is taken.
    """
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "path", "offset", "record_id", "url", "date")
    some = index.filter((F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    return some.groupBy(*PAYLOAD).agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))


def warc_text(records: DataFrame) -> Column:
    """A whole WARC record but for its end, of rows of read_arc with blocks and `first` (null if nothing is equal)."""
    c, first = F.col, lambda n: F.col(f"first.{n}")
    revisit = c("first").isNotNull() & ((c("path") != first("path")) | (c("offset") != first("offset")))
    http, about = c("warc_type") == "response", c("warc_type") == "warcinfo"
    digest = lambda n: F.concat(F.lit("sha1:"), c(n))
    only = lambda condition, value: F.when(condition, value)
    mime = F.when(http, "application/http;msgtype=response").when(about, "text/plain").otherwise(c("mime"))
    length = F.octet_length("head") + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise(c("warc_type"))),
        _line("WARC-Record-ID", _urn(c("record_id"))),
        _line("WARC-Date", c("date")),
        _line("WARC-Filename", only(about, F.regexp_replace("url", "^filedesc:/*", ""))),
        _line("WARC-Target-URI", only(~about, c("url"))),
        _line("WARC-IP-Address", only(~about & (c("ip") != "0.0.0.0") & (c("ip") != "-"), c("ip"))),
        _line("WARC-Warcinfo-ID", _urn(c("info_id"))),
        _line("WARC-Profile", only(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", only(revisit, _urn(first("record_id")))),
        _line("WARC-Refers-To-Target-URI", only(revisit, first("url"))),
        _line("WARC-Refers-To-Date", only(revisit, first("date"))),
        _line("WARC-Truncated", only(c("truncated"), F.lit("unspecified"))),
        _line("WARC-Payload-Digest", only(http, digest("payload_digest"))),
        _line("WARC-Block-Digest", F.when(revisit, digest("head_digest")).otherwise(digest("block_digest"))),
        _line("Content-Type", mime),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        c("head").cast("string"),
        F.when(revisit, "").otherwise(c("payload").cast("string")),
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Convert ARC files to WARC files.

    Of responses with equal payloads of at least `min_bytes` bytes the one with the least page id stays a response,
    the others become revisits of it. The archives are read twice, for the index of payloads and for the records:
    only rows without payloads are shuffled or stored between.
    """
    index = store(read_arc(spark, arc_path), "arc-index")
    firsts = store(first_of_equal(index, min_bytes), "arc-firsts")
    records = join_small(read_arc(spark, arc_path, blocks=True), firsts, PAYLOAD, "left", 512)
    _write(records.select(warc_text(records).alias("value")), warc_path, WARC_END)


def _warc_length(head: bytes) -> int | None:
    return _number(_head_value(head, b"Content-Length")) if head.startswith(b"WARC/") else None


WARC_ROWS = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()),
        ("date", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("intact", pa.bool_()),
    ]
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of WARC files; digests of blocks and payloads are computed anew, `intact` if they agree.

    A revisit has no payload: its length is what its stored response header says.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda urn: urn and urn.removeprefix("<urn:uuid:").removesuffix(">")

        def records():
            for path, offset, head, block, whole in framed(batches, WARC_END, _warc_length):
                get = lambda n: _head_value(head, n)  # noqa: B023, E731
                kind, said = get(b"WARC-Type"), (get(b"WARC-Payload-Digest") or "").removeprefix("sha1:")
                intact = whole and get(b"WARC-Block-Digest") == f"sha1:{base32_sha1(block)}"
                front, payload = _http(block) or (b"", block)
                size, digest = len(payload), said
                if kind == "revisit":
                    size = _number(_head_value(front, b"Content-Length"))
                elif kind == "response":
                    digest = base32_sha1(payload)
                    intact &= digest == said
                yield (
                    path, offset, kind, bare(get(b"WARC-Record-ID")), get(b"WARC-Target-URI"), get(b"WARC-Date"), bare(get(b"WARC-Refers-To")),
                    _number(_head_value(front, b"X-Page-Id")), size, digest or None, intact,
                ), 0

        return _as_batches(records(), WARC_ROWS)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    return _rows_of(spark, path, WARC_END).mapInArrow(scan, ", ".join(f"{f.name} {kinds[f.type]}" for f in WARC_ROWS))


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of responses and revisits that were read.

    `refers_to` is the page of the response whose identifier a revisit names.
    """
    records = store(records.filter("record_type IN ('response', 'revisit')"), "warc-index")
    asked = records.select(F.col("refers_to_id").alias("record_id")).filter("record_id IS NOT NULL").distinct()
    named = records.filter("record_type = 'response'").join(asked, "record_id", "left_semi")
    named = store(named.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")), "warc-named")
    return join_small(records, named, ["refers_to_id"], "left", 128).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write pages as ARC below `path`, convert the archives to WARC there, read these back: one row per page.

    A null html is an empty payload, a null address becomes about:blank; rows without an id come after all others
    when the first of equal payloads is sought, and a revisit of such a page refers to no id. Of repeated rows one is
    the response. An empty table gives archives without pages and no rows; extra columns are ignored.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{path}/arc")
    convert(spark, f"{path}/arc", f"{path}/warc", min_bytes)
    return pages_of(read_warc(spark, f"{path}/warc"))
