"""Legacy archive converter: ARC files of either version become WARC records, and WARC files are read back.

Archives are written by Spark's text sink with gzip, one file per task, and read as a stream of lines: gzip files are
not split, so a task sees whole files in order, and records are cut by their declared lengths, whatever their payload
holds. Nothing holds more than one record in memory. Identifiers are derived from a record's own header, so a task
that runs again writes the same.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The fields of a header line by the version of its file.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_SCHEMA = "kind string, key long, url string, ip string, date string, mime string, head binary, payload binary, payload_bytes long, payload_digest string"
WARC_SCHEMA = "type string, record_id string, refers_to_id string, uri string, date string, key long, refers_to long, payload_bytes long, payload_digest string, payload binary, whole boolean"
#: Parts a payload digest's rows are dealt to, so that no task gets all copies of one payload.
SALTS = 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _options(writer):
    return writer.option("compression", "gzip").option("lineSep", "\n").option("zlib.compress.level", "BEST_SPEED")


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> None:
    """Legacy archives of HTTP responses, for the converter to read: even tasks write version 1, odd ones version 2.

    A null page counts as empty, a null or empty address becomes "-" and white space in one is written as %XX; a null
    key is left out of the header. Repeated rows are records of their own, an empty table gives version blocks alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:06d}.arc"

        def line(at: str, ip: str, mime: str, code: str, length: int) -> str:
            return f"{at} {ip} {date} {mime} {length}" if version == 1 else f"{at} {ip} {date} {mime} {code} - - 0 {name} {length}"

        about = f"{version} 0 tidemark\n{' '.join(ARC_FIELDS[version])}\n"
        yield pa.RecordBatch.from_pydict({"value": [line(f"filedesc://{name}", "0.0.0.0", "text/plain", "200", len(about)) + "\n" + about]})
        for batch in batches:
            out = []
            for k, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                size = len(text.encode())
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if k is None else k}\r\nContent-Length: {size}\r\n\r\n"
                at = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", at) or "-"
                out.append(line(at, "0.0.0.0", "text/html", "200", len(head) + size) + "\n" + head + text)
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    rows = pages.select(F.col(key).cast("long"), F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit("")))
    _options(rows.mapInArrow(run, "value string").write).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of gzip files, each file whole and in order. Spark splits plain files inside records, so they are an error."""
    name = F.col("_metadata.file_path")
    whole = F.when(name.endswith(".gz"), name).otherwise(F.raise_error(F.concat(F.lit("not a gzip file, so it might be split inside a record: "), name)).cast("string"))
    return spark.read.option("lineSep", "\n").text(path).select(whole.alias("file"), F.col("value").cast("binary"))


class _Reader:
    """Hands out lines, and blocks of a declared length, of the files a task reads."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = ((f, line) for b in batches for f, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        self.file: str | None = None
        self.held: tuple[str, bytes] | None = None

    def line(self) -> tuple[str, bytes] | None:
        row, self.held = (self.held, None) if self.held else (next(self.rows, None), None)
        return row

    def block(self, file: str, length: int) -> bytes | None:
        """The bytes of the next lines; None if the file ends, or the line goes on, where the length does not."""
        got, size = [], 0
        while size < length + 1:
            row = self.line()
            if row is None:
                break
            if row[0] != file:
                self.held = row
                break
            got.append(row[1])
            size += len(row[1]) + 1
        body = b"\n".join(got)
        return body if len(body) == length else body[:length] if len(body) > length else None


def _http(block: bytes) -> tuple[bytes, bytes]:
    if block.startswith(b"HTTP/"):
        head, sep, payload = block.partition(b"\r\n\r\n")
        if sep:
            return head + sep, payload
    return b"", block


def _header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def _long(s: str | None) -> int | None:
    return int(s) if s and re.fullmatch(r"-?\d{1,18}", s) else None


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of ARC_SCHEMA of the gzip files in ``path``.

    ``kind`` is filedesc for a file's version block, record for the rest, and error for a header line that its
    version does not allow or a record that ends early; an error row holds the line in ``url``. Reading goes on at
    the next line that is a header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, fields, rows, size, file = _Reader(batches), ARC_FIELDS[1], [], 0, None
        schema = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        while (row := reader.line()) is not None:
            if not row[1].strip():
                continue
            if row[0] != file:
                file, fields = row[0], None
            said = row[1].decode("utf-8", "replace").split(" ")
            if said[0].startswith("filedesc:"):
                fields = ARC_FIELDS[2] if len(said) == len(ARC_FIELDS[2]) else ARC_FIELDS[1]
            length = _long(said[-1])
            if fields is None or len(said) != len(fields) or length is None or length < 0:
                rows.append(dict(kind="error", url=" ".join(said)))
                continue
            block = reader.block(row[0], length)
            if block is None:
                rows.append(dict(kind="error", url=" ".join(said)))
                continue
            named = dict(zip(fields, said, strict=True))
            kind = "filedesc" if said[0].startswith("filedesc:") else "record"
            if kind == "filedesc":
                version = _long(block.split(b" ", 1)[0].decode("utf-8", "replace"))
                fields = ARC_FIELDS.get(version, fields)
            head, body = _http(block) if kind == "record" else (b"", block)
            rows.append(dict(kind=kind, key=_long(_header(head, b"X-Page-Id")), url=named["URL"], ip=named["IP-address"], date=named["Archive-date"], mime=named["Content-type"], head=head, payload=body if payload else None, payload_bytes=len(body), payload_digest=digest(body)))
            size += len(block)
            if size > 8_000_000 or len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _lines(spark, path).mapInArrow(run, ARC_SCHEMA)


def _record_id() -> Column:
    h = F.sha1(F.concat_ws("|", "kind", "url", "ip", "date", "mime", F.col("key").cast("string"), "payload_digest").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0) -> int:
    """WARC files in ``warc`` of the ARC files in ``arc``; returns the number of error rows, which are not converted.

    Version blocks become warcinfo records, HTTP responses response records, other records resources. Of responses
    with equal payloads of ``least`` bytes or more, the one with the smallest key (null last) is the response, the
    others are revisits of it that keep the HTTP header alone; rows that repeat its key are responses too. An id is
    made from a record's header and payload digest, so only records equal in all of these share one.
    """
    is_http = (F.col("kind") == "record") & (F.octet_length("head") > 0)
    order = F.struct(F.col("key").isNull().alias("no"), F.col("key").alias("key"), F.col("id").alias("id"))
    seen = read_arc(spark, arc, payload=False).filter(is_http & (F.col("payload_bytes") >= least)).withColumn("id", _record_id())
    # the smallest key of each payload that occurs twice: partial sums first, so copies never travel one by one
    first = seen.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("payload_digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    lost = Observation()
    read = read_arc(spark, arc).observe(lost, F.count_if(F.col("kind") == "error").alias("n"))
    rows = read.filter(F.col("kind") != "error").withColumns({"id": _record_id(), "salt": F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")})
    rows = rows.join(first, (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s")) & is_http & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first.key").eqNullSafe(F.col("key"))
    kind = F.when(F.col("kind") == "filedesc", F.lit("warcinfo")).when(~is_http, F.lit("resource")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    block = F.when(revisit, F.col("head").cast("string")).otherwise(F.concat(F.col("head").cast("string"), F.col("payload").cast("string")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    date = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    mime = F.when(kind == "warcinfo", F.lit("application/warc-fields")).when(is_http, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))
    made = F.concat(
        F.lit("WARC/1.0\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", F.col("id")),
        field("WARC-Date", date),
        F.when(kind != "warcinfo", field("WARC-Target-URI", F.col("url"))).otherwise(""),
        F.when(kind != "warcinfo", field("WARC-IP-Address", F.col("ip"))).otherwise(""),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", F.col("first.id")), field("X-Refers-To-Page-Id", F.coalesce(F.col("first.key").cast("string"), F.lit(""))))).otherwise(""),
        field("Content-Type", mime),
        field("Content-Length", F.col("size").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
        F.lit("\r\n\r"),  # the sink adds the last line feed
    )
    rows = rows.withColumn("block", block).withColumn("size", F.octet_length("block"))
    _options(rows.select(made.alias("value")).write).text(warc)
    return lost.get["n"]


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Rows of WARC_SCHEMA of the gzip files in ``path``.

    ``payload_bytes`` and ``payload_digest`` are of the full payload: counted and hashed for records that hold it,
    from the HTTP header and the record header for revisits. ``whole`` is false where a record's declared digest is
    not that of its payload, or where a record ends early.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, size = _Reader(batches), [], 0
        schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("key", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("whole", pa.bool_())])
        while (row := reader.line()) is not None:
            if not row[1].startswith(b"WARC/"):
                continue
            head = []
            while (x := reader.line()) is not None and x[0] == row[0] and x[1].strip():
                head.append(x[1])
            head = b"\n".join(head)
            length = _long(_header(head, b"Content-Length"))
            block = reader.block(row[0], length) if length is not None else None
            kind, declared = _header(head, b"WARC-Type"), (_header(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
            http, body = _http(block or b"") if kind in ("response", "revisit") else (b"", block or b"")
            known = digest(body) if kind != "revisit" else declared
            rows.append(dict(type=kind, record_id=_header(head, b"WARC-Record-ID"), refers_to_id=_header(head, b"WARC-Refers-To"), uri=_header(head, b"WARC-Target-URI"), date=_header(head, b"WARC-Date"), key=_long(_header(http, b"X-Page-Id")), refers_to=_long(_header(head, b"X-Refers-To-Page-Id")), payload_bytes=len(body) if kind != "revisit" else _long(_header(http, b"Content-Length")), payload_digest=known, payload=body if payload else None, whole=block is not None and known == declared))
            size += len(body) if payload else 0
            if size > 8_000_000 or len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _lines(spark, path).mapInArrow(run, WARC_SCHEMA)
