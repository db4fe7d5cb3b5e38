"""Legacy archive converter: ARC files of versions 1 and 2 in, WARC files out, and both read back.

ARC: a version block, then per record a header line whose fields depend on the version and whose last field declares
the length of the bytes that follow. WARC: synthesised record ids, dates, types, payload and block digests. Of records
with equal payloads of at least `min_bytes` bytes the first (by page id) is the response; the others revisit it and
keep only their HTTP head.

Archives are written by Spark's text sink (its row separator is what ends a record), one file per task, compressed,
each opened by its version block or warcinfo record, and read whole by file, record by record. A file is as large as
an input split.

Defined cases: null html is an empty payload; a null or empty URL is `-`, white space in one is %20; a null page id is
kept as none and sorts last among equals; repeated rows are records each, told apart by their place in the archives;
an empty table gives empty archives and no rows; extra columns are not archived. A declared length that the file does
not hold, or a response whose digest differs, is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import landed, stage_path

# Fixed values of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRLF = "\r\n"
# Level 4 takes a third of the default level's time for 4 % more bytes on such pages.
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}
BATCH = 1 << 23


def _first_row(df: DataFrame) -> DataFrame:
    """Adds _part, the number of the task, and _first, whether the row is its first."""
    df = df.withColumn("_id", F.monotonically_increasing_id())
    return df.withColumns({"_part": F.shiftright("_id", 33), "_first": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) == 0}).drop("_id")


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """One record per page; tasks write versions 1 and 2 in turn."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.lit("-")), r"[\s\x00-\x1F]", "%20")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
                    F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    rows = _first_row(pages.select(url.alias("url"), F.concat(head, html).alias("block")))
    size, second = F.octet_length("block").cast("string"), F.col("_part") % 2 == 1
    line = F.when(second, F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("-"), size))
    line = line.otherwise(F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), size))

    def opening(version: int) -> Column:
        body = f"{version} 0 tickloom\n{ARC_FIELDS[version]}\n"
        fields = ["0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", "-"] if version == 2 else []), str(len(body))]
        return F.concat(F.lit("filedesc://part-"), F.col("_part").cast("string"), F.lit(f".arc {' '.join(fields)}\n{body}\n"))

    start = F.when(F.col("_first"), F.when(second, opening(2)).otherwise(opening(1))).otherwise("")
    out = rows.select(F.concat(start, line, F.lit("\n"), "block").alias("value"))
    out.write.option("lineSep", "\n").options(**GZIP).text(path)


def _open(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if content[:2] == b"\x1f\x8b" else io.BufferedReader(raw)


def _exactly(f: io.BufferedReader, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"a record declares {n} bytes, {len(data)} are left")
    return data


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, its fields, and the payload; a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, blank, payload = block.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return head + blank, {k.strip().lower(): v.strip() for k, _, v in fields}, payload


def arc_records(content: bytes) -> Iterator[dict]:
    """Records of one ARC file, as its version block declares them. Only a file's first record can be that, whatever URLs follow."""
    f, version, no, opened = _open(content), 1, 0, False
    while line := f.readline():
        if line in (b"\n", b"\r\n"):
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        block = _exactly(f, int(fields[-1]))
        if not opened and fields[0].startswith("filedesc://"):
            version, opened = int(block.split(b" ", 1)[0]), True
            continue
        opened = True
        if len(fields) != len(ARC_FIELDS[version].split(" ")):
            raise ValueError(f"{len(fields)} fields in a header line of version {version}")
        head, http, payload = _http(block)
        yield {"no": no, "version": version, "url": fields[0], "ip": fields[1], "date": fields[2], "mime": fields[3],
               "page_id": int(http["x-page-id"]) if "x-page-id" in http else None, "kind": "response" if head else "resource",
               "head": head, "head_digest": base32_sha1(head), "block": block, "block_digest": base32_sha1(block),
               "payload_bytes": len(payload), "payload_digest": base32_sha1(payload)}
        no += 1


ARC = ("no long, version int, url string, ip string, date string, mime string, page_id long, kind string, head binary, "
       "head_digest string, block binary, block_digest string, payload_bytes long, payload_digest string")


def _archives(spark: SparkSession, path: str, records, schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `records` over each file, with the file's name; columns in `drop` are not sent."""
    kept = [c.strip() for c in schema.split(",") if c.strip().split(" ")[0] not in drop]
    names = ["file", *(c.split(" ")[0] for c in kept)]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([("file", pa.string()), *((c.split(" ")[0], kinds[c.split(" ")[1]]) for c in kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for r in records(content.as_py()):
                    rows.append({"file": file.as_py(), **r})
                    size += len(r.get("block") or b"")
                    if size >= BATCH or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in rows], arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in rows], arrow)

    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")
    return files.mapInArrow(run, ", ".join(["file string", *kept]))


def read_arc(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    return _archives(spark, path, arc_records, ARC, drop)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record_id(row: str = "") -> Column:
    return _urn(*(F.col(f"{row}{c}") for c in ("file", "no", "url", "date", "page_id")))


def _day(date: Column) -> Column:
    return F.regexp_replace(date, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def convert(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Write the ARC files under `arc` as WARC files under `warc`.

    Only payloads that occur again are looked up; a payload that many records share is split by the join.
    """
    small = read_arc(spark, arc, ("head", "block", "block_digest", "head_digest", "mime", "ip")).where(F.col("payload_bytes") >= min_bytes)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "no", "url", "date")
    firsts = small.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n")
    rows = read_arc(spark, arc).join(firsts, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ((F.col("file") != F.col("first.file")) | (F.col("no") != F.col("first.no")))
    rows = _first_row(rows.withColumn("again", F.coalesce(again, F.lit(False))))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    kept = F.when(F.col("again"), F.col("head")).otherwise(F.col("block"))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"), field("WARC-Type", F.when(F.col("again"), "revisit").otherwise(F.col("kind"))), field("WARC-Record-ID", _record_id()),
        field("WARC-Date", _day(F.col("date"))), field("WARC-Target-URI", F.col("url")), field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(F.col("again"), F.col("head_digest")).otherwise(F.col("block_digest")))),
        field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("again"), F.concat(field("WARC-Profile", F.lit(REVISIT)), field("WARC-Refers-To", _record_id("first.")),
                                        field("WARC-Refers-To-Target-URI", F.col("first.url")), field("WARC-Refers-To-Date", _day(F.col("first.date"))))).otherwise(""),
        field("Content-Type", F.when(F.col("kind") == "response", "application/http; msgtype=response").otherwise(F.col("mime"))),
        field("Content-Length", F.octet_length(kept).cast("string")), F.lit(CRLF))
    about = f"software: tickloom{CRLF}format: WARC File Format 1.0{CRLF}"
    info = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: warcinfo{CRLF}"), field("WARC-Record-ID", _urn(F.lit("warcinfo"), F.col("_part"))),
                    field("WARC-Date", _day(F.col("date"))), F.lit(f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(about)}{CRLF}{CRLF}{about}{CRLF}{CRLF}"))
    value = F.concat(F.when(F.col("_first"), info).otherwise("").cast("binary"), head.cast("binary"), kept)
    rows.select(value.cast("string").alias("value")).write.option("lineSep", CRLF + CRLF).options(**GZIP).text(warc)


def warc_records(content: bytes) -> Iterator[dict]:
    """Records of one WARC file, but for its warcinfo; digests of responses are compared with their payloads."""
    f = _open(content)
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = _exactly(f, int(fields["content-length"]))
        if fields["warc-type"] == "warcinfo":
            continue
        _, http, payload = _http(block)
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] != "revisit" and (base32_sha1(payload) != digest or len(payload) != int(fields["x-payload-length"])):
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
        yield {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "url": fields["warc-target-uri"], "date": fields["warc-date"],
               "page_id": int(http["x-page-id"]) if "x-page-id" in http else None, "payload_bytes": int(fields["x-payload-length"]),
               "payload_digest": digest, "refers_to_id": fields.get("warc-refers-to"), "block": block}


WARC = ("record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, "
        "refers_to_id string, block binary")


def read_warc(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    return _archives(spark, path, warc_records, WARC, drop)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive pages (page_id, url, html), convert, and read the records back: one row per page, without its block."""
    spark = pages.sparkSession
    arc, warc = stage_path(spark, "arc"), stage_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, min_bytes)
    rows = landed(read_warc(spark, warc, ("block",)), "warc-records")
    first = F.col("record_type") != "revisit"
    named = rows.where(first).select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    # Only revisits are looked up; a response refers to nothing.
    return rows.where(first).withColumn("refers_to", F.lit(None).cast("long")).unionByName(rows.where(~first).join(named, "refers_to_id", "left"))
