"""WARC archives: one transaction per page, written and read back as captures."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import addressed

EOL = "\r\n"
RECORD_END = "\r\n\r\n"
# Smaller payloads are always stored again.
LEAST_REVISIT = 100
# Payload bytes that classes of pages end at, and records in one archive file of each class: a reading task holds a file whole (packed),
# so files are bounded by bytes, 128 MB unless a single page is larger.
SIZES = [(64 << 10, 6000), (2 << 20, 180), (None, 3)]

FIELDS = "record_id string, warc_type string, target string, concurrent_to string, refers_to string, page string, block_bytes long, payload binary"


def _uuid(kind: str, *parts: Column) -> Column:
    """A record identifier that follows from its parts."""
    h = F.md5(F.concat_ws("\x01", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x02")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, **fields: Column) -> Column:
    """Header and block of a record; the writer adds its end. Null fields are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(f"{name.replace('_', '-')}: "), value) for name, value in fields.items()]
    head = F.concat_ws(EOL, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), *lines)
    return F.concat(head, F.lit(f"{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END), block)


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write request, response (or revisit) and metadata records of all rows (page_id, url, html) below ``folder``.

    Pages of like size share files, so these are bounded by bytes; equal payloads are always of one class.

    Of rows with equal payloads of at least 100 bytes, the one with the smallest page_id (null last, then
    url, then place in the table) becomes the response and the others revisit it; all smaller ones are
    responses. Null html is an empty payload, a null url an empty target. Every row gets its own records, also
    repeated ones. Line breaks in urls are percent-encoded. Rows are told apart by their place in their file, so a
    table that isn't read from Parquet files is written first. Other columns are left out. An empty table gives no records.

    The payload's hash is grouped before anything else moves, so payloads are shuffled once, in the join
    with the groups that have more than one row; a group of very many copies is split there.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = addressed(pages.select("page_id", "url", "html"), "row", stored=True).select(
        "row",
        "page_id",
        F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("target"),
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    size, low = F.octet_length("payload"), None
    for high, records in SIZES:
        some = rows.where(size >= low) if low is not None else rows
        some = some.where(size < high) if high is not None else some
        _transactions(some).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{folder}/from-{low or 0}")
        low = high


def _transactions(rows: DataFrame) -> DataFrame:
    """The records of rows (row, page_id, target, payload, digest) as texts."""
    rows = rows.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    rows = rows.withColumn("record_id", _uuid("response", F.col("row"), F.col("page_id"), F.col("digest")))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "target", "row", "record_id", "page"))
    groups = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1")
    named = groups.select("digest", F.col("first.record_id").alias("original"), F.col("first.row").alias("original_row"))
    joined = rows.join(named, "digest", "left")
    revisits = F.coalesce(F.col("original_row") != F.col("row"), F.lit(False))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(RECORD_END))
    common = {"WARC_Date": F.lit("2024-01-01T00:00:00Z"), "WARC_Target_URI": F.col("target")}
    request = _record(
        "request", _uuid("request", F.col("record_id")), F.concat(F.lit("GET "), F.col("target"), F.lit(f" HTTP/1.1{RECORD_END}")),
        **common, WARC_Concurrent_To=F.col("record_id"), Content_Type=F.lit("application/http;msgtype=request"),
    )
    response = _record(
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")),
        F.col("record_id"),
        F.when(revisits, http).otherwise(F.concat(http, F.col("payload"))),
        **common,
        WARC_Payload_Digest=F.concat(F.lit("sha256:"), F.col("digest")),
        WARC_Profile=F.when(revisits, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        WARC_Refers_To=F.when(revisits, F.col("original")),
        Content_Type=F.lit("application/http;msgtype=response"),
    )
    metadata = _record(
        "metadata", _uuid("metadata", F.col("record_id")), F.concat(F.lit("page-id: "), F.col("page"), F.lit(EOL)),
        **common, WARC_Concurrent_To=F.col("record_id"), Content_Type=F.lit("application/warc-fields"),
    )
    # the three records of a page follow each other in the file
    texts = joined.select(F.explode(F.array(request, response, metadata)).alias("value"))
    return texts


def _records(data: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower case names) and block of each record in a stream of plain WARC bytes."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(data, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            size = len(held)
            if not fill(size + 1):
                if bytes(held).strip():
                    raise ValueError("an archive ends inside a record header")
                return
            end = held.find(b"\r\n\r\n", max(0, size - 3))
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("an archive ends inside a record")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def _plain(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Content in steps, unpacked if it is gzip (of one or many members)."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        for a in range(0, len(view), step):
            yield bytes(view[a : a + step])
        return
    unpack = zlib.decompressobj(31)
    for a in range(0, len(view), step):
        part = bytes(view[a : a + step])
        while part:
            out = unpack.decompress(part)
            if out:
                yield out
            part = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            elif not part:
                break


def _fields(head: dict, block: bytes) -> tuple:
    kind = head.get("warc-type", "")
    payload, page = None, None
    if kind in ("response", "revisit") and head.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    elif kind == "metadata":
        page = next((x.partition(":")[2].strip() for x in block.decode("utf-8").split("\r\n") if x.startswith("page-id:")), None)
    return head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), page, len(block), payload


NAMES = ["record_id", "warc_type", "target", "concurrent_to", "refers_to", "page", "block_bytes", "payload"]
TYPES = [pa.string()] * 6 + [pa.int64(), pa.binary()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    for files in batches:
        for content in files.column("content"):
            rows, size = [], 0
            for head, block in _records(_plain(content.as_py())):
                rows.append(_fields(head, block))
                size += len(block)
                if size > 4 << 20 or len(rows) >= 1000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives (plain or gzip) in a folder, one row each, told apart by Content-Length.

    Length and digest are those of a record's own payload, null without one.
    """
    records = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("content").mapInArrow(_read, FIELDS)
    return records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (record_id, warc_type, target, refers_to, payload, its length and digest, request, metadata).

    ``records`` may come without the payload, which then doesn't move.

    A capture is a response or revisit; request and metadata records join it through their concurrent-to
    identifier, directly or through the request. Several requests or metadata records of a capture are all
    kept, as arrays of structs in the order of their identifiers. A record that is concurrent to nothing known is
    left out; a capture without them has empty arrays.
    """
    side = records.where(F.col("warc_type").isin("request", "metadata")).select("record_id", "warc_type", "target", "concurrent_to", "page", "block_bytes")
    captures = records.where(F.col("warc_type").isin("response", "revisit"))
    requests = side.where("warc_type = 'request'").select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("via_to"))
    linked = side.join(requests, side["concurrent_to"] == requests["via"], "left").withColumn("capture", F.coalesce("via_to", "concurrent_to"))
    each = F.struct("record_id", "target", "page", "block_bytes")
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("warc_type") == kind, each)))
    # one transaction has a handful of records, each with an identifier of its own
    sides = linked.groupBy("capture").agg(pick("request").alias("request"), pick("metadata").alias("metadata"))
    none = F.array().cast("array<struct<record_id:string,target:string,page:string,block_bytes:bigint>>")
    own = [c for c in ("record_id", "warc_type", "target", "refers_to", "payload", "payload_bytes", "payload_digest") if c in records.columns]
    return captures.join(sides, captures["record_id"] == sides["capture"], "left").select(
        *[captures[c] for c in own], F.coalesce("request", none).alias("request"), F.coalesce("metadata", none).alias("metadata")
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Add ``refers_to_page``; a revisit gets the length and digest of the payload that it refers to.

    Only these move, and the payloads if they are asked for. A response that very many captures revisit is
    one row on its side of the join, and the other side is split.
    """
    # a response looks itself up: a null here would bring all of them to one place
    paged = captures.withColumns({"page": F.get(F.col("metadata"), 0)["page"], "there": F.coalesce("refers_to", "record_id")})
    originals = captures.where("warc_type = 'response'").select(
        F.col("record_id").alias("there"),
        F.col("payload_bytes").alias("there_bytes"),
        F.col("payload_digest").alias("there_digest"),
        F.get(F.col("metadata"), 0)["page"].alias("there_page"),
    )
    joined = paged.join(originals, "there", "left")
    full = {"payload_bytes": F.coalesce("payload_bytes", "there_bytes"), "payload_digest": F.coalesce("payload_digest", "there_digest")}
    referred = F.when(F.col("refers_to").isNotNull(), F.col("there_page"))
    return joined.withColumns(full | {"refers_to_page": referred}).drop("there", "there_bytes", "there_digest", "there_page")
