"""Operator 12: WARC archives, written by Spark and read back as one nested row a capture.

Writing. Each capture is a transaction of three records: the request, the
response or a revisit, and metadata (application/warc-fields) that holds the
capture's key. Request and metadata name the response in WARC-Concurrent-To. Of
captures with equal payloads of some size the one with the smallest key is the
response; others are revisits that name it in WARC-Refers-To and hold no
payload. Records are lines of a text table whose line separator is the blank
lines that end a record, so Spark's own writer makes the archives: they go
wherever it can write, by its commit protocol.

Reading. Archives are read whole as binary files, unpacked as a stream, and cut
into records by their Content-Length, so a payload may hold anything. Records
are assembled by joins on their identifiers: requests and metadata to the record
they are concurrent to, revisits to the response that they refer to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, unused

#: Payloads shorter than this are never revisited.
SHORTEST = 100
#: Ways to deal captures of one payload, captures of an archive at most, and bytes of a batch of records.
SALTS, CAPTURES_PER_FILE, BATCH = 32, 20000, 8 << 20
#: Written as the date of captures without one.
NO_DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: What reading gives of each record; archives' further header lines are in head.
RECORD = "archive string, record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, content_type string, head string, http string, payload binary"


def _line(name: str, value: Column | str) -> Column:
    """A header line; none for a null value."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _identifier(kind: str, row: str = "_row") -> Column:
    """A record's identifier: of its row and kind, so a task that runs again gives the same."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), F.col(row)).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _record(kind: str, record_id: Column, more: list[Column], content_type: str, block: Column) -> Column:
    """A record without the blank lines that end it."""
    head = F.concat(F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", F.col("_date")), *more, _line("Content-Type", content_type))
    return F.concat(head, _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def _safe(text: Column) -> Column:
    """A text that fits a header line: each blank or control character becomes %20."""
    return F.regexp_replace(text, r"[\x00-\x20\x7F]", "%20")


def write_archives(captures: DataFrame, folder: str, *, key: str, payload: str, url: str | None = None, date: str | None = None, row: str | None = None, shortest: int = SHORTEST) -> None:
    """Writes a transaction for each row of captures (key, payload text, url, date) into archives in folder.

    Payloads are their texts' UTF-8 bytes; null ones are empty. A null url or
    date has no header (dates: 1970). A row without a key is a capture like any
    other whose metadata names no key, and comes after all keys among equals.
    Rows that repeat a key are captures each; of equal ones one is the response.
    row names a column whose values tell all rows apart, for good; without one the
    table is stored with numbers first. No rows give an archive without records."""
    if row is None:
        row = unused(captures, "_number")
        captures = stored(captures.withColumn(row, F.monotonically_increasing_id()))
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = captures.select(
        F.col(key).cast("string").alias("_key"), F.col(key).alias("_order"), F.col(row).cast("string").alias("_row"), body.alias("_body"), (_safe(F.col(url)) if url else F.lit(None).cast("string")).alias("_url"),
        F.coalesce(F.col(date).cast("string") if date else F.lit(None).cast("string"), F.lit(NO_DATE)).alias("_date"), F.sha2(body.cast("binary"), 256).alias("_sha"),
    )
    long = F.octet_length("_body") >= shortest
    first = F.min(F.struct(F.col("_order").isNull().alias("none"), F.col("_order").alias("key"), F.col("_row").alias("row")))
    firsts = rows.filter(long).groupBy("_sha").agg(first.alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_sha", F.col("_first.row").alias("_first"))
    # Only payloads that several captures have are in the other side; their captures are dealt by row.
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(firsts, ["_sha", "_salt"], "left")
    again = F.coalesce(F.col("_first") != F.col("_row"), F.lit(False))

    own = _identifier("response")
    target, concurrent = _line("WARC-Target-URI", F.col("_url")), _line("WARC-Concurrent-To", own)
    host = F.regexp_extract("_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract("_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    request = F.concat(F.lit("GET "), F.coalesce(path, F.lit("/")), F.lit(" HTTP/1.1\r\n"), _line("Host", host), F.lit("\r\n"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_sha")))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.octet_length("_body").cast("string")), F.lit("\r\n"))
    referred = _line("WARC-Refers-To", F.when(again, _identifier("response", "_first")))
    records = F.array(
        _record("request", _identifier("request"), [target, concurrent], "application/http; msgtype=request", request),
        F.when(again, _record("revisit", own, [target, digest, _line("WARC-Profile", REVISIT), referred], "application/http; msgtype=response", answer))
        .otherwise(_record("response", own, [target, digest], "application/http; msgtype=response", F.concat(answer, F.col("_body")))),
        _record("metadata", _identifier("metadata"), [target, concurrent], "application/warc-fields", _line("key", F.col("_key"))),
    )
    both.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE).text(folder)


def _unpacked(content: bytes | memoryview) -> Iterator[bytes]:
    """The bytes of an archive in parts; gzip (of any number of members) is told by its first bytes."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield content
        return
    rest = memoryview(content)
    while len(rest):
        member = zlib.decompressobj(31)
        while len(rest) and not member.eof:
            data = member.decompress(rest[: 1 << 18], 1 << 22)
            taken = min(len(rest), 1 << 18)
            rest = rest[taken - len(member.unconsumed_tail) - len(member.unused_data) :]
            if data:
                yield data
        tail = member.flush()
        if tail:
            yield tail
        if not member.eof or bytes(rest[:2]) != b"\x1f\x8b":
            return  # cut short, or padded


def cut_records(parts: Iterable[bytes]) -> Iterator[tuple[bytes, bytes, bool]]:
    """Header block, content block and whether it is whole, of each record of an archive in parts."""
    parts, buffer, at = iter(parts), bytearray(), 0

    def more() -> bool:
        nonlocal at
        part = next(parts, None)
        if part is None:
            return False
        del buffer[:at]
        at = 0
        buffer.extend(part)
        return True

    while True:
        while buffer[at : at + 2] == b"\r\n" or len(buffer) - at < 2:  # blank lines after a record
            if len(buffer) - at >= 2:
                at += 2
            elif not more():
                return
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(buffer) - at - 3)
            if not more():
                yield b"", bytes(buffer[at:]), False
                return
        head = bytes(buffer[at:end])
        sizes = [v for k, v in header_lines(head) if k == "content-length"]
        if not head.startswith(b"WARC/") or not sizes or not sizes[0].isdigit():
            yield head, bytes(buffer[end + 4 :]), False  # up to what was unpacked so far
            return
        at, size = end + 4, int(sizes[0])
        while len(buffer) - at < size and more():
            pass
        yield head, bytes(buffer[at : at + size]), len(buffer) - at >= size
        at += size
        if at > len(buffer):
            return


def header_lines(head: bytes) -> list[tuple[str, str]]:
    """Names, in lower case, and values of a header block's lines but the first."""
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return [(k.strip().lower(), v.strip()) for k, colon, v in pairs if colon]


def _row(archive: str, head: bytes, block: bytes, whole: bool) -> tuple:
    lines = header_lines(head)
    of = dict(reversed(lines))
    kind = of.get("content-type", "")
    http = None
    if kind.startswith("application/http"):
        top, blank, body = block.partition(b"\r\n\r\n")
        http, block = top.decode("utf-8", "replace"), body if blank else b""
    names = ("warc-record-id", "warc-type", None, "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "content-type")
    values = [[v for k, v in lines if k == "warc-concurrent-to"] if n is None else of.get(n) for n in names]
    if not whole:
        values[1] = "damaged"
    return archive, *values, head.decode("utf-8", "replace"), http, block


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in folder (RECORD); payload is the content, after HTTP headers where it has some.

    What can't be read as a record to its end is a record of type "damaged", and
    the end of its archive. An archive is a task's, and in memory packed; its
    records are sent on by BATCH bytes."""
    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 7, pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for some in batches:
            for i in range(some.num_rows):
                path, content = some.column(0)[i].as_py(), some.column(1)[i].as_buffer()
                for head, block, whole in cut_records(_unpacked(memoryview(content).cast("B"))):
                    rows.append(_row(path, head, block, whole))
                    size += len(head) + len(block) + 200
                    if size >= BATCH:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """A nested row for each capture: record_id, response (a struct of the response's or revisit's
    columns), requests and metadata (arrays of structs, by record_id).

    Records belong to the response or revisit that they name in concurrent_to, or
    that names them. records may have other columns than RECORD's, such as digests
    in place of payloads; they are joined by identifiers only. Requests and
    metadata whose response isn't there make a row without one; other types and
    records without an identifier are left out; of records that repeat an
    identifier one stays."""
    known = records.filter("record_id IS NOT NULL")
    answers = known.filter("type IN ('response', 'revisit')").dropDuplicates(["record_id"])
    others = known.filter("type IN ('request', 'metadata')").dropDuplicates(["record_id"])
    named = others.select("record_id", F.explode("concurrent_to").alias("capture"))
    naming = answers.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    links = named.unionByName(naming).distinct()
    whole = F.struct(*[F.col(c) for c in ["record_id", *(c for c in records.columns if c != "record_id")]])
    placed = others.select("record_id", "type", whole.alias("record")).join(links, "record_id")
    sorted_of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("record"))), _by_id)
    groups = placed.groupBy("capture").agg(sorted_of("request").alias("requests"), sorted_of("metadata").alias("metadata"))
    joined = answers.select(F.col("record_id").alias("capture"), whole.alias("response")).join(groups, "capture", "full_outer")
    lists = {c: F.coalesce(c, F.array().cast(groups.schema[c].dataType)) for c in ("requests", "metadata")}
    return joined.withColumns(lists).withColumnRenamed("capture", "record_id")


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)


def metadata_field(payload: Column, name: str) -> Column:
    """A field of a metadata record's content (lines of warc-fields); null without one."""
    return F.nullif(F.regexp_extract(payload.cast("string"), rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def with_original(captures: DataFrame, columns: dict[str, Column], record_id: str = "record_id", refers_to: str = "refers_to") -> DataFrame:
    """captures with columns (new names, of the capture that refers_to names); null where it names none.

    One row a capture that is referred to is dealt to all salts, so that one payload may have most captures."""
    wanted = captures.filter(F.col(refers_to).isNotNull()).select(F.col(refers_to).alias("_to")).distinct()
    found = captures.select(F.col(record_id).alias("_to"), *[v.alias(k) for k, v in columns.items()]).join(wanted, "_to", "left_semi")
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = captures.withColumns({"_to": F.col(refers_to), "_salt": F.pmod(F.xxhash64(record_id), F.lit(SALTS)).cast("int")})
    return dealt.join(found, ["_to", "_salt"], "left").drop("_to", "_salt")


def capture_digests(spark: SparkSession, folder: str) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to (a key) for each capture of archives of write_archives.

    A response's digest and size are of the bytes that were read; a revisit's size
    is its response's. Payloads don't go beyond the task that read them."""
    records = read_records(spark, folder)
    small = records.withColumns({
        "key": F.when(F.col("type") == "metadata", metadata_field(F.col("payload"), "key")),
        "bytes": F.octet_length("payload").cast("long"),
        "sha": F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)),
    })
    small = stored(small.select("record_id", "type", "concurrent_to", "refers_to", "key", "bytes", "sha"))
    captures = stored(assemble(small).select("record_id", "response.type", "response.refers_to", "response.bytes", "response.sha", F.get("metadata", F.lit(0))["key"].alias("key")))
    both = with_original(captures, {"first_key": F.col("key"), "first_bytes": F.col("bytes")})
    again = F.col("type") == "revisit"
    return both.select(
        "key", F.when(again, F.col("first_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), F.when(again, F.col("first_key")).alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to FROM q
"""
