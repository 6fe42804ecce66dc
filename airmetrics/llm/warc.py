"""Operator 9: WARC archives of pages, and a reader that salvages damaged ones.

Writing. One WARC/1.1 record per page, payload the page's bytes. Pages with equal payloads
are grouped by SHA-1 and length: the one with the largest page id is a ``response``, the
others are ``revisit`` records that refer to it and carry no payload. Only the losers of a
group travel as (page id, payload, winner) triples; the payloads themselves are never
shuffled when that list has a small, counted size, else they are joined with it by page
id. Records are written with Spark's text writer whose line separator is the WARC record
terminator, so Spark's commit protocol decides which attempt's file counts.

Reading (``read_warc``). Plain archives and archives of gzip members (one per record). A
record counts when its version line, headers, length, terminator and block digest hold. After a failed check the reader looks
for the next gzip member or version line behind the damage, goes on there, and logs the bytes
it left out as a quarantined gap (first byte, length, reason). A damaged record loses only itself.

Defined results: null html is an empty payload; payloads shorter than ``least_bytes`` are
all ``response``; rows repeated with the same page id and payload are each a record, all
``response`` if that id is the group's largest; a null page id never wins over an id and
is ``response`` where its group has no id at all; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.llm.common import stored

TERMINATOR = b"\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 40-digit hex string: every 5 hex digits are 4 base-32 digits."""
    out = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("long")
        out += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31).cast("int") + 1, F.lit(1))
                for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _header(*lines: Column) -> Column:
    return F.concat(F.lit("WARC/1.1\r\n"), *[x for line in lines for x in (line, F.lit("\r\n"))], F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, broadcast_rows: int = 100_000,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the archives (files of at most 4,096 records)."""
    src = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"),
                       F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("body"))
    src = src.withColumn("size", F.octet_length("body").cast("long"))
    keyed = src.select("id", F.sha1(F.col("body").cast("binary")).alias("sha"), "size").where(F.col("size") >= least_bytes)
    groups = (keyed.groupBy("sha", "size").agg(F.max("id").alias("winner"), F.count("*").alias("n"),
                                               F.count("id").alias("n_id"))
              .where("n > 1 and n_id > 0").select("sha", "size", "winner"))
    losers = stored(keyed.join(groups, ["sha", "size"]).where("id is null or id <> winner")
                    .select("id", "sha", "size", "winner").distinct(), "warc-losers")
    small = len(losers.select("id").limit(broadcast_rows + 1).collect()) <= broadcast_rows
    lose = losers.select(F.col("id").alias("l_id"), F.col("sha").alias("l_sha"), F.col("size").alias("l_size"), "winner")
    lose = F.broadcast(lose) if small else lose
    rec = src.withColumn("sha", F.sha1(F.col("body").cast("binary"))).join(
        lose, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("sha") == F.col("l_sha")) & (F.col("size") == F.col("l_size")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    one_line = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")
    digest = base32_of_hex(F.col("sha"))
    revisit = F.col("winner").isNotNull()
    common = [F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
              F.concat(F.lit("WARC-Target-URI: "), one_line),
              F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
              F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string"))]
    full = F.concat(_header(F.lit("WARC-Type: response"), *common, F.lit("Content-Type: text/html; charset=utf-8"),
                            F.concat(F.lit("WARC-Block-Digest: sha1:"), digest),
                            F.concat(F.lit("Content-Length: "), F.col("size").cast("string"))), F.col("body"))
    empty_digest = base64.b32encode(hashlib.sha1(b"").digest()).decode()
    short = _header(F.lit("WARC-Type: revisit"), *common,
                    F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    F.concat(F.lit("WARC-Refers-To: "), urn(F.col("winner"))),
                    F.lit(f"WARC-Block-Digest: sha1:{empty_digest}"), F.lit("Content-Length: 0"))
    (rec.select(F.when(revisit, short).otherwise(full).alias("value"))
     .write.option("lineSep", TERMINATOR.decode()).option("maxRecordsPerFile", 4096).text(path))


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record whose version line is at ``at``; raises ValueError when a check fails."""
    line = _LINE.match(raw, at)
    if not line:
        raise ValueError("no version line")
    stop = raw.find(b"\r\n\r\n", line.end() - 2, line.end() + (1 << 20))
    if stop < 0:
        raise ValueError("headers do not end")
    head = {}
    for x in raw[line.end():stop].split(b"\r\n"):
        name, sep, value = x.partition(b":")
        if not sep:
            raise ValueError("bad header line")
        head[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise ValueError("bad Content-Length")
    begin = stop + 4
    end = begin + int(size)
    if raw[end:end + 4] != TERMINATOR:
        raise ValueError("no record terminator")
    block = raw[begin:end]
    want = head.get("warc-block-digest")
    if want and want != f"sha1:{_digest(block)}":
        raise ValueError("block digest differs")
    return head, block, end + 4


def salvage(raw: bytes):
    """Yield ("record", at, headers, block) and ("gap", at, length, reason) over an archive's bytes."""
    at = 0
    bad_at, why = None, ""
    while at < len(raw):
        try:
            if raw[at:at + 3] == b"\x1f\x8b\x08":
                unzip = zlib.decompressobj(31)
                try:
                    data = unzip.decompress(raw[at:]) + unzip.flush()
                except zlib.error as e:
                    raise ValueError(f"bad member: {e}") from e
                if not unzip.eof:
                    raise ValueError("member is cut off")
                head, block, end = parse_record(data, 0)
                if end != len(data):
                    raise ValueError("member holds more than a record")
                after = len(raw) - len(unzip.unused_data)
            else:
                head, block, after = parse_record(raw, at)
        except ValueError as e:
            if bad_at is None:
                bad_at, why = at, str(e)
            nxt = _START.search(raw, at + 1)
            at = nxt.start() if nxt else len(raw)
            continue
        if bad_at is not None:
            yield "gap", bad_at, at - bad_at, why
            bad_at = None
        yield "record", at, head, block
        at = after
    if bad_at is not None:
        yield "gap", bad_at, len(raw) - bad_at, why


READ_SCHEMA = ("path string, at long, gap_bytes long, reason string, record_type string, record_id string, "
               "refers_to string, uri string, payload_digest string, payload_bytes long, payload binary")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "part-*") -> DataFrame:
    """One row per record, and one per quarantined gap (``gap_bytes`` not null)."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(),
             pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for kind, at, x, y in salvage(raw.as_py()):
                    if kind == "gap":
                        rows.append((name, at, x, y, *[None] * 7))
                    else:
                        digest = x.get("warc-payload-digest", "").removeprefix("sha1:") or _digest(y)
                        length = x.get("warc-payload-length", "")
                        rows.append((name, at, None, None, x.get("warc-type"), x.get("warc-record-id"),
                                     x.get("warc-refers-to"), x.get("warc-target-uri"), digest,
                                     int(length) if length.isdigit() else len(y), y if with_payload else None))
                        size += len(y) * with_payload
                    if len(rows) >= 4096 or size > 1 << 23:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))
    return files.mapInArrow(run, READ_SCHEMA)


def page_rows(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back."""
    def number(c):
        return F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("null")).cast("long")

    return records.where("gap_bytes is null").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))
