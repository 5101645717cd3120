"""WARC archives: an index first, then coalesced byte-range reads.

Records are gzip members of .warc.gz files in a folder that driver and executors share. The task that writes a file
also gives an index row for each record: file, offset, length, URL, payload digest, id and type. The index is written
as a table before anything is read, so that a file of a lost or repeated attempt, which no index row names, is never
read. To read, the selected index rows are sorted by file and offset, ranges that lie within `gap` bytes of each other
are joined up to `most` bytes, and each joined range is one read; tasks get ranges by the bytes to read.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is the response (of equal
page_ids, the first stored) and the others are revisits that refer to it. This is decided over digests alone; what
was decided is written by the part that a row was stored from, where the writing task finds it, so that payloads are
never shuffled, however many pages are equal.

Edge cases: a null html is an empty payload; a null url is empty; null page_ids are the smallest and come back null;
page_ids are integers or strings (an empty string comes back null); repeated rows are records of their own; other
columns are ignored whatever their names; a very long payload is one record, held whole while it is written; an empty
table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, StringType

from .common import cut, dealt, filesystem, map_arrow, noted, scratch, texts, with_group

ROLL = 256 << 20
PREFIX = "urn:page:"
PART_BITS = 33  # of a row's number, below its part's


def index_schema(kind: str) -> str:
    return f"file string, offset bigint, length bigint, url string, digest string, page_id {kind}, record_type string, refers_to {kind}"


def folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    return scratch(spark, "warc")


def named(page_id) -> str:
    return "" if page_id is None else quote(str(page_id), safe="")


def unnamed(urn: str, whole: bool):
    """The page_id of a record's name."""
    text = urn.strip("<>").removeprefix(PREFIX)
    return None if not text else int(text) if whole else unquote(text)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url: bytes, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of its payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    clean = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url)
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        f"WARC-Record-ID: <{PREFIX}{named(page_id)}>".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + clean,
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
    ]
    if kind == "revisit":
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PREFIX}{named(refers_to)}>".encode()]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block]) + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) of a record, its HTTP headers under http, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    out = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in fields.items()}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return out | {"http": dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:]), "payload": payload}


def decided(pages: DataFrame, least: int = 0) -> tuple[DataFrame, str]:
    """page_id, url, html, __row of every page, stored so that a number means the same row whenever it is read; and where
    dealt() put, by __part, the rows of payloads that occur more than once: __row, __refers (the response's page_id) and
    __revisit.
    """
    where = scratch(pages.sparkSession, "pages")
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.when(F.octet_length(html) >= least, F.sha1(html.cast("binary")))
    pages.select("page_id", "url", "html", digest.alias("__digest"), F.monotonically_increasing_id().alias("__row")).write.parquet(where)
    rows = pages.sparkSession.read.parquet(where)
    best = F.max(F.struct("page_id", F.negative("__row").alias("r")))
    told = rows.select("page_id", "__digest", "__row").filter("__digest is not null")
    twice = told.groupBy("__digest").agg(best.alias("b"), F.count("*").alias("n")).filter("n > 1")
    twice = cut(twice.select("__digest", "n", F.col("b.page_id").alias("__refers"), (-F.col("b.r")).alias("__response")))
    notes = with_group(told.select("__digest", "__row"), twice, "__digest", rows.count())
    notes = notes.select(F.shiftright("__row", PART_BITS).alias("__part"), "__row", "__refers", (F.col("__response") != F.col("__row")).alias("__revisit"))
    dealt(notes, "__part", f"{where}-notes")
    return rows.drop("__digest"), f"{where}-notes"


class Decisions:
    """The notes of decided() of the part that is being read."""

    def __init__(self, where: str):
        self.where, self.part, self.of = where, None, {}

    def __call__(self, row: int) -> tuple:
        """The page_id that a row's payload refers to, and whether the row is a revisit."""
        if row >> PART_BITS != self.part:
            self.part = row >> PART_BITS
            got = noted(self.where, "__part", self.part)
            self.of = {} if got is None else dict(zip(got["__row"].to_pylist(), zip(got["__refers"].to_pylist(), got["__revisit"].to_pylist(), strict=True), strict=True))
        return self.of.get(row, (None, False))


def write(pages: DataFrame, where: str, least: int = 0, level: int = 4, roll: int = ROLL) -> DataFrame:
    """Archives of the pages in the folder `where`, and the index, read back from its own table there."""
    kind = pages.schema["page_id"].dataType
    if not isinstance(kind, (IntegralType, StringType)):
        raise ValueError(f"page_id must be an integer or a string, not {kind.simpleString()}")
    rows, notes = decided(pages, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(where)
        fs.create_dir(path, recursive=True)
        out, name, at, decision = None, "", 0, Decisions(notes)
        for batch in batches:
            rows, ids = [], batch.column("page_id")
            for page, url, html, row in zip(ids.to_pylist(), texts(batch, "url"), texts(batch, "html"), batch.column("__row").to_pylist(), strict=True):
                if out is None or at >= roll:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                refers, again = decision(row)
                what, digest = "revisit" if again else "response", digest_of(html)
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = deflate.compress(record(what, page, url, html, digest, refers)) + deflate.flush()
                out.write(raw)
                rows.append((name, at, len(raw), url.decode("utf-8", "replace"), digest, page, what, refers if again else None))
                at += len(raw)
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), ids.type, pa.string(), ids.type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to"])
        if out:
            out.close()

    schema = index_schema(kind.simpleString())
    map_arrow(rows, run, schema).write.parquet(f"{where}/index")
    return pages.sparkSession.read.schema(schema).parquet(f"{where}/index")


def ranges(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """file, start, size, records (offset, length): sorted byte ranges, joined where they lie close.

    A file has at most ROLL bytes, so the rows that one window sorts are bounded.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("offset")
    rows = index.select("file", "offset", "length").withColumn("from", F.lag(F.col("offset") + F.col("length")).over(w))
    rows = rows.withColumn("jump", (F.col("from").isNull() | (F.col("offset") - F.col("from") > gap)).cast("int"))
    rows = rows.withColumn("run", F.sum("jump").over(w)).withColumn("start", F.min("offset").over(Window.partitionBy("file", "run")))
    rows = rows.withColumn("block", F.floor((F.col("offset") - F.col("start")) / most))
    return rows.groupBy("file", "run", "block").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).select("file", "start", (F.col("end") - F.col("start")).alias("size"), "records")


def read(index: DataFrame, where: str, payloads: bool = False, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """What the records that the index rows name hold: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A record whose payload isn't what its digest says is an error. A revisit's payload_bytes are those that its HTTP
    header states; its payload is null. Tasks are dealt ranges of about `most` bytes each, or of more where that would
    be over 64 tasks a core.
    """
    kind = index.schema["page_id"].dataType
    whole = isinstance(kind, IntegralType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(where)
        for batch in batches:
            for name, start, size, records in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size", "records")), strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    f.seek(start)
                    raw = f.read(size)
                rows = []
                for x in records:
                    a = x["offset"] - start
                    got = parse(zlib.decompress(raw[a : a + x["length"]], 31))
                    what, digest, refers = got["warc-type"], got["warc-payload-digest"].removeprefix("sha1:"), None
                    if what == "revisit":
                        refers, length = unnamed(got["warc-refers-to"], whole), int(got["http"][b"Content-Length"])
                    else:
                        length = len(got["payload"])
                        if digest_of(got["payload"]) != digest:
                            raise ValueError(f"{name} at {x['offset']}: the payload is not what the digest says")
                    rows.append((unnamed(got["warc-record-id"], whole), got["warc-target-uri"], length, digest, what, refers, got["payload"] if what == "response" else None))
                cols = list(zip(*rows, strict=True))
                ids = to_arrow_type(kind)
                kinds = [ids, pa.string(), pa.int64(), pa.string(), pa.string(), ids, pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                n = 7 if payloads else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds, strict=False)], names[:n])

    name = kind.simpleString()
    schema = f"page_id {name}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {name}" + ", payload binary" * payloads
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-size // most), 64 * index.sparkSession.sparkContext.defaultParallelism))
    return map_arrow(ranges(index, gap, most).repartition(tasks, "file", "start"), run, schema)
