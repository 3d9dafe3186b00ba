"""WARC archives as a table of record chunks, written and read in bounded memory."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import bounded, small, stored
from skein.llm.words import lean

#: Payload bytes in one chunk row; a longer payload takes several rows.
CHUNK = 64 * 1024
#: Bytes of chunk rows that a task gathers before it passes them on.
FLUSH = 4 << 20
#: Smaller payloads are never written as revisits.
MIN_REVISIT = 0
#: The archive's creation date; fixed, so that reruns write equal bytes.
DATE = "2024-01-01T00:00:00Z"

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def numbered(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(row, page_id, url, html): ``row`` tells the rows apart.

    It is the page_id where every row has its own; else the rows are numbered, and written
    once so that the numbers stay.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if own.groupBy("page_id").count().where("count > 1 or page_id is null").limit(1).count():
        return stored(spark, own.select(F.monotonically_increasing_id().alias("row"), "*"), "pages")
    return own.select(F.col("page_id").alias("row"), "*")


def _pieces(data: memoryview, chunk: int) -> Iterator[memoryview]:
    for at in range(0, len(data), chunk):
        yield data[at : at + chunk]


def _payloads(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text where they lie, nothing for null."""
    for x in column:
        yield memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")


@lean
def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, page_id, n, same): length and SHA-256 of each payload, taken piece by piece."""
    for b in batches:
        n, same = [], []
        for data in _payloads(b.column("html")):
            digest = hashlib.sha256()
            for piece in _pieces(data, CHUNK):
                digest.update(piece)
            n.append(len(data))
            same.append(digest.digest())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("page_id"), pa.array(n, pa.int64()), pa.array(same, pa.binary())], ["row", "page_id", "n", "same"])


def revisits(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(row, refers_to, refers_row) of the records that revisit another: no payloads, no digests.

    Of equal payloads of at least MIN_REVISIT bytes the smallest page_id is the response, on ties
    one of its rows; null page_ids come last, and payloads of null page_ids only are all
    responses, as nothing could refer to them. Equal payloads have one SHA-256. They are counted
    before the shuffle, and what comes back is a join of two plain shuffles, which adaptive
    execution splits where one payload is very common.
    """
    sized = stored(spark, rows.select("row", "page_id", "html").mapInArrow(_same, "row long, page_id long, n long, same binary").where(F.col("n") >= MIN_REVISIT), "payloads")
    known = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    first = sized.groupBy("same").agg(F.min(known).alias("f"), F.count("*").alias("many")).where("many > 1 and f.page_id is not null")
    first = stored(spark, first.select("same", F.col("f.page_id").alias("refers_to"), F.col("f.row").alias("refers_row")), "firsts")
    again = sized.join(first.hint("merge"), "same").where("row <> refers_row").select("row", "refers_to", "refers_row")
    return stored(spark, again, "revisits")


def record_urn(row: int) -> str:
    """A stable record id made from the record's number."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'record:{row}'.encode()).digest())}>"


def _header(row: int, page_id: int | None, url: str | None, refers_to: int | None, refers_row: int | None, digest: str, n: int) -> bytes:
    """The header block; url line ends would end its line and go."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_row is None else 'revisit'}", f"WARC-Record-ID: {record_urn(row)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {n}",
    ]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_row is not None:
        lines += [f"WARC-Refers-To: {record_urn(refers_row)}", f"Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {n if refers_row is None else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


CHUNKS = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("digest", pa.string()), ("bytes", pa.binary())])


def _write(chunk: int):
    """A mapInArrow function: the chunk rows of each record, FLUSH bytes of them at a time."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            facts = zip(*(b.column(c).to_pylist() for c in ("row", "page_id", "url", "refers_to", "refers_row")), strict=True)
            for (row, page_id, url, refers_to, refers_row), data in zip(facts, _payloads(b.column("html")), strict=True):
                whole = hashlib.sha1()
                for piece in _pieces(data, chunk):
                    whole.update(piece)
                head = _header(row, page_id, url, refers_to, refers_row, base64.b32encode(whole.digest()).decode(), len(data))
                pieces = max(1, -(-len(data) // chunk)) if refers_row is None else 1
                running = hashlib.sha1()
                for k in range(pieces):
                    body = data[k * chunk : (k + 1) * chunk] if refers_row is None else b""
                    running.update(body)
                    last = k == pieces - 1
                    out.append((row, page_id, k, last, running.hexdigest(), b"".join((head if k == 0 else b"", body, b"\r\n\r\n" if last else b""))))
                    held += len(out[-1][-1])
                    if held >= FLUSH:
                        yield _batch(out, CHUNKS)
                        out, held = [], 0
        if out:
            yield _batch(out, CHUNKS)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def chunk_table(spark: SparkSession, pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The archive: rows (row, page_id, chunk_no, last, digest, bytes); a record's bytes are its chunks' in order.

    A record for each row of ``pages``, whatever its page_id; null html is an empty payload,
    a null url an empty one, other columns are not looked at, and an empty table gives no
    rows. Chunk 0 begins with the header block; each chunk has ``chunk`` bytes of the payload
    at most (a revisit has none), and the last ends with the record's closing line ends. ``digest``
    is the SHA-1 of the payload up to the chunk's end. Payloads are digested and cut where they
    lie in the input's batch: no record is put together in memory.
    """
    bounded(spark)
    rows = numbered(spark, pages)
    planned = rows.join(small(revisits(spark, rows)), "row", "left")
    return planned.select("row", "page_id", "url", "html", "refers_to", "refers_row").mapInArrow(_write(chunk), "row long, page_id long, chunk_no int, last boolean, digest string, bytes binary")


class RecordReader:
    """Takes the chunks of one record after another; keeps the header and running digest only, never a payload."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.begin()

    def begin(self) -> None:
        self.head, self.fields, self.seen, self.digest, self.tail = b"", None, 0, hashlib.sha1(), b""

    def feed(self, data: bytes, last: bool) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                if last:
                    raise ValueError("a WARC record without an end of its header")
                return
            lines = self.head[:at].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("not a WARC record")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            data, self.head = self.head[at + 4 :], b""
        due = int(self.fields["Content-Length"]) - self.seen
        self.digest.update(data[:due])
        self.seen += min(due, len(data))
        self.tail += data[due:] if due < len(data) else b""
        if last:
            self.end()

    def end(self) -> None:
        f = self.fields
        if self.seen != int(f["Content-Length"]) or self.tail != b"\r\n\r\n":
            raise ValueError(f"record {f['WARC-Record-ID']}: its length is wrong")
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and base64.b32encode(self.digest.digest()).decode() != digest:
            raise ValueError(f"record {f['WARC-Record-ID']}: its digest is wrong")
        number = lambda k: int(f[k]) if k in f else None
        self.rows.append((number("Page-Id"), f["WARC-Record-ID"], f["WARC-Target-URI"], int(f["Payload-Length"]), digest, f["WARC-Type"], number("Refers-To-Page-Id")))
        self.begin()


RECORDS = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


@lean
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = RecordReader()
    for batch in batches:
        for data, last in zip(batch.column("bytes"), batch.column("last"), strict=True):
            reader.feed(data.as_py(), last.as_py())
        if reader.rows:
            yield _batch(reader.rows, RECORDS)
            reader.rows = []


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record of the archive, its lengths and digest checked chunk by chunk.

    A response's digest is that of the bytes read. Records of one chunk are read where they
    lie; the chunks of a longer record meet in one task and stream through it in order.
    """
    schema = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    whole = F.col("last") & (F.col("chunk_no") == 0)
    long = chunks.where(~whole).repartition("row").sortWithinPartitions("row", "chunk_no")
    return chunks.where(whole).union(long).select("bytes", "last").mapInArrow(_read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archive = stored(spark, chunk_table(spark, pages), "warc")
    return read_records(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX = "('0x' || substr(hex, i * 5 + 1, 5))::int"
ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, strlen(html) as payload_bytes, min(page_id) over (partition by html) as first, row_number() over (partition by html order by page_id nulls last) > 1 as again,
        array_to_string(list_transform(range(8), lambda i: {" || ".join(f"substr('{_B32}', (({_HEX} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))}), '') as payload_digest from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when again and first is not null then 'revisit' else 'response' end as record_type,
  case when again then first end as refers_to from d
"""
