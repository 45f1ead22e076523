"""WARC archives compressed record by record with a dictionary of their own, written and read by Spark.

An archive (.warc.zst) begins with a skippable frame that holds a Zstandard dictionary, built from the archive's own records; each record
is one frame after it, compressed with that dictionary, so that a reader can begin at any record. A task gathers records until they are
`archive_bytes` long, builds the dictionary and hands the archive on as one row; Spark's text sink writes each row to a file of its
own and commits the files as it does for any table, so a lost executor leaves no half archive. The sink ends each row with a separator:
here an empty skippable frame, which readers pass over. Nothing is shuffled but digests.

Of records with equal payloads of at least `min_bytes` bytes, that of the smallest page id is a response and the others are revisits of
it, without payload. A digest that repeats is found by a partial aggregate; digests with many rows (at most 10,000 of them, by their
share of all rows) meet the pages as a table sent to all tasks, so a payload that a third of the pages have is no one task's work.

Null html counts as an empty payload. Rows with the smallest id of equal payloads are all responses if they repeat that id; null ids come
last, and if no row of a payload has an id all its rows are responses. A null url is left out of the record. Bytes that a URI may not
hold are percent-encoded in it. Other columns are left behind, an empty table makes no archive. Records longer than archive_bytes have an
archive of their own. Too few or too uniform records allow no dictionary: such an archive has none, and plain frames.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError
from ..runtime import stored
from ._runtime import blocks, ship

# Fixed values of the formats: magic numbers of a dictionary's and of an empty skippable frame and of a dictionary, the profile of revisits.
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
SEPARATOR = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
DICTIONARY = b"\x37\xa4\x30\xec"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records in an archive, before compression, and at most those of its dictionary.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: Digests of payloads that may be sent to all tasks.
HOT_MOST = 10_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _name(page_id: str, payload_digest: str) -> str:
    """The id of a record: the same for the same page id and payload, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {payload_digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or if refers_to names a page a revisit of it."""
    found = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id or "", found)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=-._~")))
    if page_id is not None:
        head.append(("X-Page-ID", quote(page_id, safe="")))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _name(refers_to, found)), ("X-Refers-To-Page-ID", quote(refers_to, safe=""))]
    head += [("WARC-Payload-Digest", f"sha1:{found}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of a record; a digest or length that does not hold is an error."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    size = int(head["Content-Length"])
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    length, found = int(fields["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = head["WARC-Type"] == "response"
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or whole and (len(payload) != length or digest(payload) != found):
        raise StorageError(f"Damaged record {head.get('WARC-Record-ID')}")
    ids = [unquote_to_bytes(head[k]).decode() if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
    return {
        "page_id": ids[0], "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "record_id": head["WARC-Record-ID"], "payload_bytes": length,
        "payload_digest": found, "refers_to": ids[1], "refers_to_record": head.get("WARC-Refers-To"), "payload": payload if whole else None,
    }


def archive(records: list[bytes], level: int = 3) -> bytes:
    """An archive of the records, without the separator at its end."""
    total = sum(map(len, records))
    trained, first = None, b""
    try:
        trained = zstandard.train_dictionary(max(1024, min(DICTIONARY_BYTES, total // 100)), records)
        if (raw := trained.as_bytes())[:4] == DICTIONARY:
            first = DICTIONARY_FRAME + len(raw).to_bytes(4, "little") + raw
    except zstandard.ZstdError:  # too few, too short or too equal
        trained = None
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained if first else None, write_checksum=True)
    return first + b"".join(map(packer.compress, records))


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, by the lengths of its blocks."""
    end = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run of one byte is one byte long
        if block & 1:
            break
    return end + (4 if data[at + 4] & 4 else 0)


def records_of(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other; bytes that are no frame are an error."""
    data, at, trained = memoryview(content), 0, None
    unpacker = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic >> 4 == 0x184D2A5:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == DICTIONARY_FRAME and trained is None and at == 0:
                trained = bytes(data[at + 8 : at + 8 + size])
                trained = trained if trained[:4] == DICTIONARY else unpacker.stream_reader(trained).readall()
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
            at += 8 + size
        elif magic == 0xFD2FB528:
            end = _frame_end(data, at)
            yield unpacker.decompressobj().decompress(data[at:end])
            at = end
        else:
            raise StorageError(f"No Zstandard frame at byte {at}")


def _judged(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, first: the smallest page id of the payload, where several rows have it and it is long enough."""
    rows = pages.withColumn("sha", F.sha2("payload", 256))
    ids = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    often = stored(ids.where("n > 1"))
    total = often.agg(F.sum("n")).first()[0]
    if not total:
        return pages.withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType))
    many = max(1_000, total // HOT_MOST)
    hot, cold = often.where(F.col("n") > many).select("sha", F.col("first").alias("hot")), often.where(F.col("n") <= many).select("sha", "first")
    rows = rows.join(F.broadcast(hot), "sha", "left").join(cold, "sha", "left")  # no more than HOT_MOST rows of hot
    return rows.select("page_id", "url", "payload", F.coalesce("hot", "first").alias("first"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the pages as archives into the new folder path, a file for each archive. date: of all records (pages have none)."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    pages = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    rows = _judged(pages, min_bytes).select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.when(again, F.col("first").cast("string")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["archive"])

        for block in blocks(batches):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in block.columns), strict=True):
                one = record(page_id, url, payload, refers_to, date)
                if held and size + len(one) > archive_bytes:
                    yield out()
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield out()

    packed = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("archive"))  # its bytes as they are
    packed.write.option("lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """The records of the archives under path: page_id, url, record_type, record_id, payload_bytes, payload_digest (both of the whole
    payload, also for a revisit), refers_to (the response's page id), refers_to_record, payload (null for a revisit)."""
    ship(spark)
    kinds = {"page_id": "string", "url": "string", "record_type": "string", "record_id": "string", "payload_bytes": "bigint", "payload_digest": "string", "refers_to": "string", "refers_to_record": "string", "payload": "binary"}
    schema = pa.schema([(k, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[v]) for k, v in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):  # an archive at a time
            for content in block.column(0):
                held, size = [], 0
                for raw in records_of(content.as_py()):
                    held.append(parsed(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = files.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))
    ids = {c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")}
    return found.select(*[ids.get(c, F.col(c)).alias(c) for c in found.columns])
