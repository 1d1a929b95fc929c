"""WARC archives of pages, written and read as a table of chunks.

A payload that is larger than a chunk becomes several rows of (record, chunk number), each with the digest of all bytes
up to its end. Each row is written as one WARC record: the first as the response, the others as its continuation
segments. No step holds more of a payload than a chunk beside the value it came in. Archives are compressed text files
of Spark's own writer, so a lost task leaves nothing behind; they are read as binary files and unpacked as a stream.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import columns as C

CHUNK_BYTES = 64 << 10
#: Records of one archive; with the size of a chunk, the bound of its size.
ARCHIVE_RECORDS = 4096
#: Fixed value: a date for all records, so that reruns agree.
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "record string, chunk int, chunks int, page_id long, url string, refers_to long, digest string, payload_bytes long, bytes_so_far long, digest_so_far string, payload string"
PARTS = "record string, chunk int, chunks int, page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary, payload_digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def cuts(data: memoryview, size: int) -> list[int]:
    """Ends of chunks of at most ``size`` bytes that split no character; an empty payload is one chunk."""
    ends, at = [], 0
    while at + size < len(data):
        at += size
        while data[at] & 0xC0 == 0x80:
            at -= 1
        ends.append(at)
    return [*ends, len(data)]


def chunk_table(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of (record, chunk) for all pages; a revisit is one row without payload.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is the response. A
    null html is an empty payload, a null url an empty one. Rows that repeat a page_id and its payload are all responses.
    A row with a null page_id revisits the response if any row with that payload has an id.
    """
    if chunk_bytes < 4:
        raise ValueError("a chunk must hold a character")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("html"))).withColumn("size", F.octet_length("html").cast("long"))
    # Payloads are digested, counted and matched in the engine; only those that are found more than once are joined.
    twice = rows.filter(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    twice = twice.filter("n > 1").select(F.col("sha1").alias("s"), F.col("size").alias("b"), "first")
    rows = rows.join(twice, (F.col("sha1") == F.col("s")) & (F.col("size") == F.col("b")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = rows.select("page_id", "url", "sha1", F.col("size").alias("payload_bytes"), refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        part, n = TaskContext.get().partitionId(), 0
        out: list[list[Any]] = []
        held = 0
        for batch in batches:
            page, url, sha1, size, refers = (batch.column(k).to_pylist() for k in ("page_id", "url", "sha1", "payload_bytes", "refers_to"))
            data, offsets = C.utf8(batch.column("html"))
            view = memoryview(data)
            for i in range(batch.num_rows):
                payload = view[offsets[i] : offsets[i + 1]]
                record, ends = f"{part}-{n}", cuts(payload, chunk_bytes)
                n += 1
                running, start = hashlib.sha1(usedforsecurity=False), 0
                for k, end in enumerate(ends):
                    running.update(payload[start:end])
                    out.append([record, k, len(ends), page[i], url[i], refers[i], base32(sha1[i]), size[i], end, base32(running.digest()), str(payload[start:end], "utf-8")])
                    held, start = held + 1000 + end - start, end
                    if held > C.SLICE_BYTES:
                        yield _batch(out, names, kinds)
                        out, held = [], 0
        if out:
            yield _batch(out, names, kinds)

    kinds = _kinds(CHUNKS)
    return rows.mapInArrow(split, CHUNKS)


def _kinds(schema: str) -> list[pa.DataType]:
    known = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [known[x.split()[1]] for x in schema.split(", ")]


def _batch(rows: list[list[Any]], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _line(text: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c not in "\x85  " else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_text(x: dict[str, Any]) -> str:
    """One WARC record without its last line feed."""
    head = {"WARC-Type": "response" if x["chunk"] == 0 else "continuation", "WARC-Date": DATE, "WARC-Target-URI": _line(x["url"])}
    head["WARC-Record-ID"] = f"<urn:page:{'' if x['page_id'] is None else x['page_id']}#{x['record']}.{x['chunk']}>"
    head["WARC-Payload-Digest"] = f"sha1:{x['digest']}"
    block = "" if x["chunk"] else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {x['payload_bytes']}\r\n\r\n"
    if x["refers_to"] is not None:
        head |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:page:{x['refers_to']}>"}
    if x["chunks"] > 1:
        head["WARC-Segment-Number"] = str(x["chunk"] + 1)
        if x["chunk"]:
            head["WARC-Segment-Origin-ID"] = f"<urn:page:{'' if x['page_id'] is None else x['page_id']}#{x['record']}.0>"
        if x["chunk"] == x["chunks"] - 1:
            head["WARC-Segment-Total-Length"] = str(x["payload_bytes"])
        head["X-Segments"] = str(x["chunks"])
        head["X-Payload-Bytes"] = str(x["payload_bytes"])
        head["X-Digest-So-Far"] = f"sha1:{x['digest_so_far']}"
    if x["chunk"] == 0:
        head["Content-Type"] = "application/http; msgtype=response"
    block += x["payload"]
    head["Content-Length"] = str(len(block.encode()))
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + f"\r\n{block}\r\n\r"


def write_archives(chunks: DataFrame, path: str, records: int = ARCHIVE_RECORDS) -> None:
    """Write every row as a record of a gzip-compressed archive in the folder ``path``."""

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([record_text(x) for x in batch.to_pylist()], pa.string())], ["value"])

    lines = chunks.mapInArrow(text, "value string")
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", records).option("lineSep", "\n").text(path)


class _Stream:
    """Reads lines and exact numbers of bytes from compressed bytes, unpacking a step at a time."""

    def __init__(self, data: memoryview, step: int = 1 << 18):
        self.data, self.step, self.at = data, step, 0
        self.unzip = zlib.decompressobj(31)
        self.rest = bytearray()

    def _more(self) -> bool:
        if self.unzip.eof:
            left = self.unzip.unused_data
            self.unzip = zlib.decompressobj(31)
            if not left and self.at >= len(self.data):
                return False
            piece = left
        else:
            piece = self.unzip.unconsumed_tail
        if not piece:
            piece = bytes(self.data[self.at : self.at + self.step])
            self.at += self.step
        if not piece:
            return False
        self.rest += self.unzip.decompress(piece, self.step)
        return True

    def until(self, mark: bytes) -> bytes | None:
        from_ = 0
        while (end := self.rest.find(mark, from_)) < 0:
            from_ = max(0, len(self.rest) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.rest[:end])
        del self.rest[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.rest) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.rest[:n])
        del self.rest[:n]
        return out


def parse(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:80]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        yield fields, stream.take(int(fields["Content-Length"]))
        stream.take(4)


def _page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">").partition("#")[0]
    return int(number) if number else None


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives: the chunk table again, with the digest of what was read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in PARTS.split(", ")], _kinds(PARTS)
        out: list[list[Any]] = []
        held = 0
        for batch in batches:
            for content in batch.column("content"):
                for head, block in parse(memoryview(content.as_buffer())):
                    record, _, chunk = head["WARC-Record-ID"].partition("#")[2].rstrip(">").partition(".")
                    size = int(head.get("X-Payload-Bytes", -1))
                    if chunk == "0":
                        http, _, block = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                    chunks, revisit = int(head.get("X-Segments", 1)), head["WARC-Type"] == "revisit"
                    own = base32(hashlib.sha1(block, usedforsecurity=False).digest()) if chunks == 1 and not revisit else None
                    out.append([
                        record, int(chunk), chunks, _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], "revisit" if revisit else "response",
                        _page(head["WARC-Refers-To"]) if revisit else None, head["WARC-Payload-Digest"].removeprefix("sha1:"), size,
                        block if chunks > 1 else None, own,
                    ])
                    held += 500 + len(block)
                    if held > C.SLICE_BYTES:
                        yield _batch(out, names, kinds)
                        out, held = [], 0
        if out:
            yield _batch(out, names, kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, PARTS)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def records(parts: DataFrame) -> DataFrame:
    """One row per page from the rows of :func:`read_parts`. Fails if a payload isn't the one that its record states.

    Chunks of a record follow each other in a sorted partition; only a running digest is kept between them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in RECORDS.split(", ")], _kinds(RECORDS)
        running, size, expected = hashlib.sha1(usedforsecurity=False), 0, 0
        for batch in batches:
            out = []
            for small in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for x in small.to_pylist():
                    own = x["payload_digest"]
                    if x["chunks"] > 1:
                        if x["chunk"] != expected:
                            raise ValueError(f"record {x['record']}: chunk {x['chunk']} in place of {expected}")
                        running.update(x["payload"])
                        size, expected = size + len(x["payload"]), expected + 1
                        if expected < x["chunks"]:
                            continue
                        own = base32(running.digest())
                        if size != x["payload_bytes"]:
                            raise ValueError(f"record {x['record']}: {size} bytes in place of {x['payload_bytes']}")
                        running, size, expected = hashlib.sha1(usedforsecurity=False), 0, 0
                    if x["record_type"] == "response" and own != x["digest"]:
                        raise ValueError(f"record {x['record']}: digest {own} in place of {x['digest']}")
                    out.append([x["page_id"], x["url"], x["payload_bytes"], x["digest"], x["record_type"], x["refers_to"]])
            if out:
                yield _batch(out, names, kinds)

    together = parts.repartition("record").sortWithinPartitions("record", "chunk")
    return together.mapInArrow(fold, RECORDS)


def archive(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write archives of all pages to ``path`` and read them back, one row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Empty tables give no archive and no rows. Other columns are left alone.
    """
    write_archives(chunk_table(pages, least_bytes, chunk_bytes), path)
    return records(read_parts(pages.sparkSession, path))
