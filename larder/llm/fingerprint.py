"""Document fingerprints: one-permutation MinHash of word shingles, densified, with the low bits of each bin.

Each shingle is hashed once; the first bits choose a bin, the smallest rest stays. An empty bin takes the value of
another one, found by a walk over bins that depends on the empty bin alone, so that two documents fill a bin from the
same place as often as their shingles agree. Bins keep four bits; likeness takes off what equal bits happen by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import columns as C

SHINGLE_WORDS = 5
BIN_BITS, VALUE_BITS = 8, 4
BINS = 1 << BIN_BITS
_NONE = np.uint64((1 << 64) - 1)


class Fingerprinter:
    """Bins of the rows of a slice: values below 16, and which rows have any shingle."""

    def __init__(self, size: int = SHINGLE_WORDS):
        self.size = size
        self.rolling = C.Rolling(C.byte_table(29))
        self.walk = np.zeros((BINS, 0), np.int64)

    def _walk(self, steps: int) -> np.ndarray:
        """The bins to try for each empty bin, in turn."""
        if self.walk.shape[1] < steps:
            at = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(steps, dtype=np.uint64)
            self.walk = (C.mix(at + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        return self.walk

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        starts, ends, first = C.words(data, offsets)
        hashes, at = C.shingles(self.rolling.between(self.rolling.sums(data), starts, ends), first, self.size)
        row = np.repeat(np.arange(n), np.diff(at))
        lowest = np.full(n * BINS, _NONE)
        place = row * BINS + (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        np.minimum.at(lowest, place, hashes & np.uint64((1 << (64 - BIN_BITS)) - 1))
        filled = lowest != _NONE
        some = np.diff(at) > 0
        empty = np.flatnonzero(~filled & np.repeat(some, BINS))
        base, bin_ = empty - empty % BINS, empty % BINS
        step, width = 0, 4
        while len(empty):
            tried = base[:, None] + self._walk(1 << (step + width - 1).bit_length())[bin_, step : step + width]
            hit = filled[tried]
            found = hit.any(1)
            lowest[empty[found]] = lowest[tried[found, hit[found].argmax(1)]]
            empty, base, bin_ = empty[~found], base[~found], bin_[~found]
            step, width = step + width, min(4 * width, 256)
        return (lowest & np.uint64((1 << VALUE_BITS) - 1)).astype(np.uint8).reshape(n, BINS), some


def packed(values: np.ndarray, some: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text, one digit for each bin; a row without shingles has the empty one."""
    both = (values[:, ::2] << 4 | values[:, 1::2]).tobytes().hex()
    return [both[i * BINS : (i + 1) * BINS] if s else "" for i, s in enumerate(some.tolist())]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles of rows, 0 to 1. Two rows without shingles are alike, one with and one without aren't."""
    chance = 1 / (1 << VALUE_BITS)
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, found, np.where(a_some == b_some, 1.0, 0.0))


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row; a null text is empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(size)
        for batch, data, offsets in C.slices(batches, "text"):
            out = [batch.column("doc_id"), pa.array(C.char_counts(data, offsets)), pa.array(packed(*make(data, offsets)), pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_chars", "fingerprint"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ranges of doc_id, each a run of sorted rows that ends with the first row of the next range.

    That row has ``ahead`` true; the last range ends with the first row of all. Ties go by text; null ids come first. The
    texts are shuffled once; the rows that go to two ranges are as many as there are ranges.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    cut = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<long>")
    key = F.coalesce(F.size(F.filter(cut, lambda c: c <= F.col("doc_id"))), F.lit(0))
    rows = docs.select(F.when(F.col("doc_id").isNull(), 0).otherwise(key).alias("range"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = rows.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    every = Window.orderBy("range")  # one row per range
    before = F.coalesce(F.lag("range").over(every), F.max("range").over(Window.partitionBy()))
    heads = heads.select(before.alias("range"), "head.doc_id", "head.text", F.lit(True).alias("ahead"))
    both = rows.withColumn("ahead", F.lit(False)).unionByName(heads)
    return both.repartition("range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_first(), "text").drop("range")


def _edited(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each row but the last with its last quarter replaced by the beginning of the next row; code points of each row."""
    chars = C.char_counts(data, offsets)
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.concatenate([[0], np.cumsum(chars)])
    cut = chars[:-1] // 4
    keep = lead[first[:-2] + chars[:-1] - cut]
    take = lead[first[1:-1] + np.minimum(cut, chars[1:])]
    raw = data.tobytes()
    return [raw[a:b] + raw[c:d] for a, b, c, d in zip(offsets[:-2].tolist(), keep.tolist(), offsets[1:-1].tolist(), take.tolist())], chars


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_doc_id {0}"


def near_edits(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next document's are.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document
    in ascending doc_id; the first one comes after the last. A single row is its own next. Rows that repeat follow each
    other. An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, last = Fingerprinter(size), None
        names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
        for part, _, _ in C.slices(batches, "text"):
            if last is not None:
                part = pa.Table.from_batches([last, part]).combine_chunks().to_batches()[0]
            last = part.slice(part.num_rows - 1)
            if part.num_rows < 2:
                continue
            data, offsets = C.utf8(part.column("text"))
            texts, chars = _edited(data, offsets)
            values, some = make(data, offsets)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            new, new_some = make(np.frombuffer(b"".join(texts), np.uint8), bounds)
            doc_id = part.column("doc_id")
            out = pa.RecordBatch.from_arrays(
                [
                    doc_id.slice(0, part.num_rows - 1), pa.array(chars[:-1]), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                    pa.array(packed(values, some)[:-1], pa.string()), pa.array(packed(new, new_some), pa.string()),
                    pa.array(likeness(values[:-1], some[:-1], new, new_some)), pa.array(likeness(values[:-1], some[:-1], values[1:], some[1:])),
                    doc_id.slice(1),
                ],
                names,
            )
            # A row that only shows what comes next has no result here.
            own = ~part.column("ahead").to_numpy(zero_copy_only=False)[:-1].astype(bool)
            yield out.filter(pa.array(own))

    return in_order(docs).mapInArrow(rows, f"doc_id {kind}, {SCHEMA.format(kind)}")
