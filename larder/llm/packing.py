"""Pack token sequences of bounded length into as few full sequences as best fit can.

Pieces of one length are alike, so packing needs no more than how many there are of each length: a table with at most as
many rows as a sequence has tokens. The plan made from it says, for ranges of the rank of a piece among those of its
length, in which sequences they go and where. Spark ranks the pieces and looks the plan up.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import columns as C
from larder.llm.store import stored
from larder.llm.tokens import Encoder, little_endian


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, and the ids themselves if wanted.

    A document is the ids of its text and ``end``; a null text has ``end`` alone. Only a document with more than
    ``capacity`` tokens is cut; then its first piece is the shorter one. Repeated rows give their pieces once each.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch, data, offsets in C.slices(batches, "text"):
            tokens, at = encode(data, offsets)
            n = len(at) - 1
            tokens = np.insert(tokens, at[1:], np.uint32(end))
            at = at + np.arange(n + 1)
            size = np.diff(at)
            count = -(-size // capacity)
            row = np.repeat(np.arange(n), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = (size - 1) % capacity + 1  # of the first piece
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            raw, from_ = memoryview(np.ascontiguousarray(little_endian(tokens)).view(np.uint8)), 4 * (at[row] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(from_.tolist(), (from_ + 4 * length).tolist())]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                bounds = np.append(at[row] + start, at[-1]).astype(np.int32)  # the pieces of a slice follow each other
                out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(tokens.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    docs = docs.select("doc_id", "text")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.mapInArrow(rows, kinds + ", ids array<int>" * ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for pieces by length and rank: (length, first rank, end rank, first sequence, pieces per sequence, offset).

    Pieces above a third of the capacity come at most two to a sequence: from the longest down, each is matched with the
    longest other one that still fits. Shorter pieces, from the longest down, go where they leave the least gap, and into
    new sequences when they fit nowhere. Every step uses up a length or the sequences with one gap, so that the plan's
    size depends on the capacity alone.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_: list[int] = []  # gaps with sequences, ascending
    used = 0

    def place(length: int, count: int, first: int, each: int, offset: int) -> None:
        out.append((length, rank[length], rank[length] + count, first, each, offset))
        rank[length] += count
        left[length] -= count

    def add(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_, gap)
            gaps[gap].append((first, count))

    def drop(gap: int) -> None:
        gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            open_.remove(gap)

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect.bisect_right(large, min(n, capacity - n)) - 1
        while k >= 0 and large[k] == n and left[n] < 2:
            k -= 1
        if k < 0:
            count = left[n]
            place(n, count, used, 1, 0)
            add(capacity - n, used, count)
        else:
            m = large[k]
            count = left[n] // 2 if m == n else min(left[n], left[m])
            if m == n:
                place(n, 2 * count, used, 2, 0)
            else:
                place(n, count, used, 1, 0)
                place(m, count, used, 1, n)
            add(capacity - n - m, used, count)
        used += count
        large = [x for x in large if left[x]]

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(open_, n)
            if k < len(open_):
                gap = open_[k]
                first, count = gaps[gap][-1]
                drop(gap)
            else:
                gap, first, count = capacity, used, -(-left[n] // (capacity // n))
                used += count
            each = gap // n
            full = min(count, left[n] // each)
            if full:
                place(n, full * each, first, each, capacity - gap)
                add(gap - each * n, first, full)
            elif left[n]:
                some, full = left[n], 1
                place(n, some, first, some, capacity - gap)
                add(gap - some * n, first, 1)
            if gap < capacity or count > full:
                add(gap, first + full, count - full)
    return out


def pack(rows: DataFrame, order: list[str], capacity: int = 1024) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``; ``length`` says how many tokens a row has, ``order`` ranks those of one length.

    Rows are ranked within a length in shares that a hash deals out, so that no length is one task's work; each share then
    starts where the ones before it end. Rows that agree in all of ``order`` get different places.
    """
    spark = rows.sparkSession
    shares = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    sizes = stored(rows.groupBy("length", "__share").count(), "pack-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one row per length
    slots = spark.createDataFrame(plan(counts, capacity), "l long, first long, end long, sequence long, each long, base long")
    before = Window.partitionBy("length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("l"), F.col("__share").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__share").orderBy(*order)) - 1)
    ranked = ranked.join(sizes, (F.col("length") == F.col("l")) & (F.col("__share") == F.col("s"))).drop("l", "s")
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before"))
    # The plan has a few rows per length, whatever the number of pieces.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("l")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("end")))
    nth = F.col("__rank") - F.col("first")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("each")))
    placed = placed.withColumn("offset", F.col("base") + nth % F.col("each") * F.col("length"))
    return placed.drop("__share", "__rank", "__before", "l", "first", "end", "sequence", "each", "base")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place; see :func:`pieces` and :func:`pack`. An empty table gives an empty table."""
    cut = stored(pieces(docs, tokenizer, capacity, end, ids), "pack-pieces")
    return pack(cut, ["doc_id", "piece", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
