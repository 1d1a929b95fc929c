"""Pack token sequences into windows without padding, by combinations of few lengths.

A document is cut into whole windows and a rest. Rests of one length are alike, so a histogram of at most as many lengths
as a window has tokens says all that packing needs. Every way to fill a window with one, two or three rests is a column;
non-negative least squares give how often each is used, so that the histogram is used up. These numbers are rounded, what
is left is solved again, and the last rests are laid end to end and cut where a window is full. The
very last tokens fill sequences of powers of two, which need no padding.

The plan says for ranges of the rank of a rest among those of its length where its tokens go. Spark ranks the rests and looks
the plan up; only rests that are cut are read a second time, for the checksums of their pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import columns as C
from larder.llm.store import stored
from larder.llm.tokens import Encoder, little_endian

#: Steps of a solution, and how often what rounding has left is solved again.
STEPS, ROUNDS = 300, 3
#: Copies of a checksum, so that a text that makes up much of the table isn't looked up by one task.
SALTS = 8


def combinations(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a window with one, two or three of the lengths: rows of three, descending, 0 for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    lengths = np.sort(lengths[lengths < capacity])
    for a in lengths.tolist():
        b = lengths[(lengths <= a) & (lengths <= capacity - a)]
        c = capacity - a - b
        ok = (c <= b) & (there[c] | (c == 0))
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def least_squares(ways: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How often to use each way, at least 0, so that the lengths used come near ``counts`` (by length).

    Accelerated projected gradient steps; short lengths weigh less, as they fit anywhere.
    """
    if not len(ways):
        return np.zeros(0)
    weight = np.where(8 * np.arange(capacity + 1) > capacity, 1.0, 0.3)
    weight[0] = 0.0
    scale = counts.sum() / 3
    target = counts / scale

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(ways.ravel(), np.repeat(x, 3), capacity + 1)

    def back(r: np.ndarray) -> np.ndarray:
        return (r * weight)[ways].sum(1)

    probe = np.ones(len(ways))
    for _ in range(20):
        probe = back(used(probe))
        largest = np.linalg.norm(probe)
        probe /= largest
    x, ahead, t = np.zeros(len(ways)), np.zeros(len(ways)), 1.0
    for _ in range(STEPS):
        new = np.maximum(ahead - back(used(ahead) - target) / (1.05 * largest), 0.0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + (before - 1) / t * (new - x)
        x = new
    return x * scale


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Places for ``counts`` rests by length: (length, first rank, end rank, at, size, sequence, offset, step).

    Of the rest with rank ``first`` + k, ``size`` tokens from ``at`` on lie ``offset`` + k ``step`` tokens after the start of
    ``sequence``, where sequences follow each other. The plan's size depends on the capacity alone.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    left, rank = Counter({n: c for n, c in counts.items() if c}), Counter()
    rows: list[tuple[int, int, int, int, int, int, int, int]] = []
    used = 0

    def fill(way: list[int], times: float) -> int:
        """As many windows of these lengths as asked for and possible."""
        nonlocal used
        parts = Counter(n for n in way if n)
        count = min(round(times), *(left[n] // k for n, k in parts.items()))
        offset = 0
        for n, k in parts.items() if count else ():
            for _ in range(k):
                rows.append((n, rank[n], rank[n] + count, 0, n, used, offset, capacity))
                rank[n] += count
                left[n] -= count
                offset += n
        used += count
        return count

    for _ in range(ROUNDS):
        open_ = np.array([left[n] for n in range(capacity + 1)], float)
        ways = combinations(np.flatnonzero(open_), capacity)
        times = least_squares(ways, open_, capacity)
        order = np.argsort(-times, kind="stable")
        order = order[times[order] >= 0.5]
        if not sum(fill(way, x) for way, x in zip(ways[order].tolist(), times[order].tolist())):
            break
    for way in combinations(np.array([n for n in left if left[n]], np.int64), capacity).tolist():
        fill(way, min(left[n] for n in way if n))  # exact ways that rounding has put at nothing

    # What is left lies end to end, the longest first, and is cut where a window ends.
    total = sum(n * c for n, c in left.items())
    edge, at = total // capacity * capacity, 0
    ends = [edge]
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if (total - edge) >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    for n in sorted((n for n in left if left[n]), reverse=True):
        inside = min(left[n], max(0, edge - at) // n)
        if inside:
            rows.append((n, rank[n], rank[n] + inside, 0, n, used, at, n))
        for k in range(inside, left[n]):  # fewer than two windows have of these
            from_, to = at + k * n, at + (k + 1) * n
            for i, (a, b) in enumerate(zip([edge - capacity, *ends], ends)):
                x, y = max(from_, a), min(to, b)
                if x < y:
                    rows.append((n, rank[n] + k, rank[n] + k + 1, x - from_, y - x, used + edge // capacity + i - 1, x - a, capacity))
        at += n * left[n]
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0) -> DataFrame:
    """Whole windows and the rest of each document: doc_id, text_hash, start, length, ids_crc32, doc_tokens, ids of the rest."""

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
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(size[row] - start, capacity)
            raw, from_ = np.ascontiguousarray(little_endian(tokens)).view(np.uint8).tobytes(), 4 * (at[row] + start)
            held = [raw[a:b] for a, b in zip(from_.tolist(), (from_ + 4 * length).tolist())]
            crc = [zlib.crc32(x) for x in held]
            whole = pa.array(length == capacity)
            out = [*(batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_hash")), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row])]
            out.append(pa.array([None if x else y for x, y in zip(whole.to_pylist(), held)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return docs.mapInArrow(rows, kinds)


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """Rows with their ``rank`` among those of their length, and how many there are of each length.

    A hash deals the rows of a length into shares; each is ranked by itself and starts where those before it end.
    """
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    sizes = stored(rows.groupBy("length", "share").count(), "window-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one row per length
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("l"), F.col("share").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy(*order)) - 1)
    ranked = ranked.join(sizes, (F.col("length") == F.col("l")) & (F.col("share") == F.col("s")))
    return ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("l", "s", "before", "share"), counts


def pack_windows(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of the pieces of all documents; no sequence needs padding.

    A document is the ids of its text and ``end``; a null text has ``end`` alone. A sequence has ``capacity`` tokens, a
    power of two, or, for the last rests, a smaller power of two. Rows that repeat are packed once each, also those without an id.
    An empty table gives an empty table.
    """
    if capacity & (capacity - 1):
        raise ValueError("a window's size must be a power of two")
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, end), "window-pieces")
    ranked, counts = _ranked(cut.drop("ids"), ["doc_id", "text_hash", "start"])
    places = plan(counts, capacity)
    slots = spark.createDataFrame(places, "l long, first long, stop long, at long, size long, sequence long, place long, step long")
    # The plan has some rows per length, whatever the number of pieces.
    met = ranked.join(F.broadcast(slots), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    met = met.withColumn("place", F.col("place") + (F.col("rank") - F.col("first")) * F.col("step"))
    offset, inside = F.col("place") % capacity, F.least(F.col("size"), capacity - F.col("place") % capacity)
    sequence = F.col("sequence") + F.floor(F.col("place") / capacity)
    here = F.struct(F.col("at"), inside.alias("size"), sequence.alias("sequence_id"), offset.alias("offset"))
    next_ = F.struct((F.col("at") + inside).alias("at"), (F.col("size") - inside).alias("size"), (sequence + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = F.explode(F.when(F.col("size") > inside, F.array(here, next_)).otherwise(F.array(here)))
    placed = met.select("doc_id", "text_hash", "start", F.col("length"), "ids_crc32", "doc_tokens", parts.alias("part")).select("*", "part.*").drop("part")
    out = ["doc_id", (F.col("start") + F.col("at")).alias("start"), F.col("size").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    parted = sorted({x[0] for x in places if x[4] < x[0] or x[7] < capacity})
    whole = placed.filter("size = length").select(*out)
    if not parted:
        return whole
    placed = stored(placed.filter("size < length"), "window-parts")
    held = cut.filter(F.col("length").isin(parted)).select("doc_id", "text_hash", "ids").dropDuplicates(["doc_id", "text_hash"])
    wanted = placed.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), F.col("at").alias("a"), F.col("size").alias("n")).distinct()
    checked = wanted.join(held, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    checked = checked.select("i", "h", "a", "n", F.crc32(F.substr("ids", F.lit(4) * F.col("a") + 1, F.lit(4) * F.col("n"))).alias("crc"))
    checked = checked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")) & (F.col("at") == F.col("a")) & (F.col("size") == F.col("n"))
    parts = placed.join(checked, same & (F.pmod("sequence_id", F.lit(SALTS)) == F.col("salt")))
    return whole.unionByName(parts.withColumn("ids_crc32", F.col("crc")).select(*out))
