"""Near duplicates by a multi-index join of b-bit MinHash signatures, confirmed on whole sets.

Texts with equal shingle sets are one class. The signature of a class has 60 symbols of 8 bits in 10 chunks of 6. Every
chunk is indexed with each one of its symbols left out, so that two signatures meet in a chunk where they differ in at
most one symbol. By the pigeonhole principle all pairs that differ in at most 19 symbols meet; a pair with 80 % common
shingles, whose chunks differ by chance, meets with probability 0.99997.

Classes that meet are not paired with each other. First each one is paired with the busiest class that it meets, which
joins most of a large family at little cost. Then only where what meets is still of several components, the members
outside the largest are compared with all others by their signatures, and the nearest member of each other component is
confirmed. A member that it doesn't link is compared with the sets of the whole component, block by block, so that no
link is missed and no pair is written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import columns as C
from larder.llm.components import components
from larder.llm.store import stored

CHUNKS, CHUNK = 10, 6
SYMBOLS = CHUNKS * CHUNK
#: Pairs whose signatures differ in more symbols aren't confirmed. At 80 % common shingles 12 differ on average; more than
#: 27 do once in a million such pairs.
MOST_DIFFERENT = 27
WORDS = SYMBOLS // 8 + 1  # longs of a signature
#: Rows of a key that are compared with each other in one piece, and sets of a component.
BLOCK, SET_BLOCK = 1024, 256


def _hashed(data: np.ndarray, offsets: np.ndarray, size: int, rolling: C.Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row."""
    starts, ends, first = C.words(data, offsets)
    hashes, at = C.shingles(rolling.between(rolling.sums(data), starts, ends), first, size)
    return C.distinct(hashes, at)


def _rolling() -> C.Rolling:
    return C.Rolling(C.byte_table(11, lower=True))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, two sums that name the set, and the signature as longs s0, s1, ... of eight symbols."""
    random = np.random.default_rng(12)
    flip = random.integers(0, 1 << 63, SYMBOLS, np.uint64)
    scale = random.integers(0, 1 << 62, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling()
        for batch, data, offsets in C.slices(batches, "text"):
            hashes, at = _hashed(data, offsets, size, rolling)
            n, some = np.diff(at), np.flatnonzero(np.diff(at))
            names = np.zeros((2, len(n)), np.uint64)
            symbols = np.zeros((len(n), 8 * WORDS), np.uint8)
            if len(some):
                for k in range(2):
                    names[k, some] = np.add.reduceat(C.mix(hashes + np.uint64(k + 1)), at[some])
                for k in range(SYMBOLS):
                    symbols[some, k] = np.minimum.reduceat((hashes ^ flip[k]) * scale[k], at[some]) & np.uint64(255)
            longs = np.ascontiguousarray(symbols).view("<i8").T
            out = [batch.column("doc_id"), batch.column("text_hash"), pa.array(n), *[pa.array(x.view(np.int64)) for x in names], *[pa.array(np.ascontiguousarray(x)) for x in longs]]
            yield pa.RecordBatch.from_arrays(out, columns)

    columns = ["doc_id", "text_hash", "n_shingles", "name_a", "name_b", *_signature()]
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return docs.mapInArrow(rows, ", ".join(f"{c} long" for c in columns))


def _signature() -> list[str]:
    return [f"s{i}" for i in range(WORDS)]


def _keys(classes: DataFrame) -> DataFrame:
    """(node, key) for each chunk of each class with each one of its symbols left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longs = np.stack([batch.column(c).to_numpy() for c in _signature()], 1)
            symbols = longs.view(np.uint8)[:, :SYMBOLS].astype(np.int64).reshape(-1, CHUNKS, CHUNK)
            keys = np.empty((len(longs), CHUNKS, CHUNK), np.int64)
            for out in range(CHUNK):
                packed = np.zeros(symbols.shape[:2], np.int64)
                for i in range(CHUNK):
                    if i != out:
                        packed = packed << 8 | symbols[:, :, i]
                keys[:, :, out] = packed << 8 | (np.arange(CHUNKS) * CHUNK + out)
            bounds = pa.array(np.arange(len(longs) + 1, dtype=np.int32) * SYMBOLS)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(bounds, pa.array(keys.ravel()))], ["node", "keys"])

    return classes.select("node", *_signature()).mapInArrow(rows, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _different(a: str, b: str) -> Column:
    """In how many symbols two signatures differ."""
    out = F.lit(0)
    for s in _signature():
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        out = out + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return out


def _close(a: str, b: str, percent: int) -> Column:
    """Pairs that may have ``percent`` of their shingles in common, by size and signature."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * n >= percent * m) & (100 * m >= percent * n) & (_different(a, b) <= MOST_DIFFERENT)


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted nodes; their texts are read once more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling()
        for batch, data, offsets in C.slices(batches, "text"):
            hashes, at = _hashed(data, offsets, size, rolling)
            held = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), held], ["node", "shingles"])

    wanted = wanted.select(F.col("node").alias("n")).distinct().join(classes.select("node", "id", "hash"), F.col("n") == F.col("node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"), "text")
    texts = wanted.join(texts, (F.col("id") == F.col("i")) & (F.col("hash") == F.col("h"))).select("node", "text")
    return stored(texts.mapInArrow(rows, "node long, shingles array<long>").dropDuplicates(["node"]), "near-sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are as alike as asked."""
    both_sides = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct())
    found = _sets(both_sides, classes, docs, size)
    left, right = found.select(F.col("node").alias("a"), F.col("shingles").alias("x")), found.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    checked = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return checked.filter(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups of rows that are sorted by ``keys``, and where each group starts and the last one ends."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return batch, np.append(np.flatnonzero(new), batch.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole, bounds = joined()
        if len(bounds) > 2:
            yield whole.slice(0, bounds[-2]), bounds[:-1]
        held = [whole.slice(bounds[-2])]
    if held:
        yield joined()


def _meetings(apart: DataFrame, percent: int) -> DataFrame:
    """(node, other, nearest, different, least, most): which components a node meets, and which of their members.

    Rows of a key are dealt into blocks, and members outside the largest component are compared with each block by
    signature. Pairs that are close are not written out: of a node and a component there is one row per block, with the
    nearest member and the smallest and largest one. A pair is looked at under the first key that it shares only.
    """
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    members = apart.select("*", every.alias("i"), own.alias("j"), F.lit(0).alias("side"))
    outside = apart.filter("component <> largest").select("*", own.alias("i"), every.alias("j"), F.lit(1).alias("side"))
    columns = ["key", "i", "j", "side", "node", "component", "largest", "n_shingles", *_signature()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _groups(batches, ["key", "i", "j"]):
            v = {c: batch.column(c).to_numpy() for c in columns[:8]}
            symbols = np.stack([batch.column(c).to_numpy() for c in _signature()], 1).view(np.uint8)[:, :SYMBOLS]
            found = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                split = a + int(np.searchsorted(v["side"][a:b], 1))
                for o in range(split, b, 32):
                    x, y = np.arange(o, min(o + 32, b)), np.arange(a, split)
                    unlike = symbols[x][:, None] != symbols[y][None]
                    total = unlike.sum(2)
                    n, m = v["n_shingles"][x][:, None], v["n_shingles"][y][None]
                    ok = (total <= MOST_DIFFERENT) & (100 * n >= percent * m) & (100 * m >= percent * n)
                    ok &= v["component"][x][:, None] != v["component"][y][None]
                    ok &= (v["component"][y] == v["largest"][y])[None] | (v["node"][x][:, None] < v["node"][y][None])
                    p, q = np.nonzero(ok)
                    if len(p):
                        errors = unlike[p, q].reshape(-1, CHUNKS, CHUNK)
                        chunk = (errors.sum(2) <= 1).argmax(1)
                        first = chunk * CHUNK + errors[np.arange(len(p)), chunk].argmax(1)
                        p, q = p[first == v["key"][a] & 255], q[first == v["key"][a] & 255]
                        found.append((x[p], y[q], total[p, q]))
            if not found:
                continue
            x, y, different = (np.concatenate(z) for z in zip(*found))
            node, other, near = v["node"][x], v["component"][y], v["node"][y]
            order = np.lexsort((near, different, other, node))
            node, other, near, different = (z[order] for z in (node, other, near, different))
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
            at = np.flatnonzero(new)
            if len(at):
                out = [node[at], other[at], near[at], different[at].astype(np.int32), np.minimum.reduceat(near, at), np.maximum.reduceat(near, at)]
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in out], ["node", "other", "nearest", "different", "least", "most"])

    both = members.select(*columns).unionByName(outside.select(*columns))
    dealt = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    met = dealt.mapInArrow(rows, "node long, other long, nearest long, different int, least long, most long")
    nearest = F.min(F.struct("different", "nearest"))["nearest"].alias("nearest")
    return met.groupBy("node", "other").agg(nearest, F.min("least").alias("least"), F.max("most").alias("most"))


def _linked(open_: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes with any member of a component, for (node, other) of which the nearest member was none.

    Whole sets are compared, block by block of members and of nodes; of a node and a block one link is enough.
    """
    sized = open_.groupBy("other").agg(F.count("*").alias("nodes")).join(
        members.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("size")), F.col("other") == F.col("c")
    )
    sized = sized.select("c", F.ceil(F.col("nodes") / SET_BLOCK).cast("int").alias("is"), F.ceil(F.col("size") / SET_BLOCK).cast("int").alias("js"))
    sized = stored(sized, "near-sizes")
    held = members.join(sized, F.col("component") == F.col("c"))
    held = held.select("c", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("js")).cast("int").alias("j"), F.lit(0).alias("side"), "node")
    asked = open_.join(sized, F.col("other") == F.col("c"))
    asked = asked.select("c", F.pmod(F.xxhash64("node"), F.col("is")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), F.lit(1).alias("side"), "node")
    both = stored(held.unionByName(asked), "near-asked")
    sets = _sets(both.select("node"), classes, docs, size).withColumnRenamed("node", "n")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _groups(batches, ["c", "i", "j"]):
            side, node = batch.column("side").to_numpy(), batch.column("node").to_numpy()
            lists = batch.column("shingles")
            values = lists.flatten().to_numpy().view(np.uint64)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                split = a + int(np.searchsorted(side[a:b], 1))
                own, of = values[at[a] : at[split]], np.repeat(np.arange(split - a), np.diff(at[a : split + 1]))
                order = np.argsort(own, kind="stable")
                own, of = own[order], of[order]
                n = np.diff(at[a : split + 1])
                for x in range(split, b):
                    mine = values[at[x] : at[x + 1]]
                    low, high = np.searchsorted(own, mine), np.searchsorted(own, mine, side="right")
                    hits = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
                    both_ = np.bincount(of[hits], minlength=split - a)
                    ok = np.flatnonzero(100 * both_ >= percent * (n + len(mine) - both_))
                    if len(ok):
                        found.append((node[x], node[a + ok[0]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    dealt = both.join(sets, F.col("node") == F.col("n")).select("c", "i", "j", "side", "node", "shingles")
    return dealt.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "side").mapInArrow(rows, "a long, b long")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b) of nodes; only components that these links join are looked at again."""
    a, b = (labels.select(F.col("node").alias(f"{x}n"), F.col("component").alias(f"{x}c")) for x in "ab")
    between = links.join(a, F.col("a") == F.col("an")).join(b, F.col("b") == F.col("bn")).filter("ac <> bc")
    moved = components(between.select(F.col("ac").alias("a"), F.col("bc").alias("b"))).select(F.col("node").alias("was"), F.col("component").alias("now"))
    found = labels.join(moved, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    return stored(found, "near-joined")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id, component_id, component for every row; the last three null for rows that are linked with nothing."""
    named = ["n_shingles", "name_a", "name_b"]
    signed = stored(signatures(docs, size).withColumn("node", F.xxhash64(*named)), "near-signatures")
    usable = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    first = F.min(F.struct("doc_id", "text_hash", "n_shingles", *_signature())).alias("first")
    classes = usable.groupBy("node").agg(first)
    classes = classes.select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"), "first.n_shingles", *[f"first.{s}" for s in _signature()])
    classes = stored(classes, "near-classes")
    side = classes.select(F.col("node").alias("n"), "n_shingles", *_signature())

    # Each class with the busiest one that it meets under each key.
    keys = _keys(classes)
    busy = keys.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1").withColumnRenamed("key", "k")
    members = stored(keys.join(busy, F.col("key") == F.col("k")).select("node", "key", "met"), "near-members")
    weight = members.groupBy("node").agg(F.sum("met").alias("weight")).withColumnRenamed("node", "n")
    hubs = members.join(weight, F.col("node") == F.col("n")).groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    hubs = hubs.select(F.col("key").alias("k"), F.col("hub.node").alias("hub"))
    pairs = members.join(hubs, F.col("key") == F.col("k")).filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = pairs.join(side.alias("x"), F.col("a") == F.col("x.n")).join(side.alias("y"), F.col("b") == F.col("y.n"))
    pairs = stored(pairs.filter(_close("x", "y", percent)).select("a", "b"), "near-pairs")
    links = stored(_confirmed(pairs, classes, docs, size, percent), "near-links")

    # What is still apart under a key: those outside the largest component there, with all others.
    joined = components(links).withColumnRenamed("node", "n")
    joined = stored(classes.select("node").join(joined, F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("component")), "near-joined")
    placed = stored(members.select("node", "key").join(joined, "node"), "near-placed")
    parts = placed.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("most"), F.sum("count").alias("rows"), F.count("*").alias("parts"))
    parts = parts.filter("parts > 1").select(F.col("key").alias("k"), F.col("most.component").alias("largest"), "rows")
    apart = placed.join(parts, F.col("key") == F.col("k")).join(side, F.col("node") == F.col("n")).drop("k", "n")
    met = stored(_meetings(apart, percent), "near-met")
    if not met.isEmpty():
        nearest = met.select(F.col("node").alias("a"), F.col("nearest").alias("b"))
        more = stored(_confirmed(nearest, classes, docs, size, percent), "near-links")
        labels = _relabelled(joined, more)
        # A node that its nearest member doesn't link is compared with all of the component, unless others have joined them.
        now = labels.select(F.col("node").alias("n"), F.col("component").alias("now"))
        open_ = met.filter("least <> most").join(now, F.col("node") == F.col("n")).drop("n")
        there = labels.select(F.col("node").alias("n"), F.col("component").alias("there"))
        open_ = stored(open_.join(there, F.col("nearest") == F.col("n")).filter("now <> there").select("node", "other"), "near-open")
        joined = labels if open_.isEmpty() else _relabelled(labels, stored(_linked(open_, joined, classes, docs, size, percent), "near-links"))
    joined = joined.withColumnRenamed("node", "n")

    classes = classes.join(joined, F.col("node") == F.col("n"), "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    classes = stored(classes, "near-components")
    least = classes.groupBy("component").agg(F.min("id").alias("component_id")).withColumnRenamed("component", "c")
    classes = classes.join(least, F.col("component") == F.col("c")).select(F.col("node").alias("n"), F.col("id").alias("class_id"), "component_id", "component")
    out = signed.join(classes, (F.col("node") == F.col("n")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "text_hash", "n_shingles", "class_id", "component_id", "component")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id, component_id, kept for every row.

    Words are lower-cased for A-Z; a set has the distinct runs of ``size`` words, or the whole sequence if it is shorter.
    Rows whose sets have at least ``percent`` of their union in common are linked; ``component_id`` is the smallest
    doc_id that a row reaches, and it is kept if that is its own. ``class_id`` is the smallest doc_id with the same set. A
    row without words, with a null text or a null doc_id is linked with nothing and kept. Rows that repeat are alike; of
    different texts under one doc_id each has its own links. An empty table gives an empty table.
    """
    out = _grouped(docs, size, percent)
    component = F.coalesce("component_id", "doc_id")
    kept = component.eqNullSafe(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each component left, in the columns they came with.

    The row that stays has the smallest doc_id, then the smallest hash of its text, then the smallest other columns; of rows
    that repeat one stays. Rows with a null doc_id are compared like others and come last. Rows without words all stay.
    """
    # A null id counts as the largest; rows of one id are told apart by their texts.
    id_, hash_ = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("text")
    found = _grouped(docs.select(id_.alias("doc_id"), "text"), size, percent).filter("component is not null")
    texts = stored(found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows")), "near-texts")
    first = texts.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).withColumnRenamed("component", "c")
    one = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    texts = texts.join(first, F.col("component") == F.col("c")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "rows", one.alias("stays"))
    same = (id_ == F.col("__id")) & (hash_ == F.col("__hash"))
    alone = docs.join(texts.filter("not stays or rows > 1"), same, "left_anti")
    repeated = docs.join(texts.filter("stays and rows > 1").select("__id", "__hash"), same)
    repeated = repeated.groupBy("__id", "__hash").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
    return alone.unionByName(repeated)
