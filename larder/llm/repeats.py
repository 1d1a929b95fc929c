"""Remove passages that are found more than once in a corpus, to the byte.

A passage of ``length`` bytes that starts at two places is removed at both. Ranking every byte position in Spark would
shuffle many times the input, so positions are ranked through anchors: of the windows that a passage holds, the one with
the smallest hash, which is the same one in every copy. Neighbouring starts with one anchor are a run, and runs are
ranked in rounds by strings that grow, as in prefix doubling: first by the window at the anchor, then by what 16
neighbouring starts have in common, then by the passage itself. A rank is the pair of where the string lies about its
anchor and its hash; Spark groups equal pairs. A run leaves when its string is unique, or when its whole reach, the bytes
from its first start to the end of its last passage, is found twice, so that every start in it is settled. Copies with
one reach go on as one, only to be met by others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import columns as C
from larder.llm.store import stored

LENGTH = 400
#: Starts of one block of the second round.
BLOCK = 16
#: Bits of a position beside the hash that anchors are chosen by; longer texts are worked on in parts.
POSITION_BITS = 26


def _window(length: int) -> tuple[int, int]:
    """How many starts can share an anchor (a power of two), and the bytes of the window that is hashed."""
    starts = 1 << max(0, (5 * length // 8).bit_length() - 1)
    if 2 * starts <= 3 * length // 4:
        starts *= 2
    return starts, length - starts + 1


def runs(data: np.ndarray, offsets: np.ndarray, rolling: C.Rolling, length: int) -> dict[str, np.ndarray]:
    """All runs of starts of the rows of a slice: row, anchor, first and last start (in the slice), core and reach hashes."""
    starts, window = _window(length)
    none = {k: np.zeros(0, np.int64) for k in ("row", "anchor", "first", "last")} | {k: np.zeros(0, np.uint64) for k in ("core", "reach")}
    if len(data) < length:
        return none
    sums = rolling.sums(data)
    hashes = C.mix(rolling.windows(sums, window))
    low = np.uint64((1 << POSITION_BITS) - 1)
    parts, step = [], (1 << POSITION_BITS) - starts
    for from_ in range(0, len(data) - length + 1, step):
        part = hashes[from_ : from_ + step + starts - 1]
        best = part & ~low | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width < starts:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        parts.append((best & low).astype(np.int64) + from_)
    anchor = np.concatenate(parts)
    rows = len(offsets) - 1
    # Starts from which a whole passage lies in the row.
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    at = np.repeat(offsets[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    if not len(at):
        return none
    row, anchor = np.repeat(np.arange(rows), size), anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    last = at[np.append(begin[1:], len(at)) - 1]
    first, anchor, row = at[begin], anchor[begin], row[begin]
    place = ((anchor - last) << 32 | (anchor - first)).astype(np.uint64)
    return {
        "row": row, "anchor": anchor, "first": first, "last": last,
        "core": rolling.between(sums, anchor, anchor + window), "reach": C.pair(place, rolling.between(sums, first, last + length)),
    }


def _rolling() -> C.Rolling:
    return C.Rolling(C.byte_table(5))


def _keyed(docs: DataFrame) -> DataFrame:
    """With ``__key``: equal for rows that agree in doc_id and text, whose every passage is found twice."""
    return docs.withColumn("__key", F.xxhash64(F.lit(3), "doc_id", "text"))


def _all_runs(texts: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling()
        for batch, data, offsets in C.slices(batches, "text"):
            r = runs(data, offsets, rolling, length)
            key = batch.column("key").to_numpy()[r["row"]]
            at = (r["anchor"] - offsets[r["row"]]).astype(np.int32)
            out = [pa.array(key), pa.array(at), pa.array(r["core"].view(np.int64)), pa.array(r["reach"].view(np.int64))]
            yield pa.RecordBatch.from_arrays(out, ["key", "anchor", "core", "reach"])

    return texts.mapInArrow(rows, "key long, anchor int, core long, reach long")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """The bytes that the wanted runs of each text reach: key, anchor, settled, before (bytes up to the anchor), starts, reach."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling()
        for batch, data, offsets in C.slices(batches, "text"):
            r = runs(data, offsets, rolling, length)
            wanted, bounds = _flat(batch.column("anchors"))
            settled, _ = _flat(batch.column("settled"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            i = np.searchsorted(r["row"] << 40 | (r["anchor"] - offsets[r["row"]]), row << 40 | wanted)
            first, last = r["first"][i], r["last"][i]
            raw = data.tobytes()
            out = [
                pa.array(batch.column("key").to_numpy()[row]), pa.array(wanted.astype(np.int32)), pa.array(settled.astype(bool)),
                pa.array((r["anchor"][i] - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                pa.array([raw[a:b] for a, b in zip(first.tolist(), (last + length).tolist())], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(out, ["key", "anchor", "settled", "before", "starts", "bytes"])

    return texts.mapInArrow(rows, "key long, anchor int, settled boolean, before int, starts int, bytes binary")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _strings(contexts: DataFrame, length: int, size: int, larger: int = 0) -> DataFrame:
    """One row for each block of ``size`` starts of a run: what all its passages share, and its reach if the run has all of it.

    Blocks are numbered by how far their starts lie before the anchor. With ``larger``, the column ``blocks`` says which
    blocks of that size are asked for, and ``block_settled`` whether each is settled; else all are, and as settled as their run.
    """
    some = larger > 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling()
        for batch, data, offsets in C.slices(batches, "bytes"):
            before, starts = (batch.column(c).to_numpy().astype(np.int64) for c in ("before", "starts"))
            if some:
                block, bounds = _flat(batch.column("blocks"))
                settled, _ = _flat(batch.column("block_settled"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                parts = larger // size
                row, block, settled = (np.repeat(x, parts) for x in (row, block, settled))
                block = block * parts + np.tile(np.arange(parts), len(row) // parts)
            else:
                low, high = (before - starts + 1) // size, before // size
                row = np.repeat(np.arange(batch.num_rows), high - low + 1)
                block = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - high - 1, high - low + 1)
                settled = batch.column("settled").to_numpy(zero_copy_only=False)[row]
            near, far = block * size, block * size + size - 1
            met = (near <= before[row]) & (far > before[row] - starts[row])
            row, block, settled, near, far = (x[met] for x in (row, block, settled, near, far))
            whole = (far <= before[row]) & (near > before[row] - starts[row])
            sums = rolling.sums(data)
            anchor = offsets[row] + before[row]
            core = rolling.between(sums, anchor - near, anchor - far + length)
            first = np.where(whole, anchor - far, anchor - near)
            reach = rolling.between(sums, first, np.where(whole, anchor - near + length, first))
            out = [
                batch.column("key").take(pa.array(row)), batch.column("anchor").take(pa.array(row)), pa.array(settled.astype(bool)), pa.array(block.astype(np.int32)),
                pa.array(C.pair(block.astype(np.uint64), core).view(np.int64)), pa.array(C.pair(block.astype(np.uint64), reach).view(np.int64), mask=~whole),
            ]
            yield pa.RecordBatch.from_arrays(out, ["key", "anchor", "settled", "block", "core", "reach"])

    wanted = ["key", "anchor", "before", "starts", "bytes", *(["blocks", "block_settled"] if some else ["settled"])]
    return contexts.select(*wanted).mapInArrow(rows, "key long, anchor int, settled boolean, block int, core long, reach long")


def _ranked(strings: DataFrame) -> DataFrame:
    """One row for each reach under each core: how many rows have it, one of them, and whether it is settled."""
    own = F.coalesce("reach", F.xxhash64("key", "anchor", "block"))
    groups = strings.groupBy("core", own.alias("reach")).agg(
        F.count("*").alias("n"), F.min(F.struct("key", "anchor", "block")).alias("one"), F.max("settled").alias("settled")
    )
    return groups.select("core", "reach", (F.col("settled") | (F.col("n") > 1)).alias("settled"), "one.*")


def _open(ranked: DataFrame) -> DataFrame:
    """The rows of cores that several reaches share, not all of them settled."""
    cores = ranked.groupBy("core").agg(F.count("*").alias("reaches"), F.min("settled").alias("all"))
    cores = cores.filter("reaches > 1 and not all").select(F.col("core").alias("c"))
    return ranked.join(cores, F.col("core") == F.col("c")).drop("c")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each text what tells its repeated starts: (key, unique, found).

    ``unique`` are the anchors of runs whose reach is found once; all other runs are repeated as a whole. ``found`` are
    ranges (first, last) of further repeated starts. Texts without either have no row.
    """
    texts = _keyed(docs).select(F.col("__key").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ranked = stored(_ranked(_all_runs(texts, length).withColumns({"settled": F.lit(False), "block": F.lit(0)})), "repeat-runs")
    unique = ranked.filter("not settled").groupBy("key").agg(F.collect_list("anchor").alias("unique"))

    left = _open(ranked).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("anchor", "settled"))).alias("x"))
    left = left.select(F.col("key").alias("k"), F.col("x.anchor").alias("anchors"), F.col("x.settled").alias("settled"))
    contexts = stored(_contexts(texts.join(left, F.col("key") == F.col("k")).drop("k"), length).dropDuplicates(["key", "anchor"]), "repeat-contexts")

    size = min(BLOCK, _window(length)[0])
    strings = stored(_strings(contexts, length, size), "repeat-blocks")
    ranked = stored(_ranked(strings), "repeat-block-ranks")
    whole = ranked.filter("settled").select(F.col("core").alias("c"), F.col("reach").alias("r"))
    whole = strings.filter("not settled and reach is not null").join(whole, (F.col("core") == F.col("c")) & (F.col("reach") == F.col("r")))
    by_block = whole.select("key", (F.col("anchor") - F.col("block") * size - (size - 1)).alias("first"), (F.col("anchor") - F.col("block") * size).alias("last"))

    blocks = _open(ranked).groupBy("key", "anchor").agg(F.array_sort(F.collect_list(F.struct("block", "settled"))).alias("x"))
    blocks = blocks.select(F.col("key").alias("k"), F.col("anchor").alias("a"), F.col("x.block").alias("blocks"), F.col("x.settled").alias("block_settled"))
    inside = contexts.join(blocks, (F.col("key") == F.col("k")) & (F.col("anchor") == F.col("a"))).drop("k", "a")
    strings = stored(_strings(inside, length, 1, size), "repeat-starts")
    twice = strings.groupBy("core").count().filter("count > 1").select(F.col("core").alias("c"))
    start = F.col("anchor") - F.col("block")
    by_start = strings.filter("not settled").join(twice, F.col("core") == F.col("c")).select("key", start.alias("first"), start.alias("last"))

    found = by_block.unionByName(by_start).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    both = unique.join(found.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    return both.select("key", "unique", "found.first", "found.last")


def removed_spans(data: np.ndarray, offsets: np.ndarray, unique: pa.ListArray, first: pa.ListArray, last: pa.ListArray, rolling: C.Rolling, length: int) -> np.ndarray:
    """Which bytes of a slice lie in a repeated passage."""
    r = runs(data, offsets, rolling, length)
    anchors, bounds = _flat(unique)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    alone = np.isin(r["row"] << 40 | (r["anchor"] - offsets[r["row"]]), row << 40 | anchors)
    begin, bounds = _flat(first)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    begin, end = begin + offsets[row], _flat(last)[0] + offsets[row] + length
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, r["first"][~alone], 1)
    np.add.at(step, r["last"][~alone] + length, -1)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """The rows with what :func:`repeated` says of them; the texts are shuffled once."""
    told = stored(repeated(docs, length), "repeats").select(F.col("key").alias("__k"), F.col("unique").alias("__unique"), F.col("first").alias("__first"), F.col("last").alias("__last"))
    rows = _keyed(docs).join(told, F.col("__key") == F.col("__k"), "left").drop("__k", "__key")
    none = F.array().cast("array<int>")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("__unique", "__first", "__last")})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row.

    Texts are UTF-8 bytes, a null one has none. A byte is removed if a string of ``length`` bytes that covers it starts
    anywhere else too, in the same text or another; overlapping strings count, strings across texts don't, and all are
    judged on the texts as they came. Of repeated rows with texts that long nothing is left. An empty table gives an empty table.
    """
    if length < 2:
        raise ValueError("a passage must have 2 bytes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling()
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch, data, offsets in C.slices(batches, "text"):
            gone = removed_spans(data, offsets, *(batch.column(c) for c in ("__unique", "__first", "__last")), rolling, length)
            kept, spans = _kept(data, offsets, gone)
            out = [
                batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(C.run_sums(gone, offsets)), pa.array(spans),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    spanned = _with_spans(docs.select("doc_id", "text"), length)
    return spanned.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _kept(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The bytes that are left of each row, and how many runs of bytes are removed."""
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    raw = data[~gone].tobytes()
    _, _, first = C.runs(gone, offsets)
    return [raw[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())], np.diff(first)


def long_runs(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, words: int) -> np.ndarray:
    """The bytes of ``gone`` that lie in a run with at least so many whole words."""
    first, last, _ = C.runs(gone, offsets)
    starts, ends, _ = C.words(data, offsets)
    inside = np.searchsorted(ends, last, side="right") - np.searchsorted(starts, first)
    step = np.zeros(len(data) + 1, np.int64)
    step[first[inside >= words]] = 1
    np.add.at(step, last[inside >= words], -1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """The documents in the columns they came with, their texts without repeated passages; parts of a character go with its rest.

    A passage is a run of bytes that strings of ``length`` bytes found twice cover, with ``words`` whole words at least.
    ``n_chars`` follows the text. A null text stays null; a text of which nothing is left is empty.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling()
        for batch, data, offsets in C.slices(batches, "text"):
            gone = removed_spans(data, offsets, *(batch.column(c) for c in ("__unique", "__first", "__last")), rolling, length)
            if words:
                gone = long_runs(data, offsets, gone, words)
            kept, _ = _kept(data, offsets, gone)
            texts = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string(), mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names)

    names = docs.columns
    out = _with_spans(docs, length).mapInArrow(rows, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
