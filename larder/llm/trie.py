"""The tree of all conversation prefixes, with what each node shares.

A turn is known by a hash of 128 bits of its role and text; a conversation is the list of its turns' hashes. Spark sorts
conversations by these lists into ranges, and a task cuts its range into shards of a few thousand conversations. In a
shard every (position, turn) has a bitset of the conversations that have it. From the root down, a node's bitset is
intersected with the postings of the next position: the results are its children, their popcounts are their members, and the
members without a further turn are its end list.

As conversations are sorted, the members of a node follow each other. Only prefixes of a shard's first and last conversation
can go on in the next shard; they stay open. Open nodes of neighbouring shards are merged, of neighbouring tasks then
64 at a time, until nothing is open. A merge holds what prefixes 65 conversations have, whatever lies between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.store import stored

#: Conversations and turns of one shard (a longer conversation is a shard of its own), and shards or tasks of one merge.
SHARD, SHARD_TURNS, FAN = 4096, 1 << 17, 64
#: Ids that are written into one piece of an end list.
PIECE = 10_000
EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = (
    "kind string, path string, parent string, parent_conv_id long, conv_id long, depth long, bytes long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, first boolean, last boolean, unit long, nth long"
)
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns (a, b, bytes) for each conv_id: its turns in order, a null turn first, ties by their hashes.

    A null role or text is empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashes = [F.xxhash64(F.lit(k), role, text).alias(n) for k, n in ((1, "a"), (2, "b"))]
    # False sorts before true: a null turn comes first.
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn"), *hashes, F.octet_length(text).cast("long").alias("bytes"))
    rows = turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["bytes"].alias("bytes"))).alias("turns"))


def prefix_length(conv_id: Column, modulus: int = 9) -> Column:
    return (F.crc32(conv_id.cast("string")) % modulus).cast("int")


def rebuilt(sequences_: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """The same with the first h turns of each conversation taken from the first one of its family; h is a hash of its id."""
    sequences_ = stored(sequences_, "trie-turns")
    head, base, h = F.slice("turns", 1, modulus - 1), F.col("conv_id") - F.col("conv_id") % family, prefix_length(F.col("conv_id"), modulus)
    heads = sequences_.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), head.alias("head"))
    none = F.filter("turns", lambda t: F.lit(False))
    both = sequences_.withColumn("__base", base).join(heads, F.col("__base") == F.col("base"), "left")
    start = F.when(h > 0, F.slice(F.coalesce("head", none), 1, F.greatest(h, F.lit(1)))).otherwise(none)
    rest = F.filter("turns", lambda t, i: i >= h)
    return both.select("conv_id", F.concat(start, rest).alias("turns"))


class _Shard:
    """Nodes of the conversations of one shard, in lists by node number; the root is number 0."""

    def __init__(self, rows: list[tuple[int, list[tuple[int, int]], list[int]]]):
        by_id = sorted(range(len(rows)), key=lambda i: rows[i][0])
        self.ids = [rows[i][0] for i in by_id]
        self.turns = [rows[i][1] for i in by_id]
        self.sizes = [rows[i][2] for i in by_id]
        place = {i: bit for bit, i in enumerate(by_id)}
        self.first, self.last = place[0], place[len(rows) - 1]
        self.up: list[int] = []
        self.depth: list[int] = []
        self.least: list[int] = []
        self.members: list[int] = []
        self.children: list[int] = []
        self.ends: list[list[int]] = []
        self._grow()

    def _add(self, up: int, depth: int, least: int, members: int, ends: list[int]) -> int:
        self.up.append(up)
        self.depth.append(depth)
        self.least.append(least)
        self.members.append(members)
        self.children.append(0)
        self.ends.append(ends)
        if up >= 0:
            self.children[up] += 1
        return len(self.up) - 1

    def _grow(self) -> None:
        postings: dict[tuple[int, tuple[int, int]], int] = {}
        ending: dict[int, int] = {}
        for i, turns in enumerate(self.turns):
            bit = 1 << i
            ending[len(turns)] = ending.get(len(turns), 0) | bit
            for at in enumerate(turns):
                postings[at] = postings.get(at, 0) | bit
        todo = [((1 << len(self.ids)) - 1, 0, -1)]
        while todo:
            members, depth, up = todo.pop()
            least = (members & -members).bit_length() - 1
            n = members.bit_count()
            if n == 1:  # alone from here on
                end = len(self.turns[least])
                for d in range(depth, end + 1):
                    up = self._add(up, d, least, 1, [least] if d == end else [])
                continue
            ends = members & ending.get(depth, 0)
            node = self._add(up, depth, least, n, list(_bits(ends)))
            left = members ^ ends
            while left:
                i = (left & -left).bit_length() - 1
                child = left & postings[depth, self.turns[i][depth]]
                left ^= child
                todo.append((child, depth + 1, node))

    def bytes(self, node: int) -> int:
        return self.sizes[self.least[node]][self.depth[node] - 1] if self.depth[node] else 0


def _bits(x: int) -> Iterator[int]:
    while x:
        yield (x & -x).bit_length() - 1
        x &= x - 1


def _paths(turns: list[tuple[int, int]]) -> list[str]:
    """A name of each prefix, the root's first."""
    out, at = ["root"], b""
    for a, b in turns:
        at = hashlib.sha256(at + a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True)).digest()
        out.append(at[:16].hex())
    return out


def _row(kind: str, **values) -> dict:
    return dict.fromkeys(_COLUMNS) | {"kind": kind} | values


def _nodes(shard: _Shard) -> tuple[list[dict], list[dict], list[dict]]:
    """Done nodes, open nodes, and pieces of the end lists of open nodes."""
    n = len(shard.up)
    names: list[str | None] = [None] * n
    flags = {}
    for flag, conv in (("first", shard.first), ("last", shard.last)):
        flags[flag] = set(_paths(shard.turns[conv]))
    kids: dict[int, list[int]] = {}
    for i in range(1, n):
        kids.setdefault(shard.up[i], []).append(i)
    for conv in (shard.first, shard.last):
        node = 0
        for depth, path in enumerate(_paths(shard.turns[conv])):
            if depth:
                turn = shard.turns[conv][depth - 1]
                node = next(k for k in kids[node] if shard.turns[shard.least[k]][depth - 1] == turn)
            names[node] = path
    leaves, saved, closed = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # children come after their parent
        if names[i] is None:
            if not shard.children[i]:
                leaves[i] = 1
            saved[i] += (shard.members[i] - 1) * shard.bytes(i)
            up = shard.up[i]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            closed[up] += 1
    done, opened, pieces = [], [], []
    for i in range(n):
        ids = [shard.ids[k] for k in shard.ends[i]]
        up = shard.up[i]
        own = {"conv_id": shard.ids[shard.least[i]], "depth": shard.depth[i], "bytes": shard.bytes(i), "n_convs": shard.members[i], "n_leaves": leaves[i], "saved_tokens": saved[i]}
        if names[i] is None:
            above = {"parent_conv_id": shard.ids[shard.least[up]]} if names[up] is None else {"parent": names[up]}
            done.append(_row("done", n_children=shard.children[i], ends=_digest(ids), **above, **own))
            continue
        opened.append(_row("open", path=names[i], parent=names[up] if i else None, n_children=closed[i], first=names[i] in flags["first"], last=names[i] in flags["last"], **own))
        for k in range(0, len(ids), PIECE):
            pieces.append(_row("ends", path=names[i], ends=",".join(map(str, ids[k : k + PIECE]))))
    return done, opened, pieces


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else EMPTY


def _merged(groups: list[list[dict]], whole: bool = False) -> tuple[list[dict], list[dict]]:
    """Nodes that are closed by merging neighbouring groups of open nodes, and those that stay open.

    What lies on the path of the first group's first conversation or the last one's last stays open, unless the groups are
    the ``whole`` table.
    """
    groups = [g for g in groups if g]
    nodes: dict[str, dict] = {}
    for k, group in enumerate(groups):
        for r in group:
            first, last = k == 0 and r["first"], k == len(groups) - 1 and r["last"]
            if r["path"] not in nodes:
                nodes[r["path"]] = r | {"first": first, "last": last}
                continue
            x = nodes[r["path"]]
            x["conv_id"] = min(x["conv_id"], r["conv_id"])
            x["first"], x["last"] = x["first"] or first, x["last"] or last
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                x[c] += r[c]
    closed = []
    for x in sorted(nodes.values(), key=lambda x: -x["depth"]):
        if not whole and (x["first"] or x["last"]):
            continue
        if not x["n_children"]:
            x["n_leaves"] = 1
        x["saved_tokens"] += (x["n_convs"] - 1) * x["bytes"]
        up = nodes.get(x["parent"])
        if up is not None:
            up["n_children"] += 1
            up["n_leaves"] += x["n_leaves"]
            up["saved_tokens"] += x["saved_tokens"]
        closed.append(x | {"kind": "closed"})
    return closed, [x for x in nodes.values() if not whole and (x["first"] or x["last"])]


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int, list[tuple[int, int]], list[int]]]]:
    rows, turns = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            sequence = batch.column("turns")[i].as_py()
            if rows and (len(rows) == SHARD or turns + len(sequence) > SHARD_TURNS):
                yield rows
                rows, turns = [], 0
            rows.append((batch.column("conv_id")[i].as_py(), [(t["a"], t["b"]) for t in sequence], [t["bytes"] for t in sequence]))
            turns += len(sequence)
    if rows:
        yield rows


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _NODE.split(", ")])


def _by_range(ordered: DataFrame) -> DataFrame:
    """Nodes of each task's range: done ones, open ones of the whole range, and pieces of end lists."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nth, schema = TaskContext.get().partitionId(), 0, _arrow_schema()
        waiting: list[list[dict]] = []
        for shard in _shards(batches):
            done, opened, pieces = _nodes(_Shard(shard))
            for piece in pieces:
                piece["nth"], nth = nth, nth + 1
            waiting.append(opened)
            out = done + pieces
            if len(waiting) == FAN:
                closed, opened = _merged(waiting)
                waiting, out = [opened], out + closed
            yield _batch([r | {"unit": unit} for r in out], schema)
        closed, opened = _merged(waiting)
        yield _batch([r | {"unit": unit} for r in closed + opened], schema)

    return ordered.mapInArrow(rows, _NODE)


def _merge_round(opened: DataFrame, whole: bool) -> DataFrame:
    """Open nodes of each 64 neighbouring units as those of one unit, and what that closes."""

    def merge(table: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, list[dict]] = {}
        for r in table.astype(object).where(table.notna(), None).to_dict("records"):
            groups.setdefault(int(r["unit"]), []).append(r)
        closed, still = _merged([groups[u] for u in sorted(groups)], whole)
        unit = min(groups) // FAN
        return pd.DataFrame([r | {"unit": unit} for r in closed + still], columns=_COLUMNS)

    return opened.groupBy(F.floor(F.col("unit") / FAN)).applyInPandas(merge, _NODE)


def _end_digests(pieces: DataFrame) -> DataFrame:
    """(path, ends): the digest of each open node's end list, read piece by piece in the order of ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for path, ids in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist()):
                if path != at:
                    if at is not None:
                        out.append((at, digest.hexdigest()))
                    at, digest = path, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["path", "ends"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], ["path", "ends"])

    return pieces.repartition("path").sortWithinPartitions("path", "unit", "nth").select("path", "ends").mapInArrow(rows, "path string, ends string")


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every distinct prefix.

    ``conversations`` has conv_id and turns (a, b, bytes), as :func:`sequences` gives them, one row per conv_id. A node's
    conv_id is its smallest member, with its depth it is a key; the root has depth 0 and no parent. A conversation without turns
    ends at the root. ``saved_tokens`` sums, over the node and all below it, the bytes of the last text times the members
    but one. ``ends_sha256`` is the digest of the ids that end at the node, ascending, joined by commas; one task reads
    such a list, piece by piece. A conversation's hashes are one row. An empty table gives an empty table.
    """
    spark = conversations.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.transform("turns", lambda t: F.struct(t["a"], t["b"]))
    ordered = conversations.select("conv_id", "turns").withColumn("__key", key)
    # Equal conversations are dealt out by their ids, so that copies fill several ranges.
    ordered = ordered.repartitionByRange(ranges, "__key", "conv_id").sortWithinPartitions("__key", "conv_id").drop("__key")
    found = stored(_by_range(ordered), "trie-nodes")
    opened = found.filter("kind = 'open'")
    units = opened.agg(F.max("unit")).first()[0]
    closed = [found.filter("kind = 'closed'").drop("unit")]
    while units is not None:
        merged = stored(_merge_round(opened, units < FAN), "trie-merged")
        closed.append(merged.filter("kind = 'closed'").drop("unit"))
        opened, units = merged.filter("kind = 'open'"), units // FAN if units >= FAN else None
    inner = closed[0]
    for more in closed[1:]:
        inner = inner.unionByName(more)
    inner = inner.select("path", "parent", *_OUT[:2], *_OUT[3:-1])
    digests = _end_digests(found.filter("kind = 'ends'")).select(F.col("path").alias("at"), F.col("ends").alias("ends_sha256"))
    inner = stored(inner.join(digests, F.col("path") == F.col("at"), "left").drop("at").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie-inner")
    # Children in a range look their parent up among the open nodes of that range, so that the root is no hot key.
    names = inner.select(F.col("path").alias("above"), F.col("conv_id").alias("name"))
    local = found.filter("kind in ('open', 'closed')").select("unit", "path").distinct().join(names, F.col("path") == F.col("above"))
    local = local.select(F.col("unit").alias("u"), "above", "name")
    done = found.filter("kind = 'done'").withColumnRenamed("ends", "ends_sha256")
    hanging = done.filter("parent is not null").join(local, (F.col("unit") == F.col("u")) & (F.col("parent") == F.col("above")))
    inner = inner.join(names, F.col("parent") == F.col("above"), "left")
    parts = [done.filter("parent is null"), hanging.withColumn("parent_conv_id", F.col("name")), inner.withColumn("parent_conv_id", F.col("name"))]
    out = [p.select(*_OUT) for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_prefixes(conversations: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """The tree of a table (conv_id, turn, role, text), each conversation rebuilt on the start of its family's first one."""
    return prefix_tree(rebuilt(sequences(conversations), family, modulus))
