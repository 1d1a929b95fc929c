"""How far the sources of a language differ in the terms that they use, and in which terms.

Terms are counted in slices of text with numpy alone. A term of at most 8 bytes is one 64-bit word, one of at most 16 bytes
two; these are sorted by radix, 16 bits at a time, then by (lang, source), and runs are counted. Longer terms go into buckets by the
power of two that holds them, and each bucket is sorted as bytes. Spark adds up the counts of slices.

A value of a pair is a sum over all kept terms, but a source lacks most of them. So it is taken from three sparse sums:
of the terms that the first source has, as if the other had none; of those that the other has, as if the first had none; and
a correction for terms that both have. Terms are dealt into blocks, so that neither a language nor a term is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import columns as C
from larder.llm.store import stored

SCALE = 1_000_000_000
#: Counts of one block, pairs of counts and rows of the result that are held at once.
BLOCK_COUNTS, HELD_PAIRS, HELD_SOURCES = 1 << 16, 1 << 20, 256
#: Text bytes whose terms are sorted together.
SORT_BYTES = 4 << 20
#: Terms of more bytes are compared as they are, without filling them up to the width of their bucket.
WIDE = 256

_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by unsigned integer keys, the first key first, found 16 bits at a time from the last."""
    order = None
    for key in reversed(keys):
        digits = key.astype(">u8").view(">u2").reshape(-1, 4)
        for k in (3, 2, 1, 0):
            digit = digits[:, k].astype(np.uint16)
            if not len(digit) or (digit == digit[0]).all():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")  # of 16 bits this is a radix sort
            order = step if order is None else order[step]
    return np.arange(len(keys[0])) if order is None else order


def _words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> list[np.ndarray]:
    """Terms of at most 8 n bytes as n big-endian words each, filled up with zeros, which no term has."""
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    keep = np.array([((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(9)], np.uint64)
    out = []
    for k in range(n):
        left = np.clip(lengths - 8 * k, 0, 8)
        at = np.minimum(starts + 8 * k, len(data) - 8)
        out.append(np.ascontiguousarray(eight[at]).view(">u8").ravel().astype(np.uint64) & keep[left])
    return out


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(group, count, term, docs) of each term of each group of rows; ``docs`` is how many rows of the group have the term."""
    data = _LOWER[data]
    starts, ends, first = C.runs(_TERM[data], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    found: list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]] = []

    def count(at: np.ndarray, order: np.ndarray, keys: list[np.ndarray], text: Callable[[np.ndarray], pa.Array]) -> None:
        """Count runs of equal ``keys`` among the terms ``at``, which ``order`` sorts; rows ascend in a run."""
        new = np.ones(len(at), bool)
        new[1:] = False
        for key in keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        rows = row[at[order]]
        other = new.copy()
        other[1:] |= rows[1:] != rows[:-1]
        begin = np.flatnonzero(new)
        total, stop = np.concatenate([[0], np.cumsum(other)]), np.append(begin[1:], len(at))
        one = at[order[begin]]
        found.append((group[row[one]], stop - begin, text(one), total[stop] - total[begin]))

    def gathered(at: np.ndarray) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(lengths[at])])
        raw = data[np.repeat(starts[at] - bounds[:-1], lengths[at]) + np.arange(bounds[-1])]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])

    for least, most, n in ((0, 8, 1), (8, 16, 2)):
        at = np.flatnonzero((lengths > least) & (lengths <= most))
        keys = [group[row[at]].astype(np.uint64), *_words(padded, starts[at], lengths[at], n)]
        count(at, radix_order(keys), keys, gathered)
    width = 32
    while len(lengths) and width // 2 < lengths.max():
        at = np.flatnonzero((lengths > width // 2) & (lengths <= width))
        if len(at):
            raw = [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            terms = np.array(raw, f"S{width}") if width <= WIDE else np.array([*raw, None], object)[:-1]
            by_term = np.argsort(terms, kind="stable")
            order = by_term[np.argsort(group[row[at]][by_term], kind="stable")]
            count(at, order, [terms, group[row[at]]], lambda one: pa.array([data[a:b].tobytes() for a, b in zip(starts[one].tolist(), ends[one].tolist())], pa.binary()).view(pa.string()))
        width *= 2
    of, times, terms, docs = zip(*found)
    return np.concatenate(of), np.concatenate(times), pa.concat_arrays(terms), np.concatenate(docs)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of all rows of (text, lang, source), and a row with a null term for each group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in C.slices(batches, "text", SORT_BYTES):
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            number: dict[tuple[str, str], int] = {}
            group = np.array([number.setdefault(x, len(number)) for x in names], np.int64)
            of, count, terms, docs_ = count_terms(data, offsets, group)
            lang, source = (pa.array([x[k] for x in number], pa.string()) for k in range(2))
            none = pa.array(np.zeros(len(number), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(number), pa.string()), none, none], columns)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(of)), source.take(pa.array(of)), terms, pa.array(count), pa.array(docs_)], columns)

    columns = ["lang", "source", "term", "count", "docs"]
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = texts.mapInArrow(rows, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a term in billionths, exact for any counts."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + 1)
    return F.call_function("div", above, total + terms) + 1


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pair_sums(counts: pd.DataFrame, heads: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Of one block of terms, the sums for all ordered pairs of the sources of ``heads`` (source, zero: its share of a term that it lacks).

    ``counts`` has (term, source, p) in any order.
    """
    heads = heads.sort_values("source", kind="stable")
    names, zero = heads["source"].to_numpy(), heads["zero"].to_numpy(np.int64)
    n = len(names)
    if len(counts):
        number = pd.Series(np.arange(n), index=names)
        source, p = number.loc[counts["source"]].to_numpy(), counts["p"].to_numpy(np.int64)
        term = pd.factorize(counts["term"])[0]
        terms = int(term.max()) + 1
    else:
        source, p, term, terms = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    # How many terms each source has at each share.
    order = np.lexsort((p, source))
    new = np.ones(len(order), bool)
    new[1:] = (p[order][1:] != p[order][:-1]) | (source[order][1:] != source[order][:-1])
    begin = np.flatnonzero(new)
    of, share, times = source[order][begin], p[order][begin], np.diff(np.append(begin, len(order)))
    by_source = np.searchsorted(of, np.arange(n + 1))
    lacking = terms - np.bincount(source, minlength=n)
    by_term = np.argsort(term, kind="stable")
    at = np.searchsorted(term[by_term], np.arange(terms + 1))
    size = np.diff(at)
    for low in range(0, n, HELD_SOURCES):
        high = min(low + HELD_SOURCES, n)
        sums = np.zeros((high - low, n), np.int64)
        for i in range(low, high):  # the first source has the term, as if the other had not
            a, b = by_source[i], by_source[i + 1]
            for x in range(a, b, max(1, HELD_PAIRS // n)):
                y = min(b, x + max(1, HELD_PAIRS // n))
                sums[i - low] += (times[x:y, None] * _gain(share[x:y, None], zero[None])).sum(0)
            sums[i - low] += lacking[i] * _gain(zero[i], zero)
        for j in range(n):  # the other has it, as if the first had not
            a, b = by_source[j], by_source[j + 1]
            for x in range(a, b, HELD_PAIRS // HELD_SOURCES):
                y = min(b, x + HELD_PAIRS // HELD_SOURCES)
                change = _gain(zero[low:high, None], share[None, x:y]) - _gain(zero[low:high], zero[j])[:, None]
                sums[:, j] += (times[x:y] * change).sum(1)
        mine = by_term[(source[by_term] >= low) & (source[by_term] < high)]
        ends = np.cumsum(size[term[mine]])
        x = 0
        while x < len(mine):  # both have it
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + HELD_PAIRS, side="right")))
            left = np.repeat(mine[x:y], size[term[mine[x:y]]])
            inner = np.arange(len(left)) - np.repeat(ends[x:y] - size[term[mine[x:y]]] - (ends[x - 1] if x else 0), size[term[mine[x:y]]])
            right = by_term[at[term[left]] + inner]
            s, t, u, v = zero[source[left]], zero[source[right]], p[left], p[right]
            np.add.at(sums, (source[left] - low, source[right]), _gain(u, v) - _gain(u, t) - _gain(s, v) + _gain(s, t))
            x = y
        i, j = np.nonzero(np.arange(low, high)[:, None] != np.arange(n)[None])
        yield pd.DataFrame({"source": names[low + i], "item": names[j], "value": sums[i, j]})


def _pairs_of(key: tuple, counts: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    return pd.concat(list(_pair_sums(counts, heads))).assign(lang=key[0])[["lang", "source", "item", "value"]]


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from every other of its language, and its most telling terms.

    A null text, lang or source is empty. A term is a run of letters A-Z and a-z and of any characters above U+007F; only
    A-Z are lower-cased. A language keeps the terms that at least ``least_docs`` of its rows have; repeated rows count
    each. Every (lang, source) that occurs is a group, also without terms. Part ``pair`` ranks all other sources of the
    language; with no kept term the values are 0. Part ``term`` ranks the ``top`` kept terms that are more frequent in the group than
    in the language. An empty table gives an empty table. Of a language, a task holds a block of terms and the names of its sources.
    """
    counts = stored(term_counts(docs), "audit-counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("sources"))
    kept = stored(kept.filter(F.col("docs") >= least_docs).drop("docs"), "audit-terms")
    langs = kept.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"), F.sum("sources").alias("rows"))
    terms = kept.select(F.col("lang").alias("kept_lang"), F.col("term").alias("kept_term"), "total")
    own = counts.filter("term is not null").join(terms, (F.col("lang") == F.col("kept_lang")) & (F.col("term") == F.col("kept_term")))
    own = stored(own.select("lang", "source", "term", "count", "total"), "audit-kept")
    totals = own.groupBy(F.col("lang").alias("g"), F.col("source").alias("s")).agg(F.sum("count").alias("group_total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, (F.col("lang") == F.col("g")) & (F.col("source") == F.col("s")), "left")
    groups = groups.join(langs, F.col("lang") == F.col("l"), "left")
    number = [F.coalesce(c, F.lit(0)).alias(c) for c in ("group_total", "lang_total", "terms", "rows")]
    groups = stored(groups.select("lang", "source", *number), "audit-groups")

    sized = own.join(groups.withColumnsRenamed({"lang": "g", "source": "s"}), (F.col("lang") == F.col("g")) & (F.col("source") == F.col("s")))
    blocks = F.ceil(F.greatest("rows", F.lit(1)) / BLOCK_COUNTS)
    shared = sized.select(
        "lang", "source", "term", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"),
        _share(F.col("count"), F.col("group_total"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    heads = groups.select(
        "lang", "source", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"),
        F.when(F.col("terms") > 0, _share(F.lit(0), F.col("group_total"), F.greatest("terms", F.lit(1)))).otherwise(1).alias("zero"),
    )

    both = shared.select("lang", "block", "source", "term", "p").groupBy("lang", "block").cogroup(heads.groupBy("lang", "block"))
    paired = both.applyInPandas(_pairs_of, "lang string, source string, item string, value long")
    paired = paired.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    telling = shared.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = paired.withColumn("rank", rank).unionByName(telling.withColumn("rank", rank).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
