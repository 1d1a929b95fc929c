"""Top-k retrieval of sections for queries.

Both sides are dealt into blocks by their ids, and a block of sections meets a block of queries in one group, which keeps k
sections per query. No section-query pair is written out, nothing goes through the driver, and no job runs before the result is
asked for. Words are counted where the texts are read; of a section only words that some query has are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import round_to
from larder.operators.ordering import top_per

FOUND = "query_id bigint, section_id bigint, similarity double"
#: Rows of one block, and products of weights that are added up at once.
SECTION_BLOCK, QUERY_BLOCK, HELD_PRODUCTS = 4096, 1024, 1 << 21
#: Text whose words are counted together; a longer text is counted by itself.
TEXT_BYTES = 4 << 20
RANK_SCALE = 1e9  # scores that agree to nine digits are ties, whatever the order of their sums


def word_weights(rows: DataFrame, unit: bool = False) -> DataFrame:
    """(id, word, weight) for each different word of each row (id, text), lower-cased and cut at white space, at 1 + ln tf.

    Words of some MB of text are numbered and counted together, so that nothing is shuffled. With ``unit`` the weights of
    a row are divided by their length as a vector.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, side="right")))
                words = pc.ascii_split_whitespace(batch.column("text").slice(at, to - at))
                numbered = words.flatten().dictionary_encode()
                different = max(1, len(numbered.dictionary))
                keys = pc.list_parent_indices(words).to_numpy().astype(np.int64) * different + numbered.indices.to_numpy()
                keys, times = np.unique(keys, return_counts=True)
                some = pc.not_equal(numbered.dictionary, "").to_numpy(zero_copy_only=False)[keys % different] if len(keys) else np.zeros(0, bool)
                row, word, weight = keys[some] // different, keys[some] % different, 1.0 + np.log(times[some])
                if unit:
                    weight /= np.sqrt(np.bincount(row, weight * weight, to - at))[row]
                out = [batch.column("id").take(pa.array(row + at)), numbered.dictionary.take(pa.array(word)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(out, ["id", "word", "weight"])
                at = to

    return rows.select("id", F.lower("text").alias("text")).mapInArrow(count, "id bigint, word string, weight double")


def _blocks(rows: Column, size: int) -> Column:
    return F.greatest(F.ceil(rows / F.lit(size)), F.lit(1)).cast("int")


def _count(rows: DataFrame) -> Column:
    """How many rows there are, found when the result is."""
    return rows.agg(F.count(F.lit(1))).scalar()


def _dealt(sections: DataFrame, queries: DataFrame, n_sections: Column, n_queries: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with (section_block, query_block): a row once for each block of the other side."""
    n, m = _blocks(n_sections, SECTION_BLOCK), _blocks(n_queries, QUERY_BLOCK)
    left = sections.withColumn("section_block", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), m - 1)))
    right = queries.withColumn("query_block", F.pmod(F.xxhash64("id"), m).cast("int")).withColumn("section_block", F.explode(F.sequence(F.lit(0), n - 1)))
    return left, right


def _best(scores: np.ndarray, section_ids: np.ndarray, query_ids: np.ndarray, k: int, least: float = -np.inf) -> pd.DataFrame:
    """The k best columns of each row of scores above ``least``, ties by the smaller id."""
    scores = np.floor(scores * RANK_SCALE + 0.5) / RANK_SCALE
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    else:
        edge = np.full((len(scores), 1), -np.inf)
    q, s = np.nonzero((scores >= edge) & (scores > least))
    value = scores[q, s]
    order = np.lexsort((section_ids[s], -value, q))
    q, s, value = q[order], s[order], value[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    q, s, value = q[nth < k], s[nth < k], value[nth < k]
    return pd.DataFrame({"query_id": query_ids[q], "section_id": section_ids[s], "similarity": value})


def _finish(found: DataFrame, k: int, digits: int) -> DataFrame:
    best = top_per(found, ["query_id"], ["-similarity", "section_id"], k)
    return best.withColumn("similarity", round_to("similarity", digits))


def retrieve_vectors(queries: DataFrame, sections: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Best k sections per query by cosine of dense vectors.

    Both sides have a whole-number ``id`` and an array column ``vector``. A row without an id or a vector, or with a vector of
    zeros, finds nothing and is not found.
    """

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        return rows.filter(F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0))

    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.asarray(vectors.tolist(), dtype=np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "section_id": [], "similarity": []})
        return _best(unit(right["vector"]) @ unit(left["vector"]).T, left["id"].to_numpy(), right["id"].to_numpy(), k)

    sections, queries = usable(sections), usable(queries)
    left, right = _dealt(sections, queries, _count(sections), _count(queries))
    blocks = ["section_block", "query_block"]
    return _finish(left.groupBy(blocks).cogroup(right.groupBy(blocks)).applyInPandas(near, FOUND), k, digits)


def _scores(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of a block of sections for a block of queries; rows are (id, word, weight), one per different word."""
    none = pd.DataFrame({"query_id": [], "section_id": [], "similarity": []})
    if not len(left) or not len(right):
        return none
    section_ids, s = np.unique(left["id"].to_numpy(), return_inverse=True)
    query_ids, q = np.unique(right["id"].to_numpy(), return_inverse=True)
    order = np.argsort(left["word"].to_numpy(), kind="stable")
    words, s, weight = left["word"].to_numpy()[order], s[order], left["weight"].to_numpy()[order]
    order = np.argsort(q, kind="stable")
    q, asked, asks = q[order], right["word"].to_numpy()[order], right["weight"].to_numpy()[order]
    low, high = np.searchsorted(words, asked), np.searchsorted(words, asked, side="right")
    step = max(1, HELD_PRODUCTS // len(section_ids))  # queries whose scores are held
    out = []
    for first in range(0, len(query_ids), step):
        n = min(step, len(query_ids) - first)
        a, b = np.searchsorted(q, [first, first + n])
        scores = np.zeros(n * len(section_ids))
        ends = np.cumsum(high[a:b] - low[a:b])
        x = 0
        while x < b - a:
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + HELD_PRODUCTS, side="right")))
            size = high[a + x : a + y] - low[a + x : a + y]
            of = np.repeat(np.arange(a + x, a + y), size)
            hit = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            scores += np.bincount((q[of] - first) * len(section_ids) + s[hit], asks[of] * weight[hit], len(scores))
            x = y
        out.append(_best(scores.reshape(n, -1), section_ids, query_ids[first : first + n], k, 0.0))
    return pd.concat(out) if out else none


def retrieve_top_k(queries: DataFrame, sections: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Best k sections per query by cosine of weighted words.

    Words are lower-cased and cut at white space. Section weights are 1 + ln tf, query weights (1 + ln tf) · ln(N / df),
    both normalised (the lnc.ltc scheme); N counts the sections with a text. Both sides have a whole-number ``id``, each id
    once, and a ``text``; whole texts are used. A query or section without an id or text finds nothing and is not found.

    The sections' words that queries have are dealt into blocks once; document frequencies are counted on what is dealt.
    """
    usable = F.col("id").isNotNull() & F.col("text").isNotNull()
    queries = queries.filter(usable).select(F.col("id").cast("bigint").alias("id"), "text")
    sections = sections.filter(usable).select(F.col("id").cast("bigint").alias("id"), "text")
    asked = word_weights(queries)
    vocabulary = asked.select(F.col("word").alias("wanted")).distinct()
    index = word_weights(sections, unit=True)
    index = index.join(vocabulary, F.col("word") == F.col("wanted"), "left_semi")
    sizes = _count(sections), _count(queries)
    dealt, _ = _dealt(index, asked, *sizes)
    # Counting frequencies on every column of what is dealt lets Spark use one exchange for both; the texts are read once.
    dealt = dealt.repartition("section_block", "query_block")
    once = (F.col("query_block") == 0) & F.col("id").isNotNull() & (F.col("weight") > 0) & (F.col("section_block") >= 0)
    frequency = dealt.groupBy(F.col("word").alias("w")).agg(F.count_if(once).alias("df"))
    frequency = frequency.select("w", F.log(sizes[0] / F.col("df").cast("double")).alias("idf"))
    weighed = asked.join(frequency, F.col("word") == F.col("w")).select("id", "word", (F.col("weight") * F.col("idf")).alias("weight"))
    norms = weighed.groupBy(F.col("id").alias("i")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    weighed = weighed.join(norms, F.col("id") == F.col("i")).filter("norm > 0").select("id", "word", (F.col("weight") / F.col("norm")).alias("weight"))
    _, weighed = _dealt(index, weighed, *sizes)
    # Words meet by a hash of 64 bits.
    hashed = F.xxhash64("word").alias("word")
    left = dealt.select("id", hashed, "weight", "section_block", "query_block").groupBy("section_block", "query_block")
    right = weighed.select("id", hashed, "weight", "section_block", "query_block").groupBy("section_block", "query_block")
    return _finish(left.cogroup(right).applyInPandas(lambda a, b: _scores(a, b, k), FOUND), k, digits)
