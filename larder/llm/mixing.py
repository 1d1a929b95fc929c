"""Mix sources to target weights by hash thresholds, without sorting documents.

Each document has a hash of 60 bits. Words are summed by source and by the first 12 bits; the bucket in which a source
reaches its budget is the boundary bucket. Only its documents are summed again by the next 12 bits, and so on, until
the threshold is one hash. Below it a document is taken, above it not. A source of which more than all is wanted is
taken whole, and a part of it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.store import stored

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def position(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits that decide when a document is taken; equal documents with one id have the same."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 64 - BITS * LEVELS)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """``target`` of each row of (source, source_size), one row per source.

    Sources in code point order, null last, have the weights in turn. They share ``share`` times all words by weight; no
    target is above ``limit`` times its source's words, and what is above goes to the others by weight. With sources in
    the order in which they reach their limit, the level at which the rest share is found by running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("bound", limit * F.col("source_size"))
    rows = rows.withColumn("full_at", F.col("bound") / F.col("weight")).withColumn("nth", F.row_number().over(Window.orderBy("full_at", F.col("source").asc_nulls_last())))
    before, every = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source that doesn't reach its limit has the level of all that follow.
    first = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("nth", "level"))).over(every)
    rows = rows.withColumn("level", first["level"])
    target = F.least("bound", F.coalesce(F.col("weight") * F.col("level"), F.col("bound")))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Rows of (source, bucket, source_size, target, whole, edge) that decide every document of a bucket.

    ``sized`` has source, size and position. ``whole`` is how often all of the source is taken; documents whose position
    is below ``edge`` are taken once more.
    """
    shift = BITS * (LEVELS - 1)
    buckets = stored(
        sized.groupBy("source", F.shiftright("position", shift).alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets"
    )
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stored(targets, "mix-targets")
    edge = _boundary(buckets.join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    inside = sized
    for level in range(1, LEVELS):
        shift -= BITS
        at = edge.select(F.col("source").alias("s"), F.col("bucket").alias("prefix"), "rest")
        inside = inside.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("position", shift + BITS) == F.col("prefix"))).drop("s", "prefix")
        if level == 1:
            inside = stored(inside, "mix-edge")
        found = _boundary(inside.groupBy("source", "rest", F.shiftright("position", shift).alias("bucket")).agg(F.sum("size").alias("words")))
        inside, edge = inside.drop("rest"), found
    # The last documents come in where that is nearer to the target than leaving them out.
    last = F.col("bucket") + F.when(2 * F.col("rest") >= F.col("words"), 1).otherwise(0)
    last = stored(edge.select(F.col("source").alias("s"), last.alias("edge")), "mix-thresholds")
    targets = targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    none = F.when(F.col("rest") > 0, F.lit(1 << (BITS * LEVELS))).otherwise(0)
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("edge", none).alias("edge"))
    return buckets.join(targets, F.col("source").eqNullSafe(F.col("s"))).select("source", "bucket", "source_size", "target", "whole", "edge")


def _boundary(rows: DataFrame) -> DataFrame:
    """The bucket of each source in which its running sum passes ``rest``, with what is then left of the rest.

    A source has no more buckets than a level has values.
    """
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rest", F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0)))
    rows = rows.filter((F.col("rest") >= 0) & (F.col("rest") < F.col("words")))
    return rows.select("source", "bucket", "rest", "words")


def take(positioned: DataFrame, decided: DataFrame) -> DataFrame:
    """``repeats`` of each document, which has source and position; documents are matched by source and bucket, so that a large source is many keys."""
    decided = decided.withColumnsRenamed({"source": "s", "bucket": "b"})
    met = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("position", BITS * (LEVELS - 1)) == F.col("b"))
    repeats = F.col("whole") + F.when(F.col("position") < F.col("edge"), 1).otherwise(0)
    return positioned.join(decided, met).withColumn("repeats", repeats.cast("int")).drop("s", "b", "whole", "edge")


def mix(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, repeats, taken.

    ``size`` is the number of words; a null text has none. A null source is a source, the last one. Repeated rows are
    taken alike. A source without words has target 0, and nothing of it is taken. An empty table gives an empty table.
    Other columns are left alone, whatever their names.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), position(F.col("doc_id"), F.col("text"), seed).alias("position"))
    sized = stored(sized, "mix-sizes")
    taken = take(sized, thresholds(sized.select("source", "size", "position"), **options))
    return taken.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns they came with."""
    named = docs.withColumn("__at", position(F.col("doc_id"), F.col("text"), seed))
    sized = stored(docs.select("source", word_count(F.col("text")).alias("size"), position(F.col("doc_id"), F.col("text"), seed).alias("position")), "mix-sizes")
    decided = thresholds(sized, **options).select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), F.col("whole").alias("__whole"), F.col("edge").alias("__edge"))
    met = F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("__at", BITS * (LEVELS - 1)) == F.col("__b"))
    repeats = (F.col("__whole") + F.when(F.col("__at") < F.col("__edge"), 1).otherwise(0)).cast("int")
    taken = named.join(decided, met).withColumn("__n", F.explode(F.array_repeat(F.lit(0), repeats)))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
