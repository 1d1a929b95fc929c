"""Language identification by character models with interpolated Kneser-Ney smoothing.

A model sees a text as its words, runs of letters in lower case, each with a mark before and after it; what comes next in
a word depends on up to four characters before. The models of all languages share one sorted array of n-gram hashes
with one column of log probabilities for each language, and one of context hashes with the weights of the shorter
context. A slice of texts is scored through its different words. The language with the lowest cross-entropy per
character is predicted. Rejection goes by parts: each word costs what the language that knows it best asks, so a text in
two known languages is as cheap as its parts, and one in an unknown language is not. The limit lies half way between what
labelled texts that were not counted cost, and what the same texts cost with their own language left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import columns as C

UNKNOWN = "und"
ORDER = 5
#: Labelled rows per language, on average, that are counted, and others that set the limits: the bound of what is fitted.
SAMPLE_ROWS, LIMIT_ROWS = 300, 2000
#: Of the labelled rows of a small table, one of so many sets the limits and isn't counted.
LIMIT_SHARE = 4
#: Share of the texts behind a limit that lie outside what a short text may cost more.
OUTSIDE_SHARE = 0.002
#: Labelled texts quote other languages and each other, which makes them cheap without their own language: of what they
#: cost then, the quantile that stands for a text all in an unknown language.
UNMIXED = 0.9
#: The limit above the usual cost, in bits a character, where no other language says what an unknown one costs.
ALONE_BITS = 2.0
#: Characters beyond which more text makes a score no surer.
SURE_AFTER = 64
BEGIN, END = 1, 2


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Which of the first 131072 code points are letters, and their lower case."""
    chars = [chr(c) for c in range(1 << 17)]
    is_letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
    lower = np.arange(len(chars), dtype=np.uint32)
    for c in np.flatnonzero(is_letter).tolist():
        low = chars[c].lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return is_letter, lower


class Words:
    """The different words of a slice, marked, and which of them each row has."""

    def __init__(self) -> None:
        self.is_letter, self.lower = letters()
        self.rolling = C.Rolling()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of all different words, offset of each, word of each place, first place of each row, places in all)."""
        codes, at = C.code_points(data, offsets)
        known = np.minimum(codes, (1 << 17) - 1)
        far = (codes >= 0x20000) & (codes < 0x32400)  # more ideographs
        starts, ends, first = C.runs(self.is_letter[known] | far, at)
        low = np.where(far, codes, self.lower[known])
        hashes = self.rolling.between(self.rolling.sums(low), starts, ends)
        _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        length = (ends - starts)[example]
        bounds = np.concatenate([[0], np.cumsum(length + 2)])
        symbols = np.zeros(bounds[-1], np.uint32)
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        symbols[np.repeat(bounds[:-1] + 1, length) + inner] = low[np.repeat(starts[example], length) + inner]
        symbols[bounds[:-1]], symbols[bounds[1:] - 1] = BEGIN, END
        return symbols, bounds, which, first, length + 1


def evidence(which: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Characters of the different words of each row: a word said a hundred times tells no more than once."""
    words = max(len(length), 1)
    pairs = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * words + which)
    return np.bincount(pairs // words, length[pairs % words], len(first) - 1)


@dataclass
class Model:
    """Sorted hashes of n-grams and contexts, and bits for each language."""

    languages: list[str]
    grams: np.ndarray
    gram_bits: np.ndarray
    contexts: np.ndarray
    context_bits: np.ndarray
    unseen_bits: float
    usual: np.ndarray | None = None
    limit: np.ndarray | None = None
    spread: np.ndarray | None = None

    def allowed(self, language: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bits a character that texts with different words of ``n`` characters may cost."""
        return np.maximum(self.limit[language], self.usual[language] + self.spread[language] / np.sqrt(n))

    def score(self, symbols: np.ndarray, bounds: np.ndarray, rolling: C.Rolling) -> np.ndarray:
        """Log2 probability of each word in each language."""
        sums = rolling.sums(symbols)
        begin = np.repeat(bounds[:-1], np.diff(bounds))
        at = np.flatnonzero(np.arange(len(symbols)) > begin)
        bits = np.zeros((len(symbols), len(self.languages)), np.float32)
        size = np.minimum(ORDER, at - begin[at] + 1)
        for k in range(ORDER, 0, -1):
            now = size >= k
            here = at[now]
            place, found = _look(self.grams, rolling.between(sums, here - k + 1, here + 1))
            bits[here[found]] += self.gram_bits[place[found]]
            missed = here[~found]
            if len(missed):
                place, known = _look(self.contexts, rolling.between(sums, missed - k + 1, missed) if k > 1 else np.full(len(missed), EMPTY))
                bits[missed[known]] += self.context_bits[place[known]]
                if k == 1:
                    bits[missed] += self.unseen_bits
            left = np.ones(len(at), bool)
            left[np.flatnonzero(now)[found]] = False
            at, size = at[left], np.minimum(size[left], k - 1)
        return np.add.reduceat(bits, bounds[:-1], axis=0) if len(bounds) > 1 else bits[:0]


#: The hash of the empty context.
EMPTY = np.uint64(1)


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _count(words: list[str], counts: np.ndarray, rolling: C.Rolling) -> list[dict[str, np.ndarray]]:
    """For each order, the n-grams of one language with their probability parts: keys, context, suffix, counted, weight."""
    symbols = np.concatenate([np.frombuffer(("\x01" + w + "\x02").encode("utf-32-le"), np.uint32) for w in words])
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    bounds = np.concatenate([[0], np.cumsum(length)])
    begin, weight = np.repeat(bounds[:-1].astype(np.int32), length), np.repeat(counts.astype(np.float32), length)
    sums, place = rolling.sums(symbols), np.arange(len(symbols), dtype=np.int32)
    orders: list[dict[str, np.ndarray]] = []
    longer: np.ndarray | None = None  # an example of each n-gram that is one longer
    for k in range(ORDER, 0, -1):
        at = place[(place > begin) & (place - k + 1 >= begin)]
        keys, example, which = np.unique(rolling.between(sums, at - k + 1, at + 1), return_index=True, return_inverse=True)
        raw = np.bincount(which, weight[at], len(keys))
        at = at[example]
        adjusted = raw
        if longer is not None:
            after = np.bincount(np.searchsorted(keys, rolling.between(sums, longer - k + 1, longer + 1)), minlength=len(keys))
            adjusted = np.where(at - k + 1 == begin[at], raw, after)  # nothing comes before the mark
        context = rolling.between(sums, at - k + 1, at) if k > 1 else np.full(len(at), EMPTY)
        suffix = rolling.between(sums, at - k + 2, at + 1) if k > 1 else np.zeros(len(at), np.uint64)
        contexts, of = np.unique(context, return_inverse=True)
        total, different = np.bincount(of, adjusted), np.bincount(of)
        once, twice = (adjusted == 1).sum(), (adjusted == 2).sum()
        discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
        orders.append({
            "keys": keys, "context": context, "suffix": suffix, "counted": np.maximum(adjusted - discount, 0) / total[of],
            "contexts": contexts, "rest": discount * different / total,
        })
        longer = at
    return orders[::-1]


def fit(counts: dict[str, tuple[list[str], np.ndarray]]) -> Model:
    """A model from words and their counts for each language."""
    languages = sorted(counts)
    rolling = C.Rolling()
    each = [_count(*counts[x], rolling) for x in languages]
    symbols = len(set().union(*[set(c) for words, _ in counts.values() for c in words])) + 2
    lower_keys, lower = np.zeros(0, np.uint64), np.zeros((0, len(languages)))
    grams, gram_p, contexts, context_p = [], [], [], []
    for k in range(1, ORDER + 1):
        own = [x[k - 1] for x in each]
        keys, example = np.unique(np.concatenate([x["keys"] for x in own]), return_index=True)
        context = np.concatenate([x["context"] for x in own])[example]
        suffix = np.concatenate([x["suffix"] for x in own])[example]
        all_contexts = np.unique(context)
        rest = np.ones((len(all_contexts), len(languages)))
        p = np.zeros((len(keys), len(languages)))
        for i, x in enumerate(own):
            rest[np.searchsorted(all_contexts, x["contexts"]), i] = x["rest"]
            p[np.searchsorted(keys, x["keys"]), i] = x["counted"]
        shorter = lower[np.searchsorted(lower_keys, suffix)] if k > 1 else np.full(p.shape, 1 / symbols)
        p += rest[np.searchsorted(all_contexts, context)] * shorter
        grams.append(keys), gram_p.append(p), contexts.append(all_contexts), context_p.append(rest)
        lower_keys, lower = keys, p

    def joined(keys: list[np.ndarray], p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(keys)
        order = np.argsort(flat)
        return flat[order], np.log2(np.concatenate(p)[order]).astype(np.float32)

    return Model(languages, *joined(grams, gram_p), *joined(contexts, context_p), -float(np.log2(symbols)))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, limit_rows: int = LIMIT_ROWS) -> Model | None:
    """Fit to about ``rows`` labelled rows per language that aren't held out, and limits from ``limit_rows`` others, or a
    quarter of all where there are fewer; None if there are no labelled rows.

    What comes to the driver are the different words of the sample with their counts, and three numbers for each text that
    sets the limits.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    number = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not number:
        return None
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 40))

    def up_to(share: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)]), F.col("lang")) * (1 << 40)

    for_limit = {k: min(limit_rows / n, 1 / LIMIT_SHARE) for k, n in number.items()}
    sample = labelled.filter((place >= up_to(for_limit)) & (place < up_to({k: v + rows / number[k] for k, v in for_limit.items()})))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch, data, offsets in C.slices(batches, "text"):
            symbols, bounds, which, first, _ = words(data, offsets)
            text = [symbols[a + 1 : b - 1].tobytes().decode("utf-32-le") for a, b in zip(bounds[:-1], bounds[1:])]
            langs, of = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            found, n = np.unique(of[row] * len(text) + which, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[found // max(len(text), 1)].tolist(), pa.string()), pa.array([text[i] for i in (found % max(len(text), 1)).tolist()], pa.string()), pa.array(n)],
                ["lang", "word", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = counted.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    if not len(table):
        return None
    by_language = {k: table.filter(pa.compute.equal(table["lang"], k)) for k in table["lang"].unique().to_pylist()}
    model = fit({k: (x["word"].to_pylist(), x["n"].to_numpy().astype(np.float64)) for k, x in by_language.items()})
    return _with_limits(model, _costs(labelled.filter(place < up_to(for_limit)), model))


def _costs(labelled: DataFrame, model: Model) -> pd.DataFrame:
    """For each text its language, the characters ``n`` of its different words, cost by parts, and the same without its own language, which then is ``taken_for``."""
    shared = labelled.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = Model(**shared.value), Words()
        for batch, data, offsets in C.slices(batches, "text"):
            symbols, bounds, which, first, length = words(data, offsets)
            n = C.run_sums(length[which], first)
            bits = model.score(symbols, bounds, words.rolling).astype(np.float64)[which]
            langs = batch.column("lang").to_pylist()
            cost, without, taken = np.full((3, len(n)), np.nan)
            for i in np.flatnonzero(n > 0).tolist():
                mine = bits[first[i] : first[i + 1]]
                cost[i] = -mine.max(1).sum() / n[i]
                others = [k for k, x in enumerate(model.languages) if x != langs[i]]
                if others:
                    without[i] = -mine[:, others].max(1).sum() / n[i]
                    taken[i] = others[int(mine[:, others].sum(0).argmax())]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(evidence(which, first, length)), pa.array(cost), pa.array(without), pa.array(taken)], names)

    names = ["lang", "n", "cost", "without", "taken_for"]
    return labelled.mapInArrow(rows, "lang string, n double, cost double, without double, taken_for double").toPandas()


def _with_limits(model: Model, costs: pd.DataFrame) -> Model:
    """Per language its usual cost, the limit for long texts, and what the square root of the number of characters adds for short ones."""
    costs = costs[costs["cost"].notna()]
    model.usual, model.limit, model.spread = (np.full(len(model.languages), np.inf) for _ in range(3))
    for i, name in enumerate(model.languages):
        own, strange = costs[costs["lang"] == name], costs[costs["taken_for"] == i]
        strange = strange if len(strange) else costs[costs["without"].notna() & (costs["lang"] != name)]
        if not len(own):
            continue
        n = own["n"].to_numpy()
        model.usual[i] = np.average(own["cost"], weights=n)
        unknown = np.quantile(strange["without"], UNMIXED) if len(strange) else model.usual[i] + 2 * ALONE_BITS
        model.limit[i] = max((model.usual[i] + unknown) / 2, model.usual[i])
        outside = np.quantile((own["cost"] - model.usual[i]) * np.sqrt(n), 1 - OUTSIDE_SHARE)
        # However odd some texts are, enough characters show that a language is unknown.
        model.spread[i] = np.clip(outside, 1.0, max(1.0, (unknown - model.usual[i]) * np.sqrt(SURE_AFTER)))
    return model


LANGUAGE = "lang_pred string, score double, cross_entropy double, n_symbols long, rejected boolean"


def annotate(docs: DataFrame, model: Model | None, into: str = "language") -> DataFrame:
    """All columns of ``docs`` and a struct ``into`` of lang_pred, score, cross_entropy, n_symbols, rejected.

    A text that is null or has no letter is ``und`` with score 0, and rejected; so is every text without a model.
    Cross-entropy is in bits per character, marks included. A column of that name is replaced.
    """
    docs = docs.drop(into)
    fields = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("n_symbols", pa.int64()), ("rejected", pa.bool_())])
    # Plain arrays: what is broadcast must not need this package on an executor.
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else dict(vars(model)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = None if shared.value is None else Model(**shared.value), Words()
        for batch, data, offsets in C.slices(batches, "text"):
            symbols, bounds, which, first, length = words(data, offsets)
            n = C.run_sums(length[which], first)
            some = n > 0 if model is not None else np.zeros(len(n), bool)
            name, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            entropy, rejected = np.full(batch.num_rows, np.nan), ~some
            if some.any():
                bits = model.score(symbols, bounds, words.rolling).astype(np.float64)[which]
                total = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0)])
                each = (total[first[:-1]] - total[first[1:]])[some] / n[some, None]
                best = each.argmin(1)
                lowest = each[np.arange(len(best)), best]
                score[some] = 1 / np.exp2((lowest[:, None] - each) * np.minimum(n[some], SURE_AFTER)[:, None]).sum(1)
                name[some], entropy[some] = np.array(model.languages, object)[best], lowest
                parts = np.concatenate([[0], np.cumsum(bits.max(1))])
                cost = (parts[first[:-1]] - parts[first[1:]])[some] / n[some]
                if model.limit is not None:
                    rejected[some] = cost > model.allowed(best, evidence(which, first, length)[some])
            found = pa.StructArray.from_arrays(
                [pa.array(name, pa.string()), pa.array(score), pa.array(entropy, mask=~some), pa.array(n), pa.array(rejected)], fields=list(fields)
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    names = [*docs.columns, into]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(rows, f"{kinds}, `{into}` struct<{', '.join(x.replace(' ', ': ') for x in LANGUAGE.split(', '))}>")


def in_known_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows that aren't rejected, all their columns as they were, whatever their names."""
    into = "language"
    while into in docs.columns:
        into += "_"
    return annotate(docs, model, into).filter(~F.col(f"{into}.rejected")).drop(into)


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out and the fields of :func:`annotate` for every row, from a model of the rows that aren't held out.

    Rows that repeat get the same result each; an empty table gives an empty table; a null doc_id isn't held out, and not learned from.
    """
    found = annotate(docs.select("doc_id", "text"), learn(docs, rows))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")
