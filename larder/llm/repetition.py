"""Quality rules that measure how much of a text repeats itself.

Words are hashed from the bytes of many texts at once; a rolling sum over word hashes gives the hash of every run of n
words. A run of n + 1 words can only repeat where both of its runs of n words do, so that each length looks only at
what the one before has left.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larder.llm import columns as C

#: Largest share of a text's word characters in runs of n words that came before.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest shares of lines that came before, by number and by word characters.
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.20
#: Fewest words, largest percentage of words in repeated runs of three, most symbols per word.
LEAST_WORDS, REPEATED_PERCENT, SYMBOLS_PER_WORD = 50, 50, 0.1
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "dup_line_share double, dup_line_char_share double, dup_ngram_char_shares array<double>, failed array<string>, kept boolean"
)


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are found twice or more, and which of them came before (at a lower index)."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    any_, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order] = same
    any_[order] = same | np.concatenate([same[1:], [False]]) if len(keys) else same
    return any_, later


def _covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``length`` that starts at one of ``at``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, rolling: C.Rolling, over_words: C.Rolling, shares: Mapping[int, float]) -> dict[str, np.ndarray]:
    """All measures of the rows of one slice."""
    n = len(offsets) - 1
    starts, ends, first = C.words(data, offsets)
    letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & ~C._SPACE[data], out=letter[1:])
    sums = rolling.sums(data)
    hashes = rolling.between(sums, starts, ends)
    row = np.repeat(np.arange(n), np.diff(first))
    word_chars = letter[offsets[1:]] - letter[offsets[:-1]]
    weight = letter[ends] - letter[starts]

    n_words = len(hashes)
    word_sums = over_words.sums(hashes)
    last = first[1:][row]  # one past the last word of a word's row
    salt = C.mix(row.astype(np.uint64) + np.uint64(7))

    def twice(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        keys = over_words.between(word_sums, at, at + length) ^ salt[at]
        any_, later = _twice(keys)
        return at[any_], at[later]

    at, _ = twice(np.flatnonzero(np.arange(n_words) + 3 <= last), 3)
    out = {"n_words": np.diff(first), "word_chars": word_chars, "n_repeat_words": C.run_sums(_covered(at, 3, n_words), first)}
    length, per_length = 3, []
    for size in sorted(shares):
        while length < size:
            # Both the run without its last word and the one without its first word must repeat.
            repeats = np.zeros(n_words + 1, bool)
            repeats[at] = True
            at = at[repeats[at + 1]]
            at = at[at + length + 1 <= last[at]] if len(at) else at
            length += 1
            if length == size or length in shares:
                at, later = twice(at, length)
        chars = C.run_sums(np.where(_covered(later, size, n_words), weight, 0), first)
        per_length.append(chars / np.maximum(word_chars, 1))
    out["ngram_shares"] = np.stack(per_length, 1) if per_length else np.zeros((n, 0))

    l_starts, l_ends, l_first = C.runs(data != 10, offsets)
    has_word = letter[l_ends] > letter[l_starts]
    l_row = np.repeat(np.arange(n), np.diff(l_first))[has_word]
    l_starts, l_ends = l_starts[has_word], l_ends[has_word]
    keys = rolling.between(sums, l_starts, l_ends) ^ C.mix(l_row.astype(np.uint64) + np.uint64(7))
    _, later = _twice(keys)
    chars = (letter[l_ends] - letter[l_starts]) * later
    out["n_lines"] = np.bincount(l_row, minlength=n)
    out["n_dup_lines"] = np.bincount(l_row, later, n).astype(np.int64)
    out["line_char_share"] = np.bincount(l_row, chars, n) / np.maximum(word_chars, 1)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = C.run_sums(symbol[data], offsets)
    return out


def quality(docs: DataFrame, shares: Mapping[int, float] = NGRAM_SHARES) -> DataFrame:
    """Base counts, coverage by repeated runs and lines, and a verdict for each row, with its doc_id.

    A null or empty text, or one of white space only, has all counts 0, fails for its number of words and isn't kept.
    Repeated rows get the same result each. A text of any length is measured whole. Other columns are left alone.
    """
    table, shares = C.byte_table(71), dict(sorted(shares.items()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, over_words = C.Rolling(table), C.Rolling()
        for batch, data, offsets in C.slices(batches, "text"):
            m = measure(data, offsets, rolling, over_words, shares)
            line_share = m["n_dup_lines"] / np.maximum(m["n_lines"], 1)
            rules = {
                "words": m["n_words"] < LEAST_WORDS,
                "repeated_words": 100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"],
                "lines": line_share > LINE_SHARE,
                "line_chars": m["line_char_share"] > LINE_CHAR_SHARE,
                "symbols": m["n_symbols"] > SYMBOLS_PER_WORD * m["n_words"],
            } | {f"ngrams_{k}": m["ngram_shares"][:, i] > s for i, (k, s) in enumerate(shares.items())}
            failed = np.stack(list(rules.values()), 1)
            names = np.array(list(rules))
            base = rules["words"] | rules["repeated_words"]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(m["n_words"]), pa.array(m["word_chars"]), pa.array(m["n_symbols"]),
                    pa.array(m["n_dup_lines"]), pa.array(m["n_repeat_words"]), pa.array(base), pa.array(line_share),
                    pa.array(m["line_char_share"]), pa.array(list(m["ngram_shares"]), pa.list_(pa.float64())),
                    pa.array([list(names[f]) for f in failed], pa.list_(pa.string())), pa.array(~failed.any(1)),
                ],
                ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]],
            )

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
