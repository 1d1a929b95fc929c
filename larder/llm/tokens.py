"""Token ids of many texts at once, as a byte-level tokenizer file gives them.

A byte-level tokenizer first splits a text into words by a fixed pattern and then merges within each word. Here the
pattern is applied to the bytes of a whole slice, every different word is merged once, and the ids of texts are put
together from those of their words. Texts with characters whose class may differ between Unicode
versions go to the tokenizer whole.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata

import numpy as np

from larder.llm import columns as C

SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: What may follow an apostrophe as a word of its own.
ONE, TWO = "stmd", ("re", "ve", "ll")
#: Different words whose ids are kept; with more, the memory starts anew.
KEPT_WORDS, SLOT_BITS = 1 << 20, 21


def character_classes() -> np.ndarray:
    """The class of each code point below 65536, and ODD for all above."""
    out = np.full(65537, OTHER, np.uint8)
    for c in range(65536):
        kind = unicodedata.category(chr(c))
        if kind in ("Cn", "Cs"):
            out[c] = ODD
        elif kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
    # The characters of the property White_Space.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[65536] = ODD
    return out


def byte_classes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    out = classes[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    b = [data[np.minimum(lead + k, len(data) - 1)].astype(np.uint32) for k in range(3)]
    code = np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63)
    kind = np.where(b[0] < 0xF0, classes[np.minimum(code, 65535)], ODD).astype(np.uint8)
    out[lead] = kind
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        long = b[0] >= least
        out[lead[long] + k] = kind[long]
    return out


def word_starts(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the words of the pattern start; together they cover every row.

    The last of several white-space characters belongs to the next word if it is a space, and is else a word of its own;
    those before it are one word.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = edge[:-1].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    first = np.flatnonzero(start)
    last = np.append(first[1:], n) - 1
    last = last[(kinds[first] == SPACE) & ~edge[last + 1]]  # of white space that something follows
    start[last[data[last] == 32] + 1] = False
    for _ in range(3):
        inner = (data[last] & 0xC0) == 0x80
        if not inner.any():
            break
        last = last - inner
    start[last] = True
    # An apostrophe alone, not after a space, and the letters that make a word with it.
    alone = np.flatnonzero(data[: n - 1] == 39)
    alone = alone[start[alone] & ~edge[alone + 1] & (kinds[alone + 1] == LETTER)]
    if len(alone):
        a, b = data[alone + 1], np.where(edge[np.minimum(alone + 2, n)], 0, data[np.minimum(alone + 2, n - 1)])
        took = np.where(np.isin(a, [ord(c) for c in ONE]), 1, 0)
        for x, y in TWO:
            took[(a == ord(x)) & (b == ord(y))] = 2
        alone, took = alone[took > 0], took[took > 0]
        start[alone + 1] = False
        rest = alone + 1 + took
        rest = rest[rest < n]
        start[rest[~edge[rest] & (kinds[rest] == LETTER)]] = True
    return np.flatnonzero(start)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, from eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    length = ends - starts

    def load(at: np.ndarray, most: np.ndarray) -> np.ndarray:
        return little_endian(np.ascontiguousarray(eight[at]).view(np.uint64).ravel()) & masks[np.minimum(most, 8)]

    out = C.mix(load(starts, length) ^ length.astype(np.uint64) << np.uint64(56))
    rest, done = np.flatnonzero(length > 8), 8
    while len(rest):
        out[rest] = C.pair(out[rest], load(starts[rest] + done, length[rest] - done))
        done += 8
        rest = rest[length[rest] > done]
    return out


class Encoder:
    """Ids of the rows of a slice. Keeps the ids of the words it has met in a table that is addressed by their hash."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The ids of a byte-level vocabulary are in the order of its merges, which is all that merging a word needs.
        letter = byte_letters()
        special = set(self.tokenizer.get_added_tokens_decoder())
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(letter[c] for c in word): i for word, i in vocabulary.items() if i not in special}
        self.merged = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.kinds = character_classes()
        self._forget()

    def _forget(self, words: int = 0) -> None:
        """Start anew, with slots for twice the words of a slice at least."""
        self.met, self.bits = 0, max(SLOT_BITS, (2 * words).bit_length())
        self.slot = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.length = np.zeros(1 << self.bits, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash: its own, or the empty one where it belongs."""
        mask = np.int64((1 << self.bits) - 1)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.slot[at]
        left = np.flatnonzero((held != hashes) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            held = self.slot[at[left]]
            left = left[(held != hashes[left]) & (held != 0)]
        return at

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        merge = self.merged._core_bpe.encode_single_piece
        ids = [merge(w) for w in words]
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(length.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        at = self.used + np.cumsum(length) - length
        self.used += total
        self.met += len(words)
        while len(hashes):
            slot = self._find(hashes)
            _, first = np.unique(slot, return_index=True)  # of several that belong in one empty slot, one gets it now
            self.slot[slot[first]], self.at[slot[first]], self.length[slot[first]] = hashes[first], at[first], length[first]
            left = np.ones(len(hashes), bool)
            left[first] = False
            hashes, at, length = hashes[left], at[left], length[left]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows and the offset of each row among them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kinds = byte_classes(data, self.kinds)
        starts = word_starts(data, offsets, kinds)
        ends = np.append(starts[1:], len(data))
        hashes = word_hashes(data, starts, ends) | np.uint64(1)
        slot = self._find(hashes)
        new = np.flatnonzero(self.slot[slot] == 0)
        if len(new):
            different, first = np.unique(hashes[new], return_index=True)
            if self.met + len(different) > KEPT_WORDS:
                different, first = np.unique(hashes, return_index=True)
                self._forget(len(different))
                new = np.arange(len(hashes))
            text, example = data.tobytes(), new[first]
            self._learn(different, [text[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist())])
            slot = self._find(hashes)
        length = self.length[slot]
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = self.pool[np.repeat(self.at[slot] - total[:-1], length) + np.arange(total[-1])]
        rows = total[np.searchsorted(starts, offsets)]
        odd = np.flatnonzero(kinds == ODD)
        if len(odd):
            return self._replace(data, offsets, ids, rows, np.unique(np.searchsorted(offsets, odd, side="right") - 1))
        return ids, rows

    def _replace(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, rows: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the rows of ``odd`` encoded whole."""
        parts = [ids[rows[i] : rows[i + 1]] for i in range(len(rows) - 1)]
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in odd.tolist()]
        for i, e in zip(odd.tolist(), self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            parts[i] = np.array(e.ids, np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def little_endian(numbers: np.ndarray) -> np.ndarray:
    return numbers if sys.byteorder == "little" else numbers.byteswap()
