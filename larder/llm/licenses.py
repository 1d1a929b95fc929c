"""Find license statements by conditional compression.

A block of text that may state a license is compressed alone and with each template as a raw dictionary. Templates are
ranked by how much smaller the block gets, and all of them are confirmed, from the first on, by the words in which the
block differs from the template. A block goes on with what is left without the statement that was found, so that it can
state any number of licenses.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import columns as C

# Wording of public licenses and of the statements that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Fixed value: what a sentence has that may state a license.
CUE = r"(?i)licen[sc]e|copyright|permission|redistribut|warrant|creative commons|public domain|free software|\bCC[ -]BY\b"

#: Sentences after a cue that belong to its block, and the largest share of a template's words in which a long statement may
#: differ. Statements of less than 20 words must have all of them.
APART, DIFFERENT = 2, 0.05

_CUE = re.compile(CUE)
_SENTENCE = re.compile(r"[^\n.;:!?]*(?:[.;:!?](?![\s\"')\]]|$)[^\n.;:!?]*)*(?:[.;:!?]+[\"')\]]*|\n|\Z)", re.S)
_WORD = re.compile(r"[\w.+-]*\w")


def candidates(text: str) -> list[tuple[int, int]]:
    """Blocks of sentences that may state a license: from a sentence with a cue on, to a few sentences after the last one near it."""
    out: list[tuple[int, int]] = []
    gap = APART + 1
    at = 0
    while at < len(text):
        found = _SENTENCE.match(text, at)
        end = max(found.end(), at + 1)
        if _CUE.search(text, at, end):
            if gap <= APART and out:
                out[-1] = (out[-1][0], end)
            else:
                out.append((at, end))
            gap = 0
        elif text[at:end].strip():
            gap += 1
            if gap <= APART and out:
                out[-1] = (out[-1][0], end)
        at = end
    return out


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].casefold(), m.start(), m.end()) for m in _WORD.finditer(text)]


class Matcher:
    """Ranks templates for a block and compares all of them by words."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]]):
        self.templates = [(name, [w for w, _, _ in _words(t)], t.encode()) for name, texts in templates.items() for t in texts]
        self.counts = [Counter(own) for _, own, _ in self.templates]
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        settings = zstandard.ZstdCompressionParameters.from_level(6, **plain)
        self.alone = zstandard.ZstdCompressor(compression_params=settings)
        raw = [zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, _, t in self.templates]
        self.given = [zstandard.ZstdCompressor(compression_params=settings, dict_data=d) for d in raw]

    def reductions(self, block: bytes) -> list[float]:
        """For each template, the share of the block's compressed size that knowing the template saves."""
        alone = len(self.alone.compress(block))
        return [1 - len(c.compress(block)) / alone for c in self.given]

    def statements(self, block: str) -> list[tuple[int, int, str, float, int]]:
        """(start, end, license, reduction, words that differ) of the statements in a block, in order."""
        out = []
        words = _words(block)
        until = [s for _, s, _ in words[1:]] + [len(block)]
        left = [(w, s, e, u) for (w, s, e), u in zip(words, until)]
        while left:
            saved = self.reductions("".join(block[s:u] for _, s, _, u in left).encode())
            # Templates that save alike differ in length: the longer one says more.
            order = sorted(range(len(saved)), key=lambda i: (-round(saved[i], 2), -len(self.templates[i][1]), i))
            best = self._best(order, [w for w, _, _, _ in left])
            if best is None:
                break
            i, first, last, different = best
            out.append((left[first][1], left[last][2], self.templates[i][0], round(saved[i], 4), different))
            left = left[:first] + left[last + 1 :]
        return sorted(out)

    def _best(self, order: list[int], own: list[str]) -> tuple[int, int, int, int] | None:
        """Of all templates that fit the one with the most words in common, then the fewest that differ, then the first in the order."""
        best, most = None, (0, 0)
        counts = Counter(own)
        for i in order:
            size = len(self.templates[i][1])
            if size >= most[0] and (x := self._confirm(i, own, counts)) and (size - x[3], -x[3]) > most:
                best, most = x, (size - x[3], -x[3])
        return best

    def _confirm(self, i: int, own: list[str], counts: Counter[str]) -> tuple[int, int, int, int] | None:
        """Where the words of a template are, if they differ in few: (template, first word, last word, words missing or between)."""
        wanted = self.templates[i][1]
        most = int(DIFFERENT * len(wanted)) if len(wanted) >= 20 else 0
        if sum((self.counts[i] - counts).values()) > most:  # so many words aren't there in any order
            return None
        if not most:
            for k in range(len(own) - len(wanted) + 1):
                if own[k : k + len(wanted)] == wanted:
                    return i, k, k + len(wanted) - 1, 0
            return None
        found = None
        # A statement is whole in one of the overlapping stretches; what is alike elsewhere is in others.
        step = len(wanted) + most
        for at in range(0, max(1, len(own) - step), step):
            same = [b for b in SequenceMatcher(None, wanted, own[at : at + 2 * step], autojunk=False).get_matching_blocks() if b.size > 2]
            for x in range(len(same)):
                matched = 0
                for b in same[x:]:
                    matched += b.size
                    span = b.b + b.size - same[x].b
                    different = max(len(wanted) - matched, span - matched)
                    if different <= most and (found is None or different < found[3]):
                        found = i, at + same[x].b, at + b.b + b.size - 1, different
        return found


SCHEMA = "start long, length long, license string, reduction double, differences long"


def statements(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row for each license statement: doc_id, start and length in code points, license, reduction, differences.

    Texts without a cue, null or empty ones have no row; a text of any length is read whole. Repeated rows have the same
    rows each. Of templates that fit at one place the one with the most words in common is taken, with equally many the one that differs least. Other columns are left alone.
    """
    templates = dict(templates)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
        for batch, _, _ in C.slices(batches, "text"):
            known: dict[str, list[tuple[int, int, str, float, int]]] = {}
            row, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a, b in candidates(text or ""):
                    block = text[a:b]
                    if block not in known:
                        known[block] = matcher.statements(block)
                    for start, end, name, saved, different in known[block]:
                        row.append(i)
                        found.append((a + start, end - start, name, saved, different))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
            lists = zip(*found) if found else [[]] * len(kinds)
            out = [batch.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(list(x), k) for x, k in zip(lists, kinds)]]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").filter(F.col("text").rlike(CUE)).mapInArrow(rows, f"doc_id {kind}, {SCHEMA}")
