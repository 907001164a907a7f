"""Licence scan by conditional compression.

Cue words with the words around them, as many as the wordings are long, are candidate blocks. Each block is aligned word by
word with the templates that it has enough words of. The passage that an alignment spans is compressed alone
and with the template as zstandard raw dictionary: how much smaller it gets does not depend on the words around it. The best
template is confirmed if the passage gets smaller and has nearly all of the template's words in order; its
exact differences are returned. Its words are then taken out, and the rest is scanned until nothing is confirmed.

Defined results: null and empty texts have no findings; repeated rows are scanned each; a block is
named by code points, the end exclusive; so is the passage of a finding, as a block may have several.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a block must have, also across the ends of lines.
CUE = r"(?i)licen[sc]e|copyright|\bspdx\b|\bcc[ -]by|\bcc0\b|creative\W+commons|public\W+domain|permission\W+is\W+hereby|redistribution\W+and\W+use|as\W+is"
#: Least share of a template's words found in order; least size reduction of the passage.
WORDING, REDUCTION = 0.85, 0.15

# Wordings of licences and of the short notices that name them.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD (notice)": "Released under the BSD License.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT (notice)": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_PATTERN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_WORD, _WORDS = _PATTERN.findall, _PATTERN.finditer
_CUE = re.compile(CUE)


def words(text: str) -> list[str]:
    return _WORD(text.lower())


#: Words kept on each side of a cue: twice the longest wording, as there may be others in between.
REACH = 2 * max(len(words(t)) for t in TEMPLATES.values())


def blocks(text: str | None, reach: int = REACH) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks, in order."""
    if not text or not _CUE.search(text):
        return []
    starts, ends = zip(*((m.start(), m.end()) for m in _WORDS(text)))
    out: list[tuple[int, int]] = []
    for m in _CUE.finditer(text):
        lo = starts[max(bisect_right(starts, m.start()) - 1 - reach, 0)]
        hi = ends[min(bisect_left(ends, m.end()) + reach, len(ends) - 1)]
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def passage(template: list[str], block: list[str]) -> tuple[int, int] | None:
    """(first, last) of the block's words that an alignment with the template spans, the end exclusive."""
    same = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return None
    # A word far from the others may be there by chance: of the runs with enough words, the one with the least put in between.
    best = None
    for i, m in enumerate(same):
        found = 0
        for n in same[i:]:
            found += n.size
            score = 3 * found - (n.b + n.size - m.b)
            if found >= WORDING * len(template) and (best is None or score > best[0]):
                best = score, m.b, n.b + n.size
    return best[1:] if best else (same[0].b, same[-1].b + same[-1].size)


def compared(template: list[str], part: list[str]) -> tuple[float, str, list[int]]:
    """Share of the template's words found in order, what is missing (-) or put in between (+), and the places found."""
    ops = SequenceMatcher(None, template, part, autojunk=False).get_opcodes()
    found = [i for op, _, _, c, d in ops if op == "equal" for i in range(c, d)]
    said = [f"{s}{w}" for op, a, b, c, d in ops if op != "equal" for s, words in (("-", template[a:b]), ("+", part[c:d])) for w in words if w != GONE]
    return len(found) / len(template), " ".join(said), found


def differences(template: list[str], block: list[str]) -> tuple[float, str]:
    """Share of the template's words found in order, and what is missing (-) or put in between (+)."""
    at = passage(template, block)
    return compared(template, block[slice(*at)])[:2] if at else (0.0, "")


#: (template, reduction, wording, differences, places of the words found)
Finding = tuple[str, float, float, str, list[int]]
#: What stands for a word that an earlier finding has.
GONE = ""


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        import zstandard as z

        self.words = {k: w for k, t in templates.items() if (w := words(t))}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.half = max(1000, 8 * max(map(len, self.words.values()), default=0))
        self.alone = z.ZstdCompressor(level=9, write_content_size=False)
        self.given = {}
        for k, w in self.words.items():
            known = z.ZstdCompressionDict(" ".join(w).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            self.given[k] = z.ZstdCompressor(level=9, dict_data=known, write_content_size=False)

    def reduction(self, name: str, part: list[str]) -> float:
        """How much smaller the passage gets by the template."""
        raw = " ".join(part).encode()
        return 1 - len(self.given[name].compress(raw)) / len(self.alone.compress(raw))

    def candidate(self, name: str, block: list[str]) -> tuple[tuple[float, float], Finding] | None:
        """(rank, finding) of the template's best passage."""
        template = self.words[name]
        first, last = passage(template, block)
        wording, said, places = compared(template, block[first:last])
        reduction = self.reduction(name, block[first:last])
        if reduction < REDUCTION or wording < WORDING:
            return None
        # All of a longer wording says more than all of a shorter one.
        return (round(wording * len(template)) - len(said.split()), reduction), (name, reduction, wording, said, [first + i for i in places])

    def within(self, block: list[str]) -> Iterator[Finding]:
        """Findings, best first; the words of one are taken out of the block before the next."""
        rest, have, known = list(block), Counter(block), {}
        while True:
            for name, template in self.words.items():
                # No alignment finds more words than the block has of the template's.
                if name not in known and (have & self.counts[name]).total() >= WORDING * len(template):
                    known[name] = self.candidate(name, rest)
            if not any(known.values()):
                return
            finding = max((c for c in known.values() if c), key=lambda c: c[0])[1]
            yield finding
            gone = set(finding[-1])
            for i in gone:
                have[rest[i]] -= 1
                rest[i] = GONE
            # What had none of these words, and was confirmed, stays as it is.
            known = {k: c for k, c in known.items() if c and gone.isdisjoint(c[1][-1])}

    def findings(self, block: list[str]) -> list[Finding]:
        """All findings of a block, in order; long blocks in windows that overlap by half."""
        rest, out = list(block), []
        for lo in range(0, max(len(rest) - self.half, 1), self.half):
            final = lo + 2 * self.half >= len(rest)
            for *finding, places in self.within(rest[lo : lo + 2 * self.half]):
                # One that begins in the second half may go on: it belongs to the next window.
                if final or places[0] < self.half:
                    out.append((*finding, [lo + i for i in places]))
                    for i in places:
                        rest[lo + i] = GONE
        return sorted(out, key=lambda f: (f[-1][0], f[0]))


_SCHEMA = "doc_id long, start long, end long, license string, reduction double, wording double, differences string, found_start long, found_end long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per finding: (doc_id, start, end, license, reduction, wording, differences, found_start, found_end)."""
    given = templates or TEMPLATES
    reach = 2 * max(len(words(t)) for t in given.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in blocks(text, reach):
                    spans = [(m.start(), m.end()) for m in _WORDS(text, a, b)]
                    for *got, places in scanner.findings([text[i:j].lower() for i, j in spans]):
                        out.append((key, a, b, *got, spans[places[0]][0], spans[places[-1]][1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    text = F.col("text").cast("string")
    # Most texts have no cue and don't leave the JVM.
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).where(F.col("text").rlike(CUE)).mapInArrow(run, _SCHEMA)
