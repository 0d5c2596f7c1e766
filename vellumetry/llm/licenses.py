"""License scans by conditional compression.

Candidate blocks are runs of sentences or lines with words that licenses use. Each block is compressed
by zstandard alone and with each template as a raw dictionary; the templates are ranked by how much
their dictionary reduces the size. All in the rank whose size falls are compared by wording.
A template is the notices of a license, then its whole text where ``license_texts`` has it.

Wording is aligned in segments: stretches of the block in which at least MATCHED of the words are the
template's, in its order. A differing word that is a number or changes the terms ends a segment, and a
segment is cut back where the template's next word in the sentence is such a word, so "version 2" is
never half of "version 3". Dated copyright statements are left out of the comparison. A segment stands
if it is LONG words, or a whole sentence of the template, or MATCHED of the sentences it lies in with
wording that no other template has as well. Of segments that overlap, that with most wording stands, so
a block gives several licenses; neighbouring segments of one license are one row. Segments of one license
that stand in different blocks are one row too if MATCHED of the words between them are the template's, in its
order: so a whole license text, most of whose sentences hold no cue, is one row.

Defined results: null and empty texts have no blocks; repeated rows give their rows each; a document
without a confirmed segment gives no row; an empty table gives an empty result; of templates that save and match
as much the first by name stands; very long texts are scanned whole, block by block; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import difflib
import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices of licenses; their whole texts, where there are files, follow.
TEMPLATES = {
    "MIT": "Released under the MIT License. Licensed under the MIT License. The MIT License (MIT). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. Licensed under the GNU General Public License v3.0. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2. Licensed under the GNU General Public License v2.0. This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3. This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/. Licensed under the Mozilla Public License, version 2.0.",
    "ISC": "Licensed under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "Licensed under CC0 1.0. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Dedicated to the public domain.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
}
#: Full notices that the short wordings above stop in.
_NOTICES = {
    "GPL-3.0": "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-3.0": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Apache-2.0": "See the License for the specific language governing permissions and limitations under the License.",
}
for _name, _text in TEMPLATES.items():
    _file = Path(__file__).parent / "license_texts" / f"{_name}.txt"
    TEMPLATES[_name] = "\n\n".join([" ".join([_text, _NOTICES.get(_name, "")]).strip(), *([_file.read_text()] if _file.exists() else [])])

CUE = r"(?i)licen[cs]|copyright|permission is hereby|permission to use|redistribut|warrant|public domain|creative commons|free software"
_CUE = re.compile(CUE)
_PIECE = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*")
#: Words that change the terms when they differ, beside numbers.
DECISIVE = frozenset("not no non nc nd sa by lesser affero by-nc by-sa by-nd by-nc-sa by-nc-nd noncommercial noderivatives sharealike attribution-noncommercial attribution-sharealike mit apache gnu general bsd mozilla isc except".split())
MATCHED, GAP = 0.75, 8
#: Words of a segment that stand by themselves, and words of a whole sentence that does.
LONG, SENTENCE = 12, 4
_STATEMENT = re.compile(r"(?i)(?:copyright|\(c\)|\u00a9)[^\n]{0,16}?(?:[12][0-9]{3}|<year>)[^\n]*?(?=[.](?:\s|$)|\n|$|all rights|permission|licen[cs]ed|released|redistribution|this )")
_END = re.compile(r"[.!?:;](?=\s+[^0-9\s])|\n\s*\n")


def blocks_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of cue pieces with at most GAP others between them."""
    out: list[list[int]] = []
    since = GAP + 1
    for m in _PIECE.finditer(text):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if start == m.end():
            continue
        if _CUE.search(m[0]):
            if out and since <= GAP:
                out[-1][1] = m.end()
            else:
                out.append([start, m.end()])
            since = 0
        else:
            since += 1
    return [(a, b) for a, b in out]


@functools.lru_cache(maxsize=4)
def _compressors(templates: tuple[tuple[str, str], ...]):
    def made(text: str | None):
        d = {"dict_data": zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if text else {}
        return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **d)

    return made(None), {name: made(text) for name, text in templates}


def rank(block: str, templates: dict[str, str]) -> list[tuple[float, str]]:
    """(share of the size that the template's dictionary saves, name), largest first."""
    alone, given = _compressors(tuple(templates.items()))
    data = block.encode()
    size = len(alone.compress(data))
    return sorted(((1 - len(c.compress(data)) / size, name) for name, c in given.items()), key=lambda x: (-x[0], x[1]))


def _critical(word: str) -> bool:
    return word in DECISIVE or any(c.isdigit() for c in word)


def _words(text: str) -> tuple[list[str], list[tuple[int, int]], list[int]]:
    """(words in lower case, their places, the sentence of each), without dated copyright statements."""
    plain = _STATEMENT.sub(lambda m: " " * len(m[0]), text)
    found = list(_WORD.finditer(plain))
    ends = [m.end() for m in _END.finditer(plain)]
    return [m[0].lower() for m in found], [m.span() for m in found], [bisect_right(ends, m.start()) for m in found]


@functools.lru_cache(maxsize=1000)
def _template(text: str) -> tuple[list[str], list[int]]:
    words, _, sentence = _words(text)
    return words, sentence


def segments(block: list[str], template: list[str], sentence: list[int]) -> list[list[tuple[int, int, int]]]:
    """Runs (template place, block place, length) of each stretch of aligned wording."""
    chains: list[list[tuple[int, int, int]]] = []
    parts = [tuple(m) for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    for part in parts:
        if chains:
            i, j, n = chains[-1][-1]
            added, missing = block[j + n : part[1]], template[i + n : part[0]]
            joined = part[0] > i + n and sentence[i + n] == sentence[i + n - 1]
            if not any(map(_critical, added)) and not (joined and _critical(missing[0])):
                chains[-1].append(part)
                continue
        chains.append([part])
    cost, out = MATCHED / (1 - MATCHED), []
    for chain in chains:
        while chain:
            # The stretch of the chain with the largest matched - cost * added, then those before and after.
            best, at, total, first = 0.0, (0, 0), 0.0, 0
            for k, (_, j, n) in enumerate(chain):
                added = j - chain[k - 1][1] - chain[k - 1][2] if k else 0
                if total - cost * added <= 0:
                    total, first = 0.0, k
                else:
                    total -= cost * added
                total += n
                if total > best:
                    best, at = total, (first, k + 1)
            out.append(chain[at[0] : at[1]])
            chains.append(chain[: at[0]])
            chain = chain[at[1] :]
    return [s for s in (_whole(s, template, sentence) for s in out) if s]


def _whole(runs: list[tuple[int, int, int]], template: list[str], sentence: list[int]) -> list[tuple[int, int, int]]:
    """The segment without ends whose sentence goes on in the template with a word that decides."""
    while runs:
        i, j, n = runs[-1]
        end = i + n
        if end == len(template) or sentence[end] != sentence[end - 1] or not _critical(template[end]):
            break
        keep = [k for k in range(n) if sentence[i + k] != sentence[end - 1]]
        runs = [*runs[:-1], (i, j, len(keep))] if keep else runs[:-1]
        if keep:
            break
        while runs and sentence[runs[-1][0]] == sentence[end - 1]:
            runs = runs[:-1]
        if runs and sentence[runs[-1][0] + runs[-1][2] - 1] == sentence[end - 1]:
            i, j, n = runs[-1]
            runs = [*runs[:-1], (i, j, sum(sentence[i + k] != sentence[end - 1] for k in range(n)))]
    while runs:
        i, j, n = runs[0]
        if not i or sentence[i - 1] != sentence[i] or not _critical(template[i - 1]):
            break
        cut = sum(sentence[i + k] == sentence[i] for k in range(n))
        own = sentence[i]
        runs = [(i + cut, j + cut, n - cut), *runs[1:]] if cut < n else runs[1:]
        while runs and sentence[runs[0][0]] == own:
            i, j, n = runs[0]
            cut = sum(sentence[i + k] == own for k in range(n))
            runs = [(i + cut, j + cut, n - cut), *runs[1:]] if cut < n else runs[1:]
    return runs


def identify(block: str, templates: dict[str, str]) -> list[tuple[str, int, int, float, list[str], list[str]]]:
    """(license, start, end, saving, added, missing) of the block's confirmed segments, by start."""
    words, places, pieces = _words(block)
    found = []
    for order, (saving, name) in enumerate(rank(block, templates)):
        if saving <= 0:
            break
        template, sentence = _template(templates[name])
        for runs in segments(words, template, sentence):
            first, last = runs[0][1], runs[-1][1] + runs[-1][2]
            matched = sum(n for _, _, n in runs)
            if matched < 3:
                continue
            used = {j + k for _, j, n in runs for k in range(n)}
            spanned = {i + k for i, _, n in runs for k in range(n)}
            full: dict[int, int] = {}
            for i in spanned:
                full[sentence[i]] = full.get(sentence[i], 0) + 1
            low, high = runs[0][0], runs[-1][0] + runs[-1][2]
            complete = any(
                n >= SENTENCE and n == sentence.count(s) and (n >= LONG or any(_critical(template[i]) for i in spanned if sentence[i] == s)) for s, n in full.items()
            )
            around = sum(p in set(pieces[first:last]) for p in pieces)
            firm = matched >= LONG or complete
            if firm or matched >= MATCHED * around:
                added = [words[j] for j in range(first, last) if j not in used]
                missing = [template[i] for i in range(low, high) if i not in spanned]
                found.append((matched - len(added) * MATCHED / (1 - MATCHED), order, firm, first, last, name, saving, added, missing))
    taken: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[0], x[1])):
        shared = not x[2] and any(y[5] != x[5] and y[3] <= x[3] and x[4] <= y[4] and y[0] >= x[0] for y in found)
        if not shared and all(x[4] <= t[3] or t[4] <= x[3] for t in taken):
            taken.append(x)
    out: list[tuple] = []
    for _, _, _, first, last, name, saving, added, missing in sorted(taken, key=lambda t: t[3]):
        start, end = places[first][0], places[last - 1][1]
        if out and out[-1][0] == name:
            out[-1] = (name, out[-1][1], end, saving, out[-1][4] + added, out[-1][5] + missing)
        else:
            out.append((name, start, end, saving, added, missing))
    return out


#: Rows that a task turns to Python strings at a time.
ROWS = 256
#: Blocks that a task remembers, and the characters that all of them may have.
KNOWN, KNOWN_CHARS = 10_000, 8 << 20


class Known(dict):
    """Blocks and their segments, as many as KNOWN and KNOWN_CHARS allow."""

    chars = 0

    def put(self, block: str, hits: list[tuple]) -> None:
        if len(self) >= KNOWN or self.chars + len(block) > KNOWN_CHARS:
            self.clear()
            self.chars = 0
        if len(block) <= KNOWN_CHARS:
            self[block] = hits
            self.chars += len(block)


def _between(gap: str, template: str) -> list[str] | None:
    """What a gap between two segments has beside the template's wording; None if too much to be of the license."""
    words = _words(gap)[0]
    own, sentence = _template(template)
    # Every word of the template is matched once at most.
    if MATCHED * len(words) > len(own):
        return None
    used = {j + k for runs in segments(words, own, sentence) for _, j, n in runs for k in range(n)}
    return [w for j, w in enumerate(words) if j not in used] if len(used) >= MATCHED * len(words) else None


def _joined(text: str, hits: list[tuple], templates: dict[str, str]) -> list[tuple]:
    out: list[tuple] = []
    for hit in hits:
        more = _between(text[out[-1][2] : hit[1]], templates[hit[0]]) if out and out[-1][0] == hit[0] else None
        if more is None:
            out.append(hit)
        else:
            name, start, _, saving, added, missing = out[-1]
            out[-1] = (name, start, hit[2], max(saving, hit[3]), added + more + hit[4], missing + hit[5])
    return out


def licenses_in(text: str, known: Known, templates: dict[str, str]) -> list[tuple[str, int, int, float, list[str], list[str]]]:
    """The confirmed segments of a text. A long one that ends with its block is followed into the pieces after it."""

    def named(block: str) -> list[tuple]:
        hits = known.get(block)
        if hits is None:
            hits = identify(block, templates)
            known.put(block, hits)
        return hits

    out, blocks = [], blocks_of(text)
    for (start, end), (limit, _) in zip(blocks, [*blocks[1:], (len(text), 0)]):
        hits = named(text[start:end])
        if hits and len(_WORD.findall(text, start + hits[-1][2], end)) == 0 and len(_WORD.findall(text, start + hits[-1][1], end)) >= LONG:
            after = [m.end() for _, m in zip(range(GAP), _PIECE.finditer(text, end, limit))]
            more = named(text[start : after[-1]]) if after else []
            # What the longer block dilutes is not lost: only a segment that goes on replaces the block's own.
            if {h[0] for h in hits} <= {h[0] for h in more} and more[-1][2] > hits[-1][2]:
                hits = more
        out += [(name, start + a, start + b, *rest) for name, a, b, *rest in hits]
    return _joined(text, out, templates)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start, end, saving, added, missing): one row a confirmed segment."""
    templates = dict(templates or TEMPLATES)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for hit in licenses_in(text, known, templates):
                    at.append(i)
                    rows.append(hit)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "license", "start", "end", "saving", "added", "missing"])

    some = docs.select("doc_id", "text").where(F.col("text").rlike(CUE))
    return some.mapInArrow(work, f"doc_id {kind}, license string, start long, end long, saving double, added array<string>, missing array<string>")
