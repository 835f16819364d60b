"""License scan: MinHash bands over overlapping windows, verified by exact shingle containment.

Texts and templates are sequences of words (lower case; ASCII punctuation separates words); a
shingle is ``SHINGLE`` words, or a whole template that has fewer. Templates are dealt into classes
by their number of shingles: class c takes up to 2**c. On class c a text has windows of 2**c
shingles every 2**c / 4, twice: a template of at least half a window shares, wherever it stands,
3/4 of itself or more with some window. A band is one minimum of a random permutation. A template
that is found to 0.8 then agrees with that window to a Jaccard similarity of 0.3 or more (0.6 of
half a window, out of a window), so that one of ``BANDS`` = 24 bands meets with a probability of at
least 1 - 0.7**24 = 0.9998; a template found whole, of the window's size, has at least 1 - 0.4**24.
Where a band meets, the share of the template's shingles among the words around is counted exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .word_hash import plain_words, runs

SHINGLE = 5
LEAST = 0.8
#: Bytes of templates that may go to every task.
MOST_BYTES = 1 << 25
BANDS = 24
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)

#: The words of licenses and of statements that name one.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        'provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND '
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        'BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."
    ),
}


def shingles(words: list, size: int) -> set[tuple]:
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def containment(template: list, words: list) -> float:
    """Share of the template's shingles that ``words`` have; 0 for a template without words."""
    size = min(SHINGLE, len(template))
    own = shingles(template, size) if size else set()
    return len(own & shingles(words, size)) / len(own) if own else 0.0


def _shingle_hashes(hashes: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle at each word; the highest value where a text has no whole shingle."""
    out = hashes.copy()
    for k in range(1, size):
        out[:-k] = (out[:-k] ^ (out[:-k] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k:]
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(hashes))
    out[left < size] = _FAR
    return out


def _permutations() -> np.ndarray:
    return np.random.default_rng(23).integers(1, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = (h ^ odd) * odd
    x ^= x >> np.uint64(32)
    x[h == _FAR] = _FAR
    return x


@dataclass
class _Class:
    """Templates of one shingle size and window: for each band the minima and their templates."""

    size: int
    log: int
    names: list[int] = field(default_factory=list)
    minima: list = field(default_factory=list)


class Templates:
    """What every task needs of the templates; their number bounds its size."""

    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        self.words = [plain_words(t) for t in texts.values()]
        self.classes: dict[tuple[int, int], _Class] = {}
        sets: dict[tuple[int, int], list[np.ndarray]] = {}
        for k, words in enumerate(self.words):
            if not words:
                continue
            size = min(SHINGLE, len(words))
            (_, hashes, n), = runs([" ".join(words)])
            own = np.unique(_shingle_hashes(hashes, n, size)[: len(words) - size + 1])
            key = (size, int(np.ceil(np.log2(len(own)))))
            self.classes.setdefault(key, _Class(*key)).names.append(k)
            sets.setdefault(key, []).append(own)
        for key, c in self.classes.items():
            for odd in _permutations():
                low = np.array([_mixed(own, odd).min() for own in sets[key]])
                order = np.argsort(low)
                c.minima.append((low[order], np.array(c.names)[order]))

    def candidates(self, hashes: np.ndarray, lengths: np.ndarray):
        """(word, template, words of the window) wherever a band meets."""
        found: set[tuple[int, int, int]] = set()
        for size in sorted({c.size for c in self.classes.values()}):
            own = sorted((c for c in self.classes.values() if c.size == size), key=lambda c: c.log)
            plain = _shingle_hashes(hashes, lengths, size)
            bands = _permutations() if own[-1].log else _permutations()[:1]  # equal sets of one need one
            for band, odd in enumerate(bands):
                low, log = _mixed(plain, odd), 0
                for c in own:
                    while log < c.log:
                        step = 1 << log
                        low[:-step] = np.minimum(low[:-step], low[step:])
                        log += 1
                    stride = max(1, (1 << log) >> 2)
                    at = low[::stride]
                    minima, names = c.minima[band]
                    near = np.minimum(np.searchsorted(minima, at), len(minima) - 1)
                    for p in np.flatnonzero(minima[near] == at):
                        k = int(near[p])
                        while k < len(minima) and minima[k] == at[p]:
                            found.add((int(p) * stride, int(names[k]), (1 << log) + size))
                            k += 1
        return sorted(found)


def _scan(shared, least: float):
    @lean
    def run(batches):
        templates: Templates = shared.value
        for batch in batches:
            texts = batch["text"].to_list()
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for rows, hashes, lengths in runs(texts):
                ends = np.cumsum(lengths)
                words_of: dict[int, list[str]] = {}
                for at, name, width in templates.candidates(hashes, lengths):
                    doc = int(np.searchsorted(ends, at, side="right"))
                    row, first = int(rows[doc]), int(ends[doc] - lengths[doc])
                    if doc not in words_of:
                        words_of[doc] = plain_words(texts[row])
                    n = len(templates.words[name])
                    lo = max(0, at - first - n)
                    share = containment(templates.words[name], words_of[doc][lo : at - first + width + n])
                    if share >= least and share > best.get((row, name), (0.0, 0))[0]:
                        best[row, name] = (share, lo)
            keys = sorted(best)
            yield pd.DataFrame(
                {
                    "id": batch["id"].iloc[[k[0] for k in keys]].to_numpy(),
                    "license": pd.Series([templates.names[k[1]] for k in keys], dtype=object),
                    "containment": [best[k][0] for k in keys],
                    "word_start": [best[k][1] for k in keys],
                }
            )

    return run


def read_templates(rows: DataFrame) -> dict[str, str]:
    """Texts by name out of ``rows(name, text)``, whose size is checked before anything is collected. Rows with
    a null are left out, equal ones count once, and different texts of one name are numbered (``name#2``)."""
    known = rows.where("name is not null and text is not null").select("name", "text").distinct()
    size = known.agg(F.sum(F.octet_length("name") + F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"templates of {size} bytes, of which {MOST_BYTES} may go to every task")
    out: dict[str, str] = {}
    for name, text in sorted(known.collect()):
        n = 1
        while (key := name if n == 1 else f"{name}#{n}") in out:
            n += 1
        out[key] = text
    return out


def scan(
    docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text: str = "text", least: float = LEAST
) -> DataFrame:
    """A row for each document row and template found in it: the id, ``license``, ``containment`` (the
    best share of the template's shingles in one place) and ``word_start`` (from where it was counted).

    Null, empty and blank texts and templates without words match nothing. Repeated rows give their
    rows again; rows with a null id return a null id. An empty table gives an empty result. Other
    columns are ignored; ids may have any type. ``templates`` (texts by name, or a table of ``name`` and
    ``text``) go to every task, so they may have ``MOST_BYTES`` at most; more raise."""
    texts = TEMPLATES if templates is None else read_templates(templates) if isinstance(templates, DataFrame) else templates
    if sum(len(t.encode()) for t in texts.values()) > MOST_BYTES:
        raise ValueError(f"templates of more than {MOST_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(Templates(texts))
    plain = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = f"id {plain.schema['id'].dataType.simpleString()}, license string, containment double, word_start long"
    return plain.mapInPandas(_scan(shared, least), schema).withColumnRenamed("id", id_col)
