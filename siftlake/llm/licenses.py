"""License scans: an exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of words, of several lengths: a template is sought in blocks twice as long as
its own length rounded up to a power of two times 40 words, so some block holds all of it. A block matches a template
if it contains at least the template's share of its distinct words. Words are ordered by how many documents of the corpus hold them, rarest first; then a
match must have a word in common among the first few of both (prefix filter), the block must have enough words at
all (length filter), and what stands after a common word in both orders must suffice for the rest (positional
filter). What passes is counted in full, and finally checked in the text itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.cluster import ship

#: A-Z lower-cased; of ASCII, all but letters and digits separates words.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
#: Blocks are twice their stride long, so every run of at most stride + 1 words lies in one. The least stride.
STRIDE = 40
CONTAINMENT = 0.8


@dataclass(frozen=True)
class Template:
    """``share`` of the distinct words must be in a block, among them all of ``needs``; ``phrase``: as a phrase."""

    label: str
    text: str
    share: float = CONTAINMENT
    needs: tuple[str, ...] = ()
    phrase: bool = False

    @property
    def words(self) -> tuple[bytes, ...]:
        return tuple(words_of(self.text))

    @property
    def stride(self) -> int:
        stride = STRIDE
        while stride + 1 < len(self.words):
            stride *= 2
        return stride


PHRASES = (
    Template("cc-by", "cc by", 1.0, phrase=True),
    Template("gpl", "general public license", 1.0, phrase=True),
    Template("reserved", "all rights reserved", 1.0, phrase=True),
)
#: Customary notices, by SPDX-like labels of their own.
NOTICES = (
    Template("mit", "released under the mit license", needs=("mit", "license")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "licensed under the apache license version 2 0", needs=("apache", "license")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", needs=("gnu", "license", "3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", needs=("gnu", "license", "2")),
    Template("lgpl", "licensed under the gnu lesser general public license", needs=("gnu", "lesser")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", needs=("cc", "nc")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", needs=("cc", "sa")),
    Template("creative-commons", "licensed under a creative commons attribution license", needs=("creative", "commons")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", needs=("mozilla", "license")),
    Template("no-warranty", "the software is provided as is without warranty of any kind express or implied", needs=("warranty",)),
)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_WARRANTY = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"""
#: Whole public license texts and the notices that licenses ask for, in their customary wording.
LICENSES = (
    Template("mit", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    Template("bsd-2-clause", f"{_BSD_CONDITIONS} {_BSD_WARRANTY}"),
    Template("bsd-3-clause", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_WARRANTY}", needs=("neither", "endorse")),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    ),
    Template(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    Template(
        "gpl-3.0",
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program {_GNU_WARRANTY} General Public License for more details.""",
        needs=("3",),
    ),
    Template(
        "gpl-2.0",
        f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. This program {_GNU_WARRANTY} General Public License for more details.""",
        needs=("2",),
    ),
    Template(
        "lgpl",
        f"""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library {_GNU_WARRANTY} Lesser General Public License for more details.""",
        needs=("lesser",),
    ),
    Template(
        "agpl-3.0",
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program {_GNU_WARRANTY} Affero General Public License for more details.""",
        needs=("affero",),
    ),
    Template(
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    Template(
        "cc-by-4.0",
        """You are free to: Share, copy and redistribute the material in any medium or format for any purpose, even
        commercially. Adapt, remix, transform, and build upon the material for any purpose, even commercially. The licensor
        cannot revoke these freedoms as long as you follow the license terms. Attribution: You must give appropriate credit,
        provide a link to the license, and indicate if changes were made.""",
    ),
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Index:
    """Templates of one stride by the words of their prefixes."""

    def __init__(self, templates: tuple[Template, ...], frequencies: dict[bytes, int]) -> None:
        self.templates = templates
        self.stride = max((t.stride for t in templates), default=STRIDE)
        universe = sorted({w for t in templates for w in t.words}, key=lambda w: (frequencies.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(universe)}
        self.sets = [sorted({self.rank[w] for w in t.words}) for t in templates]
        self.least = [math.ceil(t.share * len(s) - 1e-9) for t, s in zip(templates, self.sets)]
        self.needs = [{self.rank[n.encode()] for n in t.needs} for t in templates]
        self.phrases = [[self.rank[w] for w in t.words] for t in templates]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for number, (members, least) in enumerate(zip(self.sets, self.least)):
            for place, rank in enumerate(members[: len(members) - least + 1]):
                self.postings.setdefault(rank, []).append((number, place))
        self.starts = np.zeros(len(universe) + 1, bool)
        self.starts[list(self.postings)] = True

    def matches(self, block: list[int]) -> list[tuple[int, int]]:
        """Templates whose share is in the block's distinct ranks (ascending), with the number of common words."""
        open_: dict[int, int] = {}
        for j, rank in enumerate(block):
            for number, i in self.postings.get(rank, ()):
                least = self.least[number]
                if len(block) < least or j > len(block) - least:
                    continue
                common = open_.get(number, 0) + 1
                if common + min(len(self.sets[number]) - i, len(block) - j) - 1 >= least:
                    open_[number] = common
        held = set(block)
        counted = [(number, len(held.intersection(self.sets[number]))) for number in open_]
        return [(number, n) for number, n in counted if n >= self.least[number] and self.needs[number] <= held]

    def scan(self, words: list[bytes]) -> dict[int, list[tuple[int, float]]]:
        """Places of phrases (word of their start, 1.0) and of notices (word of the block's start, share)."""
        get, none = self.rank.get, len(self.rank)
        ranks = np.fromiter((get(w, none) for w in words), np.int32, len(words))
        near = np.flatnonzero(self.starts[ranks])
        found: dict[int, list[tuple[int, float]]] = {}
        own = np.unique(near // self.stride)
        for number in np.unique(np.concatenate([own, own[own > 0] - 1])):
            at = int(number) * self.stride
            block = ranks[at : at + 2 * self.stride]
            held = np.unique(block)
            for template, n in self.matches(held[held < none].tolist()):
                if self.templates[template].phrase:
                    for start in self._places(block, self.phrases[template]):
                        if start < self.stride:  # later ones are the next block's
                            found.setdefault(template, []).append((at + start, 1.0))
                else:
                    found.setdefault(template, []).append((at, n / len(self.sets[template])))
        return found

    @staticmethod
    def _places(block: np.ndarray, phrase: list[int]) -> list[int]:
        n = len(block) - len(phrase) + 1
        if n <= 0:
            return []
        same = np.ones(n, bool)
        for i, rank in enumerate(phrase):
            same &= block[i : i + n] == rank
        return np.flatnonzero(same).tolist()


@lru_cache(maxsize=4)
def indexes(templates: tuple[Template, ...], frequencies: tuple[tuple[bytes, int], ...]) -> list[tuple[list[int], Index]]:
    """An index for each stride, with the numbers of its templates."""
    out = []
    for stride in sorted({t.stride for t in templates}):
        numbers = [i for i, t in enumerate(templates) if t.stride == stride]
        out.append((numbers, Index(tuple(templates[i] for i in numbers), dict(frequencies))))
    return out


def scan_words(joined: list[tuple[list[int], Index]], words: list[bytes]) -> dict[int, list[tuple[int, float]]]:
    return {numbers[t]: places for numbers, index in joined for t, places in index.scan(words).items()}


def _count(universe: frozenset[bytes]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(universe.intersection(words_of(text)))
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([total[w] for w in names], pa.int64())], names=["word", "n"])

    return count


def frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[tuple[bytes, int], ...]:
    """In how many documents of the whole corpus each word of the templates stands."""
    ship(docs.sparkSession)
    universe = frozenset(w for t in templates for w in t.words)
    counts = docs.select("text").mapInArrow(_count(universe), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return tuple(sorted((bytes(r.word), r.n) for r in counts.collect()))


SCAN_SQL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, spans array<struct<label:string,word:long,share:double>>"
)
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))


def _scan(templates: tuple[Template, ...], counted: tuple[tuple[bytes, int], ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = indexes(templates, counted)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = scan_words(joined, words)
                spans = sorted((at, templates[t].label, share) for t, places in found.items() for at, share in places)
                base = sorted(at for t, places in found.items() if templates[t].phrase for at, _ in places)
                base_labels = sorted({templates[t].label for t in found if templates[t].phrase})
                labels = sorted({templates[t].label for t in found})
                rows.append(
                    (
                        len(words),
                        len(base),
                        base[0] if base else None,
                        base[-1] if base else None,
                        ",".join(base_labels),
                        ",".join(labels),
                        max((share for _, _, share in spans), default=0.0),
                        [{"label": label, "word": at, "share": share} for at, label, share in spans],
                    )
                )
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
            columns = list(zip(*rows)) or [()] * len(types)
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return scan


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES + LICENSES) -> DataFrame:
    """One row per document, with its labels and ``spans``: label, word (of a phrase's start, or of the block) and share.

    A null text has no words; a document without a match has empty labels, null words and score 0. ``score`` is
    the largest share of a template found. Repeated rows get equal results; an empty table an empty one. The
    templates are the broadcast side: they and the counts of their words are of fixed size. Only doc_id and text are read.
    """
    counted = frequencies(docs, templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(templates, counted), SCAN_SQL)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses of all of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
