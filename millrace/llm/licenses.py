"""License scans as an exact set-similarity join between text blocks and templates."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes that are not part of a word become spaces; words are runs of digits, a-z and bytes from 0x80 on.
SPACED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The phrases whose places are counted, with their labels.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

#: Openings of public license notices, with the labels that the block search gives.
NOTICES = (
    ("agpl-notice", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-program-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-notice", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Whole texts of short public licenses and file notices, with the labels that the block search gives.
BODIES = (
    (
        "apache-2.0-file",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd-3-body",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
        "AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "gpl-file",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "isc-body",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "mit-body",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "unlicense-body",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain.",
    ),
    (
        "zlib-body",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
)

#: Templates looked for in one pass over the documents; more are dealt to more passes.
TEMPLATES_A_PASS = 2000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float
    #: A phrase also asks for its words one after another; its places are counted.
    phrase: bool = False


def templates(threshold: float = 0.8) -> list[Template]:
    return [Template(label, text, 1.0, True) for label, text in PHRASES] + [Template(label, text, threshold) for label, text in NOTICES + BODIES]


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(SPACED).split()


def token_counts(docs: DataFrame, tokens: frozenset[bytes], text_col: str) -> dict[bytes, int]:
    """In how many documents each template token stands: counts over all documents, a row for each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in C.texts(batch.column(0)):
                seen.update(tokens.intersection(words_of(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    counts = docs.select(C.quoted(text_col)).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in counts.collect()}


class Index:
    """Prefixes of the templates' token sets in the global order, rarest token first."""

    def __init__(self, found: list[Template], counts: dict[bytes, int]):
        sequences = [words_of(t.text) for t in found]
        self.rank = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}, key=lambda w: (counts.get(w, 0), w)))}
        self.vocabulary = frozenset(self.rank)
        self.templates = []
        self.starts: dict[bytes, list[tuple[int, int]]] = {}
        for k, (template, sequence) in enumerate(zip(found, sequences, strict=True)):
            tokens = sorted(set(sequence), key=self.rank.__getitem__)
            need = max(1, math.ceil(template.threshold * len(tokens) - 1e-9))
            self.templates.append((template, sequence, tokens, need))
            for i, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.starts.setdefault(token, []).append((k, i))
        self.prefixes = frozenset(self.starts)

    def blocks(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, end word, containment) of each block that meets its template's threshold.

        A template of n words is held against the blocks of 2n words that start at multiples of n, so that any n
        consecutive words lie in one of them.
        """
        if self.prefixes.isdisjoint(words):
            return
        places = [i for i, w in enumerate(words) if w in self.vocabulary]
        seen: set[tuple[int, int]] = set()
        for at in places:
            for k, i in self.starts.get(words[at], ()):
                _, sequence, tokens, need = self.templates[k]
                step = len(sequence)
                for block in (at // step - 1, at // step):
                    if block < 0 or (k, block) in seen:
                        continue
                    lo, hi = block * step, (block + 2) * step
                    inside = sorted({words[j] for j in places[bisect_left(places, lo) : bisect_left(places, hi)]}, key=self.rank.__getitem__)
                    if len(inside) < need:  # length filter
                        seen.add((k, block))
                        continue
                    j = bisect_left([self.rank[w] for w in inside], self.rank[words[at]])
                    if 1 + min(i, j) + min(len(tokens) - i, len(inside) - j) - 1 < need:  # positional filter
                        continue
                    seen.add((k, block))
                    common = len(set(inside).intersection(tokens))
                    if common >= need:
                        yield k, lo, min(hi, len(words)), common / len(tokens)


FIELDS = [C.field(n, k) for n, k in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("blocks", C.structs(label="string", first_word="long", end_word="long", containment="double")))]


def scanner(index: Index) -> Callable[[str], tuple]:
    def scan(text: str) -> tuple:
        words = words_of(text)
        base: set[str] = set()
        labels: set[str] = set()
        places: set[tuple[int, int]] = set()
        blocks, score = [], 0.0
        for k, lo, hi, containment in index.blocks(words):
            template, sequence, _, _ = index.templates[k]
            if template.phrase:
                own = [i for i in range(lo, hi - len(sequence) + 1) if words[i : i + len(sequence)] == sequence]
                if not own:
                    continue
                places.update((k, i) for i in own)
                base.add(template.label)
            labels.add(template.label)
            blocks.append({"label": template.label, "first_word": lo, "end_word": hi, "containment": containment})
            score = max(score, containment)
        at = [i for _, i in places]
        return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(blocks, key=lambda b: (b["first_word"], b["label"]))

    return scan


def license_scan(docs: DataFrame, found: list[Template] | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Find every block of a text that holds at least a template's threshold of its token set, by prefix filtering.

    Adds n_words; n_base, first_word and last_word (places where a phrase stands word for word: how many, and the
    smallest and largest start; null if none); base_labels and labels (distinct, sorted, comma-joined; "" if none);
    score (the largest containment, 0 if none) and blocks (label, first_word, end_word, containment). Columns of
    `docs` with these names are replaced. A null text is empty and matches nothing; repeated rows are scanned one
    by one; an empty table gives an empty one. Tokens are ordered by the number of all documents that hold them.
    Templates go to the tasks in lists of at most TEMPLATES_A_PASS; a longer list takes several passes.
    """
    found = templates() if found is None else found
    if len(found) > TEMPLATES_A_PASS:
        parts = [found[i : i + TEMPLATES_A_PASS] for i in range(0, len(found), TEMPLATES_A_PASS)]
        held = C.unused(docs, "passes")
        for part in parts[:-1]:
            docs = merged(license_scan(docs, part, text_col), docs.columns, held)
        return finished(license_scan(docs, parts[-1], text_col, [*docs.columns]), keep, held)
    counts = token_counts(docs, frozenset(w for t in found for w in words_of(t.text)), text_col)
    index = Index(found, counts)
    return C.map_text(docs, lambda: scanner(index), FIELDS, text_col, keep)


def merged(scanned: DataFrame, columns: list[str], held: str) -> DataFrame:
    """Carry one pass's findings beside the documents, as an array under a name of its own."""
    own = F.struct(*[f.name for f in FIELDS])
    earlier = C.quoted(held) if held in columns else F.array().cast(scanned.select(F.array(own)).schema[0].dataType)
    kept = [c for c in columns if c != held]
    return scanned.select(*[C.quoted(c) for c in kept], F.concat(earlier, F.array(own)).alias(held))


def finished(scanned: DataFrame, keep: list[str] | None, held: str) -> DataFrame:
    """Join the findings of several passes."""
    every = F.concat(C.quoted(held), F.array(F.struct(*[f.name for f in FIELDS])))
    kept = [c for c in scanned.columns if c not in {f.name for f in FIELDS} | {held} and (keep is None or c in keep)]
    own = C.unused(scanned, "all")

    def joined(name: str):
        parts = F.flatten(F.transform(C.quoted(own), lambda x: F.split(x[name], ",")))
        return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ",").alias(name)

    def least(name: str, of: Callable) -> object:
        return of(F.transform(C.quoted(own), lambda x: x[name])).alias(name)

    return scanned.withColumn(own, every).select(
        *[C.quoted(c) for c in kept], least("n_words", F.array_max), F.aggregate(C.quoted(own), F.lit(0).cast("long"), lambda a, x: a + x["n_base"]).alias("n_base"),
        least("first_word", F.array_min), least("last_word", F.array_max), joined("base_labels"), joined("labels"), least("score", F.array_max),
        F.flatten(F.transform(C.quoted(own), lambda x: x["blocks"])).alias("blocks"),
    )
