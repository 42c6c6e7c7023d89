"""License scans: texts aligned with license templates by patience alignment.

Words are runs of characters other than ASCII punctuation, space and control
characters, with A-Z lower-cased.  Every template has an identifying phrase: the
consecutive words in which it differs from its relatives (a notice for another
license has most of its words).  A license is reported only where that phrase
stands word for word, so the phrase's occurrences are the first anchors, looked
up in whole texts: what a text's length or a passage's place is does not matter.

Around each occurrence the template's words before and after the phrase are
aligned with the words beside it, up to the template's length further out than
expected, so a passage may hold insertions of that length on either side.  An
alignment keeps common ends, anchors at the words that occur once in both sides,
takes the longest increasing run of anchors and goes on in the gaps between
them; a gap without such a word is split at its longest common run.

The coverage is the share of a template's words that its best occurrence
matches; a license is reported from ``least`` on.  An occurrence with fewer words
out of the template's vocabulary than that needs is not aligned, which loses
nothing.  The templates are a small set that travels with the task; texts are
whole and are scanned where they are read, so nothing is shuffled.

Defined cases: null and empty texts have no words and no license; repeated rows
are scanned each; a null id is kept; a template without words is never
reported; a template whose phrase is missing or no part of it is an error; no
templates report nothing; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .wordhash import Words, slices

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed values of the registered query: the wording of common notices and license texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header":
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY": "Licensed under CC BY 4.0.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "ISC":
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
        "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
}

#: Each template's identifying phrase.
PHRASES = {
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "Apache-2.0-header": "Apache License, Version 2.0",
    "BSD": "BSD License",
    "BSD-2-Clause": "provided with the distribution. THIS SOFTWARE IS PROVIDED BY",
    "CC-BY": "CC BY 4.0",
    "CC-BY-NC": "CC BY-NC 4.0",
    "CC-BY-SA": "CC BY-SA 4.0",
    "GPL": "GNU General Public License, version 3",
    "GPL-2.0": "GNU General Public License, version 2",
    "ISC": "distribute this software for any purpose with or without fee",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MIT": "MIT License",
    "MIT-text": "to deal in the Software without restriction",
    "MPL-2.0": "Mozilla Public License, Version 2.0",
}


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience sorting)."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k:k + 1], at[k:k + 1] = [v], [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _longest_run(a: list, b: list) -> tuple[int, int, int]:
    best, ends = (0, 0, 0), {}
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    for j, x in enumerate(b):
        ends = {i: ends.get(i - 1, 0) + 1 for i in where.get(x, ())}
        for i, n in ends.items():
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
    return best


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        once = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        if once:
            anchors = [once[k] for k in _increasing([j for _, j in once])]
        else:
            i, j, n = _longest_run(a[a0:a1], b[b0:b1])
            anchors = [(a0 + i + k, b0 + j + k) for k in range(n)]
        if anchors:
            out += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:]) if k > i + 1 and m > j + 1]
    return sorted(out)


class _Template:
    """A template's words around its identifying phrase (``at`` to ``to``)."""

    def __init__(self, name: str, words: np.ndarray, phrase: np.ndarray, least: float):
        self.name, self.phrase, self.size, self.vocabulary = name, phrase, len(words), np.unique(words)
        self.need = max(1, int(np.ceil(least * len(words) - 1e-9)))
        self.at = next((i for i in range(len(words) - len(phrase) + 1) if (words[i:i + len(phrase)] == phrase).all()), -1)
        if self.at < 0 or not len(phrase):
            raise ValueError(f"the identifying phrase of {name} is no part of it")
        self.to = self.at + len(phrase)
        self.before, self.after = words[:self.at].tolist(), words[self.to:].tolist()

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where the phrase begins, at any position, also across texts."""
        last = len(words) - len(self.phrase) + 1
        at = np.flatnonzero(words[:max(0, last)] == self.phrase[0])
        for k, x in enumerate(self.phrase[1:], 1):
            at = at[words[at + k] == x]
        return at

    def best(self, words: np.ndarray, places: np.ndarray) -> tuple[int, int]:
        """(matched words, first of them) of the first best occurrence in a text; (0, 0) if none matches what is needed."""
        top = (0, 0)
        for q in places.tolist():
            end = q + len(self.phrase)
            lo, hi = max(0, q - self.at - self.size), min(len(words), q + 2 * self.size - self.at)
            most = len(self.phrase) + sum(min(len(side), int(np.isin(near, self.vocabulary).sum()))
                                          for side, near in ((self.before, words[lo:q]), (self.after, words[end:hi])))
            if most < self.need or most <= top[0]:
                continue
            left = align(self.before, words[lo:q].tolist())
            n = len(left) + len(self.phrase) + len(align(self.after, words[end:hi].tolist()))
            if n >= self.need and n > top[0]:
                top = n, lo + left[0][1] if left else q
            if n == self.size:
                break
        return top


def scan_licenses(docs: DataFrame, templates: dict[str, str], phrases: dict[str, str], id_col: str = "doc_id",
                  text_col: str = "text", least: float = 0.8) -> DataFrame:
    """Per row: id, n_words, licenses (names, sorted, joined by commas), license, coverage, first_word (of the best; null if none).

    ``phrases`` names each template's identifying phrase, consecutive words of the template that must stand in the text.
    The best license is the one of highest coverage, then of most words, then the first by name.
    """
    import pyarrow as pa

    spark, names = docs.sparkSession, sorted(templates)
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), _GAP, " ")
    chosen = docs.select(F.col(id_col), plain(F.col(text_col)).alias("text"))
    pairs = [(x, templates[x], phrases.get(x)) for x in names]
    made = (spark.createDataFrame(pairs, "name string, text string, phrase string")
            .select("name", plain(F.col("text")), plain(F.col("phrase"))).collect() if pairs else [])
    # A bounded set: the templates' word hashes travel with the task.
    words_of = lambda text: Words(pa.array([text]), lower=True).hash
    sets = [_Template(name, words_of(text), words_of(phrase), least) for name, text, phrase in made if len(words_of(text))]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                words, rows = Words(batch.column(1), lower=True), []
                found: dict[int, list] = {}
                for t in sets:
                    at = t.places(words.hash)
                    text = np.searchsorted(words.first, at, side="right") - 1
                    inside = at + len(t.phrase) <= words.first[text + 1]
                    at, text = at[inside], text[inside]
                    for i in np.unique(text).tolist():
                        lo, hi = words.first[i], words.first[i + 1]
                        n, first = t.best(words.hash[lo:hi], at[text == i] - lo)
                        if n:
                            found.setdefault(i, []).append((n / t.size, t.size, t.name, first))
                for i, n in enumerate(words.count.tolist()):
                    of_text = found.get(i, ())
                    top = max(of_text, key=lambda x: x[:2], default=(None, 0, None, None))
                    rows.append((n, ",".join(x[2] for x in of_text), top[2], top[0], top[3]))
                n, held, name, share, first = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(held, pa.string()), pa.array(name, pa.string()),
                     pa.array(share, pa.float64()), pa.array(first, pa.int64())],
                    names=[id_col, "n_words", "licenses", "license", "coverage", "first_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_words long, licenses string, license string, coverage double, first_word long")


def op8_license_alignment(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against the fixed templates."""
    return scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES, PHRASES)
