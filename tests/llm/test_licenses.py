"""License scans (op8) against brute force: longest common subsequences around every occurrence of a phrase."""

import random

import pytest

from fleetscope.llm import licenses
from fleetscope.llm.common import workers_import
from fleetscope.llm.queries import QUERIES
from tests.llm import corpus


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def best(name, text, reach=True):
    """The longest common subsequence around any occurrence of the phrase, within a template's length or in the whole text."""
    t, p, w = (corpus.item_words(x) for x in (licenses.TEMPLATES[name], licenses.PHRASES[name], text))
    m, n = len(t), len(p)
    at = next(i for i in range(m) if t[i:i + n] == p)
    top = 0
    for q in range(len(w) - n + 1):
        if w[q:q + n] == p:
            lo, hi = (max(0, q - at - m), q - at + 2 * m) if reach else (0, len(w))
            top = max(top, common(t[:at], w[lo:q]) + n + common(t[at + n:], w[q + n:hi]))
    return top / m


def test_licenses_are_found_wherever_and_however_often_they_stand(spark):
    workers_import(spark)
    assert QUERIES["op8_license_alignment"] is licenses.op8_license_alignment
    rng, rows = random.Random(21), [(None, "no license"), (-1, None), (-2, ""), (-3, " . ")]
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        for k in range(12):
            some = list(w)
            if k % 3 == 1:
                some[rng.randrange(len(w))] = "changed"
            if k % 3 == 2:
                some.insert(rng.randrange(len(w)), "added")
            line = " ".join(some)
            parts = [corpus.prose(rng, rng.randrange(200)), line, corpus.prose(rng, rng.randrange(500, 600)), *[line.upper()] * (k % 2)]
            rows.append((100 * i + k, "\n".join(parts)))
    rows += [(9000 + k, corpus.prose(rng, 300)) for k in range(5)] + [rows[5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, n_words long")
    scan = lambda d, t=licenses.TEMPLATES: licenses.scan_licenses(d, t, licenses.PHRASES)
    got = scan(df).collect()
    want = []
    for i, t in rows:
        share = {n: best(n, t or "") for n in licenses.TEMPLATES}
        held = sorted(n for n in share if share[n] >= 0.8)
        want.append((i or 0, len(corpus.item_words(t)), ",".join(held), max((share[n] for n in held), default=None)))
    assert sorted((r.doc_id or 0, r.n_words, r.licenses, r.coverage) for r in got) == sorted(want)
    assert sum(bool(r.licenses) for r in got) > 100
    assert scan(df, {}).filter("licenses != ''").count() == 0 and scan(df, {"none": " . "}).filter("licenses != ''").count() == 0
    assert scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(df, {"MIT": licenses.TEMPLATES["MIT"]}, {"MIT": "Apache License"})


def test_notices_of_other_licenses_are_told_apart(spark):
    workers_import(spark)
    notices = {
        "Released under the BSD License.": "BSD",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA",
        "Licensed under CC BY-NC-SA 4.0.": None,
        "Licensed under the Mozilla License, Version 2.0.": None,
        "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        licenses.TEMPLATES["Apache-2.0-header"]: "Apache-2.0-header",
    }
    df = spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(df, licenses.TEMPLATES, licenses.PHRASES).collect()}
    assert [got[i] for i in range(len(notices))] == list(notices.values())


def test_the_place_of_a_passage_does_not_matter(spark):
    workers_import(spark)
    rng, text = random.Random(4), licenses.TEMPLATES["MIT-text"].split()
    inserted, before, rows = corpus.prose(rng, len(text) // 2), corpus.prose(rng, 700).split(), []
    for cut in range(5, len(text), 20):
        for offset in (0, 7, 83, 331, 700):
            rows.append((len(rows), " ".join([*before[:offset], *text[:cut], inserted, *text[cut:], *before[:50]]), cut))
    df = spark.createDataFrame(rows, "doc_id long, text string, cut long")
    got = {r.doc_id: r for r in licenses.scan_licenses(df, licenses.TEMPLATES, licenses.PHRASES).collect()}
    seen = {}
    for i, t, cut in rows:
        want = best("MIT-text", t, reach=False)
        assert got[i].coverage == (want if want >= 0.8 else None)
        seen.setdefault(cut, set()).add(got[i].coverage)
    assert all(len(x) == 1 for x in seen.values()) and sum(x == {1.0} for x in seen.values()) >= len(seen) - 1


@pytest.mark.parametrize("seed", range(20))
def test_alignments_increase_and_match(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(9) for _ in range(rng.randrange(40))] for _ in range(2))
    got = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in got) and len(got) <= common(a, b)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert licenses.align(a, a) == [(i, i) for i in range(len(a))]
