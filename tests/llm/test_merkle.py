"""Merkle manifest (op12) against a tree built with hashlib."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fleetscope.llm import merkle
from fleetscope.llm.common import workers_import
from tests.llm import corpus

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(hashes):
    """All levels of a tree, the lone node last."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        out.append((run[:i % 16], run[i % 16 + 1:]))
        i //= 16
    return out


def manifest(rows, altered):
    """Sorted (id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    crown = levels([trees[s][-1][0] for s in order])
    root, out = crown[-1][0], []
    for at, s in enumerate(order):
        for i, (_, _, h, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            sides = path(trees[s], i) + path(crown, at)
            folded = leaf(altered(r))
            for left, right in sides:
                folded = sha("".join(left) + folded + "".join(right))
            out.append((r[0], h, trees[s][-1][0], root, sha("".join("".join(x + y) for x, y in sides)), folded, folded == root))
    return sorted(out, key=str)


def lowered(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    return (*r[:4], corpus.ascii_lower(r[4])) if hit and r[4] is not None else r


def made(spark, rows, digits):
    workers_import(spark)
    df = spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, hash string, rank int, grp string, block int")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changes = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    got = merkle.manifest(df.repartition(5), "doc_id", "source", FIELDS, (hit, changes), digits)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("digits", [1, 2])
def test_trees_of_all_sizes(spark, digits):
    # A lone leaf, full runs, a last run of one, several layers, a hot source, more than 16 sources.
    sizes = {"a": 1, "b": 16, "c": 17, "ö": 33, "z": 700, "B": 257}
    sizes |= {f"s{i}": 2 for i in range(14)}
    rows, n = [], 0
    for s, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7 % 5003, s, "en", n, f"Text {n} ÄÖ"))
            n += 1
    assert made(spark, rows, digits) == manifest(rows, lowered)


def test_awkward_rows(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in corpus.rows()]  # nulls, empty and very long texts
    rows += [(5, None, None, None, None), (None, None, "en", 1, "x"), (None, None, "en", 1, "y"), (6, "", "", 0, "")]
    rows += [(9, "same", "en", 4, "Same")] * 40  # repeated rows
    rows += [(9, "same", "en", 4, f"Other {i}") for i in range(20)]  # ties of the id
    got = made(spark, rows, 1)
    # Equal leaves may stand in any order: their proofs are the same set.
    assert got == manifest(rows, lowered)
    assert made(spark, rows[:1], 2) == manifest(rows[:1], lowered)
    assert made(spark, [], 2) == []


def test_only_altered_rows_fail(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "abc" if i % 2 else "ABC") for i in range(200)]
    got = {r[0]: r[-1] for r in made(spark, rows, 2)}
    assert got == {r[0]: lowered(r) == r for r in rows} and set(got.values()) == {True, False}
