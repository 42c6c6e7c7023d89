"""Near copies by an LSH forest (op13) against all pairs."""

import random

import pytest

from fleetscope.llm import lsh_forest
from fleetscope.llm.common import workers_import
from tests.llm import corpus


def frame(spark, rows):
    workers_import(spark)
    return spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows],
                                 "doc_id long, text string, id int, label string, a string, comp int").repartition(5)


def expected(rows, percent=80):
    """Sorted (doc_id, n_shingles, component_id, kept); rows that share an id keep their own text's component."""
    sets = [corpus.shingles(t, 2) for _, t in rows]
    best = [i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0])
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            if (best[a], best[b]) != (m, m):
                best[a] = best[b] = m
                changed = True
    return sorted(((i, len(s), c, c == i) for (i, _), s, c in zip(rows, sets, best)), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in lsh_forest.near_copies(df, **options).collect()), key=str)


def edited(rng, words, k):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = "w%d" % rng.randrange(10 ** 6)
    return " ".join(out)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in corpus.rows()] + [(None, corpus.texts()[7]), (501, "one"), (502, "ONE"), (503, "  one ")]
    assert found(frame(spark, rows)) == expected(rows)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None), (2, " "), (None, None)])) == expected([(1, None), (2, " "), (None, None)])


@pytest.mark.parametrize("region", [32, 4])
def test_groups_of_near_copies(spark, region):
    rng = random.Random(5)
    rows = []
    for n in (60, 200):
        base = corpus.prose(rng, n).split()
        rows += [(len(rows), " ".join(base))] * 1
        rows += [(len(rows) + i, edited(rng, base, 1 + i % (n // 20))) for i in range(40)]
    for _ in range(30):  # a chain: each is a copy of the one before
        rows.append((len(rows), edited(rng, rows[-1][1].split(), 6)))
    rows += [(len(rows) + i, corpus.prose(rng, 80)) for i in range(60)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]  # exact copies
    rng.shuffle(rows)
    assert found(frame(spark, rows), region=region) == expected(rows)


def test_pairs_at_the_threshold(spark):
    # Sets of 99 and 100 shingles that share so many that the similarity is just at, or just under, 0.8.
    rng = random.Random(9)
    rows = []
    for k in range(40):
        base = [f"k{k}w{i}" for i in range(101)]
        other = base[:90] + [f"k{k}x{i}" for i in range(11 if k % 2 else 13)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    rng.shuffle(rows)
    want = expected(rows)
    assert found(frame(spark, rows)) == want and 40 < sum(r[3] for r in want) < 80


def test_a_template_with_many_fillings(spark):
    # Hundreds of texts below the threshold share most of their words; the few real copies among them are found.
    rng = random.Random(11)
    base = corpus.prose(rng, 120).split()
    rows = [(i, edited(rng, base, 16)) for i in range(300)]
    rows += [(300 + i, edited(rng, rows[7 * i][1].split(), 1)) for i in range(30)]
    got, want = found(frame(spark, rows), region=16), expected(rows)
    assert sum(a != b for a, b in zip(got, want)) <= 3  # a region cut deeper may miss a pair
    assert all(a[2] >= b[2] for a, b in zip(got, want))  # but none is made up


def test_regions_are_cut_where_they_are_dense():
    import numpy as np

    label = np.array([[0, 1, 1, 1], [0, 1, 1, 2], [0, 1, 2, 1], [0, 2, 1, 1], [0, 2, 1, 1], [0, 2, 1, 1], [0, 2, 1, 1], [0, 3, 1, 1]])
    n = len(label)
    region = lsh_forest._Region({"id": np.arange(n), "size": np.ones(n), "comp": np.arange(n), "label": label, "sketch": np.zeros((n, 1))}, 80)
    parts = lambda most: sorted((x.tolist(), heads) for x, heads in region.parts(2, most))
    all_of = [([0, 1, 2], 3), ([3, 4, 5], 3), ([3, 4, 5, 6], lsh_forest.HEADS), ([3, 5, 6], 3)]
    assert parts(3) == all_of
    assert parts(2) == [([0, 1], 2), ([0, 1, 2], lsh_forest.HEADS), ([3, 4], 2), ([3, 4, 5], 3), ([3, 4, 5, 6], lsh_forest.HEADS), ([3, 5, 6], 3)]


@pytest.mark.parametrize("options", [{"region": 2}, {"region": 2, "trees": 1, "depth": 3, "shallow": 1}, {"region": 4, "tile": 8, "coarse": 3}])
def test_what_the_forest_cuts_apart_is_found(spark, options):
    # Texts of one template just below the threshold; few trees and small regions keep many of their links apart.
    rng = random.Random(17)
    base = corpus.prose(rng, 120).split()
    rows = [(i, edited(rng, base, 12)) for i in range(250)]
    rows += [(250 + i, edited(rng, rows[7 * i][1].split(), 4)) for i in range(35)]
    rows += [(300 + i, corpus.prose(rng, 3 + i % 30)) for i in range(60)]
    rows += [(400 + i, edited(rng, rows[290 + i][1].split(), 1)) for i in range(50)]
    rng.shuffle(rows)
    assert found(frame(spark, rows), **options) == expected(rows)


@pytest.mark.parametrize("percent", [50, 80, 95])
@pytest.mark.parametrize("coarse", [0, 3])
def test_linked_sets_share_a_key(percent, coarse):
    import numpy as np

    rng = np.random.default_rng(percent + coarse)
    lumpy = links = 0
    for k in range(4000):
        both = rng.integers(0, 1 << 64, 1 + k // 12, dtype=np.uint64)
        apart = rng.integers(0, 1 << 64, int((len(both) * 100 // percent - len(both)) * rng.choice([1, rng.random()])), dtype=np.uint64)
        cut = rng.choice([0, rng.integers(0, len(apart) + 1)])
        a, b = (np.unique(np.append(both, x)) for x in (apart[:cut], apart[cut:]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            links += 1
            x, y = (set(lsh_forest._keys(s, percent, coarse).tolist()) for s in (a, b))
            assert x & y or lsh_forest.LUMPY in x | y
            lumpy += lsh_forest.LUMPY in x | y
    assert links > 3000 and (coarse or percent < 80 or lumpy == 0)


def test_a_row_goes_on_with_its_best_pairs_only():
    # Many near copies in one region, which is cut several times: as many pairs as rows, not as cuts or heads.
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 400
    label = np.sort(rng.integers(0, 3, (n, 8)) * 3 ** np.arange(8)[::-1], axis=0).astype(">u2")
    label[:, :3] = 1
    label = label[np.lexsort(label.T[::-1])]
    sketch = np.where(rng.random((n, 64)) < 0.1, rng.integers(0, 256, (n, 64)), np.arange(64)).astype(np.uint8)
    rows = pa.RecordBatch.from_arrays([pa.array(rng.permutation(n)), pa.array(np.full(n, 50, np.int32)), pa.array([x.tobytes() for x in label], pa.binary()),
                                       pa.array([x.tobytes() for x in sketch], pa.binary())], names=["id", "size", "label", "sketch"])
    got = [x for batch in lsh_forest._pairs(80, 2, 32)([rows]) for x in zip(*(c.to_pylist() for c in batch.columns))]
    times = np.bincount([b for _, b, _ in got], minlength=n)
    assert len({(a, b) for a, b, _ in got}) == len(got) and times.max() == lsh_forest.NEAREST and (times > 0).sum() > n / 2


def _template(rng, count):
    """Texts of one template just below the threshold, and copies of some; many of them share most of their keys."""
    base = corpus.prose(rng, 120).split()
    rows = [(i, edited(rng, base, 12)) for i in range(count)]
    return rows + [(count + i, edited(rng, rows[3 * i][1].split(), 4)) for i in range(count // 4)]


def test_a_pair_comes_out_of_one_block(spark, monkeypatch):
    # Every block is searched as if by a task of its own: a pair that shares many of them still comes out once.
    import pyarrow as pa
    import pyarrow.compute

    rows, parts, of = _template(random.Random(23), 60), [], lsh_forest._tiled

    def tiled(*args):
        out = of(*args)
        parts.append(out.toArrow())
        return out

    monkeypatch.setattr(lsh_forest, "_tiled", tiled)
    options = {"region": 2, "trees": 1, "depth": 3, "shallow": 1}
    assert found(frame(spark, rows), **options) == expected(rows)
    held = parts[0].sort_by([("key", "ascending"), ("part", "ascending"), ("side", "ascending")])
    blocks = [held.filter(pa.compute.equal(held.column("key"), k)).combine_chunks() for k in sorted(set(held.column("key").to_pylist()))]

    def pairs(columns):
        return [p for block in blocks for batch in lsh_forest._search_blocks(80)(block.select(columns).to_batches())
                for p in zip(*(c.to_pylist() for c in batch.columns))]

    names = ["key", "part", "side", "id", "comp", "size", "fine"]
    once, often = pairs([*names, "before"]), pairs(names)
    assert len(once) == len(set(once)) and set(once) == set(often)
    assert len(once) > 3 and len(often) > 3 * len(once)  # so many before


@pytest.mark.parametrize("carried", [1, 3])
def test_carried_keys_lose_no_pair(spark, monkeypatch, carried):
    monkeypatch.setattr(lsh_forest, "CARRIED", carried)
    rows = _template(random.Random(29), 60)
    rows += [(i, rows[i][1]) for i in range(0, 40, 3)] + [(500 + i, rows[i][1]) for i in range(5)]  # rows given twice, copies
    assert found(frame(spark, rows), region=2, trees=1, depth=3, shallow=1, tile=16) == expected(rows)


def test_keys_travel_with_ids_alone():
    # Their components are looked up once a key has met another; a digest and the keys as lists were shuffled before.
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([3, 4, 5]), pa.array(["a b c", None, "d"])], names=["id", "text"])
    got, = lsh_forest._keyed(2, 80, 0)([batch])
    assert got.schema.names == ["id", "keys"] and got.column("id").to_pylist() == [3, 5]
    assert all(got.column("keys").to_pylist())
