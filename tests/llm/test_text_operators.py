"""Decontamination, fingerprints, substring dedup, sharding, toxicity, Jaccard join, URL rules against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import common, decontaminate, fingerprints, jaccard, sharding, substring, toxicity, url_rules
from fleetscope.llm.common import workers_import
from tests.llm import corpus


@pytest.fixture(scope="module")
def docs(spark):
    workers_import(spark)
    return corpus.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    workers_import(spark)
    return corpus.frame(spark, [])


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


PLAIN = [(r[0], r[1]) for r in corpus.rows()]


@pytest.mark.parametrize("max_broadcast", [64 << 20, 0])
def test_decontamination(spark, docs, empty, max_broadcast):
    base = corpus.texts()[7].split()
    items = [(1, " ".join(base[5:30])), (2, "TWO words!"), (10, "unseen words in a row that no text has at all, really"), (3, None), (4, ""),
             (None, "one"), (5, "nobody")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.mark(docs, bench, max_broadcast=max_broadcast).collect()}
    assert len(got) == len(PLAIN)
    for i, t in PLAIN:
        w, hit, ids = corpus.item_words(t), set(), set()
        for item, text in items:
            b = corpus.item_words(text)
            for g in {tuple(b[k:k + 10]) for k in range(max(1, len(b) - 9))} if b else ():
                for s in range(len(w) - len(g) + 1):
                    if tuple(w[s:s + len(g)]) == g:
                        hit.update(range(s, s + len(g)))
                        ids |= {str(item)} if item is not None else set()
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == sha(",".join(sorted(ids)))
    if max_broadcast:
        cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(docs, bench).collect()}
        assert "two words" not in cut.values() and cut[3 * 24] == PLAIN[24][1]
        assert decontaminate.mark(empty, bench).count() == 0
        assert decontaminate.mark(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_rows_without_an_id_or_sharing_one_lose_their_own_passages_only(spark):
    workers_import(spark)
    rng = random.Random(14)
    passage, other = corpus.prose(rng, 12), corpus.prose(rng, 12)
    clean = [corpus.prose(rng, n) for n in (40, 8, 60)]
    rows = [(None, clean[0]), (None, f"{clean[2]} {passage}"), (None, f"{other} {clean[2]}"), (4, clean[1]), (4, passage), (4, f"{passage} {clean[0]}")]
    bench = spark.createDataFrame([(1, passage), (2, other)], "item_id long, text string")
    got = decontaminate.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()
    want = [(None, clean[0]), (None, clean[2]), (None, clean[2]), (4, clean[1]), (4, clean[0])]
    assert sorted((r.doc_id or 0, *corpus.space_words(r.text)) for r in got) == sorted((i or 0, *t.split()) for i, t in want)


def test_fingerprints(docs, empty, spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "table", lambda spark, sf_dir, name: docs.filter("doc_id is not null") if sf_dir else empty)
    got = {r.doc_id: r for r in fingerprints.op3_paragraph_sketch(spark, "x").collect()}
    plain = [(i, t or "") for i, t in PLAIN if i is not None]
    parts = lambda t: set(re.findall(r"[^\n]{1,160}", t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    seen = {}
    for k, (i, t) in enumerate(plain):
        nxt = plain[(k + 1) % len(plain)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == sha(edited)
        assert r.near_edited == pytest.approx(like(parts(t), parts(edited))) and r.near_next == pytest.approx(like(parts(t), parts(nxt)))
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    assert fingerprints.op3_paragraph_sketch(spark, "").count() == 0


def test_peeling_recovers_the_differing_digests(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 9], [3, 4, 5], [*range(100)])], "a array<long>, b array<long>, c array<long>")
    f = fingerprints
    r = df.select(f.peel(f.subtract(f.sketch(F.col("a")), f.sketch(F.col("b")))).alias("x"),
                  f.peel(f.subtract(f.sketch(F.col("a")), f.sketch(F.col("c")))).alias("y")).first()
    assert r.x.left == 0 and {(d.key, d.n) for d in r.x.found} == {(1, 1), (2, 1), (9, 1), (5, -1)}
    assert r.y.left > 0  # too many for the base sketch: stuck, not wrong
    again = f.differences(spark.createDataFrame([(7, [1, 2, 3], [*range(300)])], "uid long, a array<long>, b array<long>"))
    assert [tuple(x) for x in again.collect()] == [(7, 297)]


@pytest.mark.parametrize("max_broadcast", [64 << 20, 0])
def test_substring_dedup(docs, empty, max_broadcast):
    known = [(i, t) for i, t in PLAIN if i is not None]
    gone = corpus.covered(known)
    got = {r.doc_id: r for r in substring.count_repeats(docs, max_broadcast=max_broadcast).collect()}
    assert len(got) == len(PLAIN) and sum(map(len, gone.values())) > 500
    for i, t in known:
        w = corpus.space_words(t)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone[i]), sha(kept)), i
    if max_broadcast:
        left = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
        for i, t in known:
            kept = [x for k, x in enumerate(corpus.space_words(t)) if k not in gone[i]]
            if gone[i]:
                assert corpus.space_words(left[i].text if i in left else "") == kept
            else:
                assert left[i].text == t
        assert substring.count_repeats(empty).count() == 0 and substring.remove_repeats(empty).count() == 0


def test_the_first_of_three_copies_stays_whatever_follows_it(spark):
    """Only the first copy is followed by a run of six words that recurs across the end of the passage."""
    workers_import(spark)
    rng = random.Random(11)
    rows = []
    for case in range(40):
        passage = corpus.prose(rng, 30).split()
        for copy in range(3):
            after = passage[-6:] * 3 if copy == 0 else [f"c{case}x{copy}y{i}" for i in range(12)]
            rows.append((3 * case + copy, " ".join([f"b{case}x{copy}", *passage, *after])))
    gone = corpus.covered(rows)
    got = {r.doc_id: r for r in substring.count_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        kept = " ".join(x for k, x in enumerate(t.split()) if k not in gone[i])
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone[i]), sha(kept)), i


def test_rows_without_an_id_or_sharing_one_keep_their_own_spans(spark):
    workers_import(spark)
    rng = random.Random(12)
    once, twice = corpus.prose(rng, 25), corpus.prose(rng, 25)
    texts = [(None, corpus.prose(rng, 40)), (None, f"{once} x {once}"), (None, corpus.prose(rng, 22)), (None, f"y {twice}"),
             (5, corpus.prose(rng, 60)), (5, f"z z {twice}"), (6, once)]
    n_removed = [0, 25, 0, 0, 0, 25, 25]
    df = spark.createDataFrame(texts + texts[:1], "doc_id long, text string").repartition(3)
    got = sorted((r.n_words, r.n_removed) for r in substring.count_repeats(df).collect())
    want = [(len(t.split()), n) for (_, t), n in zip(texts, n_removed)]
    assert got == sorted(want + want[:1])
    left = sorted(r.text for r in substring.remove_repeats(df).collect())
    kept = [texts[0][1]] * 2 + [f"{once} x "] + [t for _, t in texts[2:5]] + ["z z "]
    assert left == sorted(kept)


@pytest.mark.parametrize("max_broadcast", [64 << 20, 0])
def test_edges_with_equal_short_digests_are_told_apart(spark, monkeypatch, max_broadcast):
    """Many texts around one common line, with short digests of one byte; every fifth text holds a true partial repeat."""
    workers_import(spark)
    monkeypatch.setattr(substring, "PRINT", 1)
    rng = random.Random(13)
    line = corpus.prose(rng, 18)
    tails = [" ".join(f"t{i}x{j}" for j in range(30)) for i in range(80)]
    rows = [(i, f"a{i} b{i} {line} {tails[i - 1][:40] if i % 5 == 4 else ''} {tails[i]}") for i in range(80)]
    gone = corpus.covered(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring.count_repeats(df, max_broadcast=max_broadcast).collect()}
    assert got == {i: len(gone[i]) for i, _ in rows} and sum(map(bool, gone.values())) == 16


def test_sharding(spark, docs, empty):
    rng = random.Random(5)
    many = [(i, corpus.prose(rng, rng.randint(1, 60)) if i % 3 else "one text that a third of all rows share") for i in range(3_000)]
    many += [many[1]] * 2
    for df, plain in ((docs, PLAIN), (spark.createDataFrame(many, "doc_id long, text string"), many)):
        got = sharding.shard_by_bytes(df).collect()
        size = lambda t: len((t or "").encode()) + 8
        assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
            (i or -1, size(t), zlib.crc32((t or "").encode())) for i, t in plain)
        for s in range(24):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    load = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(load) < 1.05 * sum(load) / 24 and min(load) > 0.95 * sum(load) / 24
    assert sharding.shard_by_bytes(empty).count() == 0


def test_toxicity_held_out_accuracy(spark, docs, empty):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        words = corpus.prose(rng, rng.randint(20, 200)).split()
        for _ in range(rng.randint(2, 5) if i % 4 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["dolt", "doltish", "knave", "Knaves,"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), keep=lambda i: ~toxicity.held_out(i))
    got = toxicity.score(df, model, columns=["doc_id", "toxic"]).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    out = [r for r in got if r.out]
    assert len(got) == 600 and all(0 <= r.score <= 1 for r in got)
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in out]) > 0.95
    assert toxicity.score(docs, model, columns=["doc_id"]).count() == len(PLAIN) and toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none, columns=["doc_id"]).filter("score >= 0.5").count() == 0


def test_toxicity_against_plain_python(spark):
    """Features and log-count ratios counted in plain Python, the machine's optimum by its gradient, scores by hand."""
    workers_import(spark)
    rng, bits, mask = random.Random(5), 18, (1 << 64) - 1
    rows = [(i, corpus.prose(rng, rng.randint(1, 40)) + (" knave dolt" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    rows += [(100, "", 0), (101, "ab", 1), (102, None, 0), (103, "Ünï x", 0)]

    def buckets(text):
        x = b" " + (text or "").encode().lower()
        grams = {x[i:i + n] for n in (4, 6) for i in range(len(x) - n + 1)} or {x[:3]}
        code = lambda g: (int.from_bytes(g, "little") * (0x9E3779B97F4A7C15 + 2 * len(g)) & mask) >> (64 - bits)
        return sorted({code(g) for g in grams}) if text else []

    features, y = [buckets(r[1]) for r in rows], [r[2] for r in rows]
    scratch = np.zeros(1 << bits, np.int32)
    for r, b in zip(rows, features):
        assert sorted(toxicity._buckets((r[1] or "").encode(), bits, scratch).tolist()) == b
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))

    used = sorted({b for f in features for b in f})
    count = {s: {b: 1 + sum(b in f for f, label in zip(map(set, features), y) if label == s) for b in used} for s in (0, 1)}
    total = {s: sum(count[s].values()) + (1 << bits) - len(used) for s in (0, 1)}
    ratio = {b: np.log(count[1][b] / total[1]) - np.log(count[0][b] / total[0]) for b in used}
    w = {b: float(model.weights[b]) / ratio[b] for b in used}
    share = {s: len(y) / (2 * y.count(s)) for s in (0, 1)}
    gradient, down, loss = dict(w), model.bias, 0.0
    for f, label in zip(features, y):
        scale, sign = max(1, len(f)) ** 0.25, 2 * label - 1
        margin = model.bias + sum(float(model.weights[b]) for b in f) / scale
        assert model.margin(np.asarray(f, int)) == pytest.approx(margin, abs=1e-4)
        push = 2 * share[label] * max(0.0, 1 - sign * margin) * sign
        down, loss = down - push, loss + share[label] * max(0.0, 1 - sign * margin) ** 2
        for b in f:
            gradient[b] -= push * ratio[b] / scale
    # The objective curves by at least one, so it is above its optimum by half the squared gradient at most: 5 % here.
    half = lambda v: sum(x * x for x in v) / 2
    assert half([*gradient.values(), down]) < 0.05 * (half([*w.values(), model.bias]) + loss)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for (i, _, _), f in zip(rows, features):
        margin = model.bias + sum(float(model.weights[b]) for b in f) / max(1, len(f)) ** 0.25
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.scale * margin + model.shift))), abs=1e-4)


def test_rows_that_share_an_id_are_learned_once_whatever_their_order(spark):
    workers_import(spark)
    rng = random.Random(6)
    rows = [(i // 2, corpus.prose(rng, 12) + (" knave dolt" if i // 2 % 2 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    frames = [spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows, 2), (rows[::-1], 5), (rows * 20, 3))]
    one, *others = [toxicity.train(f, labels) for f in frames]
    assert all(np.array_equal(one.weights, m.weights) and one.bias == m.bias for m in others)


def test_a_very_long_text_does_not_empty_the_sample(spark):
    workers_import(spark)
    ids = [r[0] for r in spark.range(60).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, ("dolt knave " if i % 2 else "kind words ") * (5_000 if k == 1 else 5), i % 2) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), max_chars=20_000)
    got = toxicity.score(df, model, columns=["doc_id"]).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_training_leaves_no_sample_in_the_drivers_memory(spark):
    workers_import(spark)

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

    text = "concat_ws(' ', transform(sequence(1, 600), i -> hex(xxhash64(id, i))))"  # about 80 KB of features each
    docs = spark.range(0, 1500, 1, 8).select(F.col("id").alias("doc_id"), F.expr(text).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    toxicity.train(docs.limit(20), labels)  # what the first training loads stays
    common.release()
    before = held()
    model = toxicity.train(docs, labels)
    assert model.weights.any() and held() - before < 40


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 0, "tile": 3, "common_from": 2}])
def test_similar_components(docs, empty, options):
    known = [(i, t) for i, t in PLAIN if i is not None]
    want = corpus.components(known)
    got = {r.doc_id: r for r in jaccard.similar_components(docs, **options).collect()}
    assert len(got) == len(PLAIN) and len(set(want.values())) < len(known) - 3
    for i, t in known:
        assert (got[i].n_shingles, got[i].component_id) == (len(corpus.shingles(t)), want[i]), i
    assert got[None].component_id is None
    if not options:
        assert jaccard.similar_components(empty).count() == 0


def test_links_at_the_threshold_and_through_chains(spark):
    """Chains whose ends are not linked, and blocks whose least member links with nobody."""
    workers_import(spark)
    rng = random.Random(9)
    rows, base = [], corpus.prose(rng, 64).split()
    for i in range(60):
        rows.append((i, " ".join(base)))
        if i % 7 == 6:
            base = corpus.prose(rng, 40).split() + base[:24]
        base[rng.randrange(64)] = f"w{i}"
    want = corpus.components(rows)
    for tile in (8192, 4):
        got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile=tile)
        assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert 1 < len(set(want.values())) < 60


def test_r_tree_finds_all_pairs_within_bounds():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 6, (300, jaccard.GROUPS)).astype(np.int32)
    points[150:] = np.maximum(0, points[:150] + (rng.random((150, jaccard.GROUPS)) < 0.1))
    size = points.sum(axis=1)
    tree = jaccard.RTree(size, points)
    got = {tuple(sorted(p)) for x, y in tree.pairs(tree, 75, True) for p in zip(x.tolist(), y.tolist())}
    shared = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if 175 * shared[a, b] >= 75 * (size[a] + size[b])}
    assert got == want and len(want) >= 150


def test_url_rules(spark):
    urls = ["https://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org?/es/", "x://b.example.org/en/12/", "nothing", None, "",
            "https://deep.a.b.example.com/de/1", "ftp://notexample.org/en/1", "https://org/", "http://example.org/en/1", "a://b://example.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        rest = (urls[r.page_id] or "").partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest[2] if rest[1] else "").groups()
        host = corpus.ascii_lower(host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert url_rules.judge_urls(pages, rules.limit(0)).filter("rule is not null").count() == 0
