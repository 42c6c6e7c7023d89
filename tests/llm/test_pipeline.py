"""The pipeline's stages and the registered queries against brute force and their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from fleetscope.llm.queries import ORACLES, QUERIES
from tests.llm import corpus

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(cols, records):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df, res = QUERIES[name](spark, SF), duck.execute(ORACLES[name])
    assert ordered(df.columns, df.collect()) == ordered([d[0] for d in res.description], res.fetchall())


def test_stages_keep_their_promises(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, name = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    bench = [corpus.item_words(t) for _, t in duck.execute("select item_id, text from benchmark").fetchall()]
    grams = {tuple(w[i:i + 10]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    for stage, f in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = f(spark, docs, SF).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if stage == name[0]:
            toxic = dict(duck.execute("select doc_id, max(toxic) from labels group by 1").fetchall())
            clean = [i for i, y in toxic.items() if not y]
            assert all(after[i] == before[i] for i in after) and sum(i in after for i in clean) >= 0.97 * len(clean)
        elif stage == name[1]:
            best = corpus.components(list(before.items()))
            assert set(after) == set(best.values())
        elif stage == name[2]:
            gone = corpus.covered(list(before.items()))
            for i, t in before.items():
                kept = [w for k, w in enumerate(corpus.space_words(t)) if k not in gone[i]]
                assert corpus.space_words(after.get(i, "")) == kept and (gone[i] or after[i] == t)
        else:
            for i, t in before.items():
                w = corpus.item_words(t)
                hit = any(tuple(w[s:s + n]) in grams for n in {len(g) for g in grams} for s in range(len(w) - n + 1))
                assert hit or after[i] == t
                assert not hit or after.get(i) != t
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(after)


def test_run_returns_the_last_stages_rows(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
