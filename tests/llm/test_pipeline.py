"""The pipeline's stages one by one against brute force, and the registered queries."""

import re

import pytest

import corpus_pipeline
from pagestrata.llm import bpe, decontaminate, language_id, ngram_join, queries, secrets


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    from test_operators import brute_matches, brute_pairs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = language_id.train(docs)
    import pyarrow as pa

    ok = language_id.predict(model, pa.array([r[1] for r in rows]))[2]
    rows = [r for r, k in zip(rows, ok) if k]
    # of each transitive group the least id
    group = {r[0]: r[0] for r in rows}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in brute_pairs([(r[0], r[1]) for r in rows]):
        a, b = sorted((top(a), top(b)))
        group[b] = a
    rows = [r for r in rows if top(r[0]) == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 8]) for _, t in items for w in [re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())] for k in range(len(w) - 7)}

    def leaks(t):
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
        return any(tuple(w[k : k + 8]) in runs for k in range(len(w) - 7))

    rows = [r for r in rows if not leaks(r[1])]
    want = {}
    e, judged = bpe.Encoder(bpe.load()), secrets.Judge(secrets.dictionary())
    for r in rows:
        want[r[0]] = e.encode([secrets.mask(r[1], judged)])[0].tolist()
    out = corpus_pipeline.run(spark, sf_dir, str(tmp_path))
    got = {r.doc_id: r.tokens for r in out.collect()}
    assert got == want and 0 < len(got) < docs.count()
    for k, (name, _) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert spark.read.parquet(f"{tmp_path}/{k}_{name}").columns == docs.columns
    assert brute_matches([(0, "a b c")], [(1, "a b c")], 3) == {(0, 1): (3, 0, 0)}


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*sorted(got.columns)).collect())) == sorted(map(key, want.project(", ".join(sorted(want.columns))).fetchall()))


def test_all_operators_are_registered():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in names] == list(range(1, 11))
    assert [s.__name__ for s in (decontaminate.decontaminate, ngram_join.keep_one_of_each_group)]
