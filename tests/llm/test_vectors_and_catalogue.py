"""Components and embeddings against brute force; the catalogue's queries against their SQL."""

import importlib

import duckdb
import numpy as np
import pytest

from feedloom.llm import embedding_dedup, queries
from feedloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def component_of(nodes, links):
    of = {n: n for n in nodes}
    for _ in nodes:
        before = dict(of)
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
        if of == before:
            break
    return of


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(500 + k, 501 + k) for k in range(64)] + [(900, k) for k in range(901, 950)] + [(7, 7), (None, 3), (501, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == component_of({n for e in links for n in e}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [16384, 40])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    vectors = [base[k % 60] + rng.standard_normal(16) * (0.02 + 0.3 * (k % 3)) for k in range(240)] + [base[0] * 3] * 3
    rows = [(k, [float(np.float32(x)) for x in v], 0) for k, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [float("inf")] * 16, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    good = {k: np.array(v) for k, v, _ in rows if k < 900 or k in (906, 907)}
    cos = lambda a, b: len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9
    links = [(a, b) for a in good for b in good if a < b and cos(good[a], good[b])]
    of = component_of([r[0] for r in rows], links)
    n = {k: sum(k in link for link in links) for k in of}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, size int")
    got = embedding_dedup.embedding_components(frame, tile=tile).collect()
    assert len(links) > 100 and {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(k, n[k], of[k], of[k] == k) for k in of}
    assert embedding_dedup.embedding_components(frame.limit(0)).count() == 0


def test_double_vectors_are_compared_as_doubles(spark):
    angle = np.arccos(0.89999999981)
    rows = [(1, [1.0, 0.0]), (2, [float(np.cos(angle)), float(np.sin(angle))]), (3, [1e100, 1.0, 0.0]), (4, [1e100, 2.0, 0.0]), (5, [3e-170, 4e-170, 0.0]), (6, [3.0, 4.0, 0.0]), (7, [-0.0, 5.0, 1.0]), (8, [0.0, 5.0, 1.0]), (8, [0.0, 0.0, 1.0]), (None, [3.0, 4.0, 0.0])]
    got = embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 5), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 2, 5), (6, 2, 5), (7, 1, 7), (8, 0, 8), (8, 1, 7)]
    whole = spark.createDataFrame([(1, [1, 2]), (2, [10, 20])], "vec_id long, embedding array<int>")
    assert {(r.vec_id, r.component_id) for r in embedding_dedup.embedding_components(whole).collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    assert sorted(map(repr, con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall())) == sorted(repr(tuple(r)) for r in frame.select(*names).collect())


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for number, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, SF)
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids and (docs.columns == columns or number == len(pipeline.STAGES) - 1)
        assert number not in (1, 4) or now == ids
        ids = now
    assert ids
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
