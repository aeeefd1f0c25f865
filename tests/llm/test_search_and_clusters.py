"""Ranked search, clustering and top-k search against brute force, with awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import clustering, lexical_search, topk_search


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def slow_terms(text):
    return [fold(t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def slow_search(docs, items, k):
    counts = [Counter(slow_terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, n in zip(docs, counts, sizes, strict=True):
            m = 50 + 50 * n * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(slow_terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def texts():
    rng = np.random.default_rng(11)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 4000) % 300]
    docs = [(k, " ".join(words[a : a + int(n)])) for k, (a, n) in enumerate(zip(rng.integers(0, 3900, 120), rng.integers(1, 90, 120), strict=True))]
    docs += [(200 + k, docs[7][1]) for k in range(40)]  # copies, more than are asked for
    docs += [(300, None), (301, ""), (302, " .,;\n"), (None, "w1 w2 W3"), (None, "w1 w2 W3"), (7, docs[7][1]), (7, "w5 w5 ÉA ß-x"), (303, "Éa 東京 W2 " * 400)]
    items = [(k, " ".join(words[a : a + 12])) for k, a in enumerate(range(0, 3600, 300))]
    items += [(50, None), (51, ""), (52, "absent everywhere"), (None, "w1 w2"), (3, "w9 w9 w9"), (3, "W5 Éa 東京 ÉA"), (53, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"shard": 20, "block_terms": 30}, {"local_bytes": 0, "shard": 60}])
def test_ranked_search(spark, sizes):
    docs, items = texts()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, terms string").repartition(3)
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, item int")
    got = lexical_search.ranked_search(d, i, k=15, **sizes).collect()
    want = slow_search(docs, items, 15)
    assert len(want) > 150 and sorted([tuple(r) for r in got], key=repr) == want


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked_search(docs.limit(0), items).count() == 0
    assert lexical_search.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical_search.ranked_search(docs.limit(0), items.limit(0), local_bytes=-1).count() == 0


def test_byte_impacts_bound_the_exact_ones():
    for impact in (0, 1, lexical_search.STEP, lexical_search.STEP + 1, 999_999):
        byte = -(-impact // lexical_search.STEP)
        assert byte <= 255 and byte * lexical_search.STEP >= impact >= byte * lexical_search.STEP - (lexical_search.STEP - 1) * (byte > 0)


def slow_clusters(rows, k, dim, rounds):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if mine := [v for (_, v), c in zip(kept, of, strict=True) if c == n]:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in last:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in last), key=repr)


def vectors(dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((9, dim))
    rows = [(k, [float(x) for x in base[k % 9] + rng.standard_normal(dim) * 0.5]) for k in range(150)]
    rows += [(400 + k, rows[3][1]) for k in range(30)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, [0.0] * dim)]
    bad = [(500, None), (501, []), (502, [1.0] * (dim - 1)), (503, [float("nan")] * dim), (504, [None] + [1.0] * (dim - 1)), (505, [float("-inf")] * dim)]
    return rows, bad


@pytest.mark.parametrize(("k", "dim", "segments"), [(8, 12, 16), (5, 10, 3), (300, 4, 1)])
def test_clusters(spark, k, dim, segments):
    rows, bad = vectors(dim, k)
    wide = [(600, [3e6] * dim), (601, [-3e6] * dim), (602, [3e6 + 1] * dim)] if segments == 3 else []
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + bad + wide], "vec_id long, embedding array<double>, cluster int, norms int").repartition(3)
    got = clustering.cluster_vectors(frame, k=k, dim=dim, segments=segments, rounds=6)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == slow_clusters(rows + bad + wide, k, dim, 6)
    assert clustering.cluster_vectors(frame.limit(0), dim=dim).count() == 0


def test_bounds_are_never_over_the_distance_and_screen():
    rng = np.random.default_rng(5)
    # vectors of unlike segment norms, as those of texts with a few strong directions
    x = (rng.standard_normal((2000, 64)) * np.repeat(rng.gamma(0.3, 1000, (2000, 8)), 8, axis=1)).astype(np.int64)
    c = x[:20]
    square, norms = clustering.compress(x, 16)
    c_square, c_norms = clustering.compress(c, 16)
    exact = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (square[:, None] + c_square - 2 * norms @ c_norms.T <= exact).all()
    cluster, distance, computed = clustering.assign(x, square, norms, c)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all() and computed < 0.5 * exact.size


def slow_top(rows, k, every):
    good = [(r, i, [math.floor(256 * float(x)) for x in v]) for r, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, i, v in good:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for s, j, w in good if s != r and len(v) == len(w))[:k]
            out += [(i, rank, None if none else j, max(-(1 << 63), min((1 << 63) - 1, -score))) for rank, (score, none, j) in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [65536, 50])
def test_top_k(spark, tile):
    rows, bad = vectors(12, 1)
    rows += [*bad, (10, []), (20, []), (30, [1.0, -2.0]), (700, [9e12] * 3), (701, [-8e12, 7e12, 9e12]), (710, [1e-3] * 3)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, tile int").repartition(3)
    found = topk_search.top_k(frame, topk_search.F.col("vec_id") % 10 == 0, k=4, block=5, tile=tile)
    want = slow_top(rows, 4, 10)
    assert len(want) > 60 and sorted([tuple(r) for r in found.collect()], key=repr) == want
    assert topk_search.top_k(frame.limit(0), topk_search.F.col("vec_id") % 10 == 0).count() == 0
    assert topk_search.top_k(frame, topk_search.F.lit(False)).count() == 0


def test_branch_and_bound_compacts():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64)) * 60 * np.exp(-np.arange(64) / 12)
    c = np.round(base[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 64)) * 2)
    v = np.ascontiguousarray(c.T)
    mass = np.array([(v[e : e + 8] ** 2).sum(axis=0) for e in range(0, 64, 8)])
    for q in c[:20]:
        places, scores, products = topk_search.branch_and_bound(q, v, mass, 5, -np.inf, 8, np.arange(4000))
        assert sorted(scores)[-5:] == sorted(c @ q)[-5:] and (c[places] @ q == scores).all() and products < 0.5 * 8 * 4000
