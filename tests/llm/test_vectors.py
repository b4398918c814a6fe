"""Operators on vectors, the shared pieces, and the pipeline."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import components, neighbours, search, words
from lodestone.llm.workspace import Workspace

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    table = [(i, [float(v) for v in base[i % 40] + rng.normal(size=8) * 0.12], int(i % 3) if i % 11 else None) for i in range(400)]
    table += [(1000 + i, [float(v) for v in base[0]], 0) for i in range(30)] + [(1000, [float(v) for v in base[0]], 0)]
    table += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [NAN] + [1.0] * 7, 1), (2003, [None] + [1.0] * 7, 1), (2004, [INF] + [1.0] * 7, 1), (2005, [], 1), (2006, [1.0], 1), (None, [1.0] * 8, 1)]
    return spark.createDataFrame([(*r, -1, -1) for r in table], "vec_id long, embedding array<float>, label int, score int, n_links int")


def usable(r):
    e = r.embedding
    return r.vec_id is not None and e is not None and len(e) == 8 and all(v is not None and np.isfinite(v) for v in e) and any(e)


def test_near_duplicates(vectors):
    table = vectors.collect()
    good = [r for r in table if usable(r) and r.label is not None]
    x = np.array([r.embedding for r in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in good])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    group = np.arange(len(good))
    for _ in range(len(good)):
        new = np.array([min(group[k], *group[np.flatnonzero(linked[k])]) if linked[k].any() else group[k] for k in range(len(good))])
        if (new == group).all():
            break
        group = new
    least = {}
    for k, g in enumerate(group):
        least[g] = min(least.get(g, good[k].vec_id), good[k].vec_id)
    want = Counter((r.vec_id, int(n), least[g], r.vec_id == least[g]) for r, n, g in zip(good, linked.sum(1), group))
    want += Counter((r.vec_id, 0, r.vec_id, True) for r in table if not (usable(r) and r.label is not None))
    assert Counter(tuple(r) for r in neighbours.near_duplicates(vectors).collect()) == want


def test_links_are_whole_where_the_audit_never_holds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CLUSTER", 6)
    monkeypatch.setattr(neighbours, "audit", lambda *_: (0.0, 0))
    x = np.random.default_rng(3).normal(size=(60, 3)).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(table, 0.7, 1).collect()}
    assert got == dict(enumerate(((u @ u.T >= 0.7).sum(1) - 1).tolist()))


def test_audit_needs_evidence(spark):
    """Found links that are missing count as missed; a corpus without links has none to miss."""
    x = np.eye(6).tolist() + [[1.0, 0.05, 0.0, 0.0, 0.0, 0.0]]
    nodes = spark.createDataFrame([(i, 1, 1, v) for i, v in enumerate(x)], "node long, kind long, copies long, v array<double>")
    none = spark.createDataFrame([], "node long, n_links long")
    assert neighbours.audit(nodes, none, 0.93) == (0.0, 2)
    found = spark.createDataFrame([(0, 1), (6, 1)], "node long, n_links long")
    assert neighbours.audit(nodes, found, 0.93) == (1.0, 2)
    assert neighbours.audit(nodes.where("node < 6"), none, 0.93) == (1.0, 0)


def test_vectors_of_every_length_link_among_themselves(spark):
    table = [(1, [1.0, 0.0, 0.0], 5), (2, [0.99, 0.01, 0.0], 5), (3, [1.0, 0.0], 5), (4, [1e300, 1.0], 5), (5, [1.0, 0.0, 0.0], 6), (5, [0.0, 1.0], 6), (6, [0.01, 5.0], 6)]
    out = neighbours.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, out)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (5, 1, 5, True), (6, 1, 5, False)]
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (3, [0.5, 0.5]), (20, [1.0, 0.0, 1e10]), (21, [0.0, 3.0, 1e10])]
    got = search.nearest(spark.createDataFrame(few, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 4.0), (0, 2, 3, 1.5), (20, 1, 21, 1e20)]


def test_nearest_over_many_parts_against_all(spark):
    """Over the parts' routing on Spark: recall, exact scores, and fewer vectors compared than there are."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 16)) * 0.2).astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    router, got = search.fit(x[: search.SAMPLE], search.LEAST_PARTS, 20), {}
    for r in search.nearest(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = 0
    for q in range(0, 6000, 20):
        s = (x * x[q]).sum(axis=1)
        assert all(v == s[i] for i, v in got[q].values()) and sorted(got[q]) == list(range(1, 21))
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {i for i, _ in got[q].values()})
    assert hit >= 0.95 * 300 * 20
    assert router.weights.shape[1] == search.LEAST_PARTS and router.visits < search.LEAST_PARTS


def test_recall_of_the_graph_alone():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + rng.normal(size=(300, 16)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = neighbours.build_graph(x)
    found = neighbours.greedy(x, edges, x, 0)
    assert np.mean([k in f for k, f in enumerate(found)]) > 0.9


def test_nearest(vectors):
    out = {}
    for r in search.nearest(vectors, every=20, k=20).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    good = [r for r in vectors.collect() if usable(r)]
    ids, x = np.array([r.vec_id for r in good]), np.array([r.embedding for r in good], float)
    queries = sorted({i for i in ids.tolist() if i % 20 == 0})
    assert sorted(out) == queries
    hits = 0
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        other = ids != q
        order = np.lexsort((ids[other], -s[other]))[:20]
        true = list(zip(ids[other][order].tolist(), s[other][order].tolist()))
        assert sorted(out[q]) == list(range(1, 21))
        hits += sum((a in {v for v, _ in true}) for a, _ in out[q].values())
        assert all(out[q][k][1] >= out[q][k + 1][1] for k in range(1, 20))
    assert hits >= 0.9 * 20 * len(queries)


def test_nearest_with_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in search.nearest(few).orderBy("rank").collect()] == [(1, 1, 4.0), (2, 3, 1.5)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert search.nearest(none).count() == 0 and neighbours.near_duplicates(none).count() == 0


def test_search_recall_with_several_parts():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 12))
    router = search.fit(x[:3000], 8, 20)
    order = router.order(x)
    filed, hit = order[:, 0], 0
    for q in range(0, 4000, 200):
        s = x @ x[q]
        s[q] = -np.inf
        hit += np.isin(filed[np.argsort(-s)[:20]], order[q, : router.visits]).sum()
    assert hit >= 0.9 * 20 * 20


def test_words_match_the_pattern():
    import re

    pattern, texts = re.compile(rb"[^\x20\x09-\x0D]+"), ["a b\tc  d", "", None, "Hello  hello\x0bX", "   ", "x" * 50 + " é ü", "zz"]
    for size in (1, 10, 1000):
        for i, w in words.blocks(pa.array(texts), size=size):
            for t in range(w.texts):
                span = slice(w.first[t], w.first[t + 1])
                assert [bytes(w.data[a:b]) for a, b in zip(w.begin[span], w.end[span])] == pattern.findall((texts[i + t] or "").encode())


def test_windows_stay_in_their_text():
    (_, w), = words.blocks(pa.array(["a b c", "a b", "b c d a b c"]))
    hashes, at = words.windows(w, 3)
    assert at.tolist() == [0, 5, 6, 7, 8] and hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4


def test_folded_words_ignore_the_case_of_ascii():
    (_, w), = words.blocks(pa.array(["ABC abc Abc É é"]), fold=True)
    assert len(set(w.hashes[:3].tolist())) == 1 and w.hashes[3] != w.hashes[4]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5), (3, 1)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.component for r in components.connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(61)}


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Workspace(spark, "p").save(stage(spark, docs, data), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] <= 200 and 0 < seen[2] <= seen[1] <= seen[0]
    assert corpus_pipeline.run(spark, data).count() >= seen[3]
