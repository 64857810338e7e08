"""Pairs of rows in blocks of chunks, against every pair in plain loops."""

import itertools
import math
import random

import pytest

from corpusloom.operators import blocks, vectors


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 20)


def _sets(n, seed=5):
    rng = random.Random(seed)
    return {i: {f"t{min(rng.randrange(1, 40), rng.randrange(1, 40))}" for _ in range(rng.randrange(0, 9))} for i in range(n)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cosine_pairs_leave_their_block_once(spark, small_chunks):
    sets = _sets(90)
    cells = [(i, t, 1.0 + k % 3) for i, terms in sets.items() for k, t in enumerate(sorted(terms))]
    weights = {(i, t): w for i, t, w in cells}
    got = vectors.cosine_pairs(spark.createDataFrame([*cells, (None, "t1", 1.0)], "doc_id long, term string, tfidf double"))
    # Nothing is summed or joined after the pairs are made: before, products of single terms were shuffled.
    assert _plan(got).startswith("MapInArrow")
    norm = {i: math.sqrt(sum(weights[i, t] ** 2 for t in terms)) for i, terms in sets.items()}
    want = {(a, b): sum(weights[a, t] * weights[b, t] for t in sets[a] & sets[b]) / norm[a] / norm[b] for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b]}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.a, r.b): r.score for r in rows} == pytest.approx(want)


def test_cosine_pairs_take_weights_of_any_sign(spark, small_chunks):
    cells = [(1, "x", 1.0), (1, "y", 1.0), (2, "x", 1.0), (2, "y", -1.0), (3, "z", 1.0), (4, "z", 0.0), (4, "w", 2.0)]
    got = vectors.cosine_pairs(spark.createDataFrame(cells, "doc_id long, term string, tfidf double")).collect()
    assert {(r.a, r.b): round(r.score, 12) for r in got} == {(1, 2): 0.0, (3, 4): 0.0}


def test_counted_joins_rows_of_one_id(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (1, ["b"]), (None, ["c", "c"])]
    got = vectors.counts_of(vectors.counted(spark.createDataFrame(rows, "doc_id long, w array<string>"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "a", 2), (1, "b", 2), (None, "c", 2)], key=repr)


def test_jaccard_pairs_of_blocks(spark, small_chunks):
    sets = {i: s | {f"own{i}"} for i, s in _sets(90).items()}
    got = vectors.jaccard_pairs(spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "doc_id long, term string"))
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b]}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.a, r.b): (r.i, r.u) for r in rows} == want and all(r.score == r.i / r.u for r in rows)


def test_jaccard_pairs_query_makes_its_pairs_in_blocks(spark):
    from corpusloom.plans import registry

    assert "MapInArrow" in _plan(registry.QUERIES["jaccard_pairs"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("zeros", [True, False])
def test_condensed_scores_keep_their_statistics(spark, small_chunks, monkeypatch, zeros):
    import numpy as np

    # Few bins and values at once, so that the bins of the quantiles have to be divided.
    monkeypatch.setattr(blocks, "BINS", 12)
    monkeypatch.setattr(blocks, "TOLD", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(110, 3))
    x[60:] = x[:50]
    if zeros:
        x = np.where(rng.random(x.shape) < 0.6, 0.0, x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    if zeros:
        rows = [(i, [k for k in range(3) if v[k]], [float(c) for c in v if c]) for i, v in enumerate(x) if v.any()]
        out = blocks.condensed(spark.createDataFrame(rows, "id long, terms array<long>, u array<double>"), "terms", blocks.sparse_cosine(), zeros_of=len(x))
    else:
        out = blocks.condensed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "v", blocks.dense_cosine())
    rows = out.collect()
    scores = (x @ x.T)[np.triu_indices(len(x), 1)]
    # Before, each of the 5,995 pairs was a row for the aggregates.
    assert len(rows) < 600 and sum(r.times for r in rows) == len(scores)
    told = np.sort(np.repeat([r.score for r in rows], [r.times for r in rows]))
    assert told.mean() == pytest.approx(scores.mean()) and (told[0], told[-1]) == pytest.approx((scores.min(), scores.max()))
    assert np.quantile(told, [0.25, 0.5, 0.75]) == pytest.approx(np.quantile(scores, [0.25, 0.5, 0.75]), abs=1e-12)


def test_sim_stats_meets_no_pairs_as_rows(spark):
    from corpusloom.plans import registry

    # 200 documents and 500 vectors have 144,650 pairs, each of them a row before.
    assert registry._all_sims(spark, "/root/testdata/sf0.001").count() < 20_000


def test_cosine_blocks_are_dealt_by_large_chunks(spark):
    from corpusloom.operators import dense

    vectors_ = spark.range(5000).selectExpr("id AS vec_id", "array(cast(id + 1 AS double), 1.0D) AS embedding")
    near = dense.cosine_blocks(vectors_, -2.0)
    # Pairs of up to 4,096 rows a chunk: a vector is shipped once for each chunk, before once for each 1,024 rows.
    assert _plan(near).startswith("MapInArrow") and near.count() == 5000 * 4999 // 2
