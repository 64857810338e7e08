"""Top lists of documents and weights of their terms, against plain loops."""

import itertools
import math
import random
from collections import Counter

import pytest

from corpusloom.operators import graph, vectors


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("heavy", [4096, 7, 1])
def test_list_weights_count_pairs_in_their_task(spark, monkeypatch, heavy):
    monkeypatch.setattr(graph, "HEAVY", heavy)
    rng = random.Random(heavy)
    lists = [(i, sorted({f"t{min(rng.randrange(20), rng.randrange(20))}" for _ in range(rng.randrange(7))})) for i in range(2500)]
    got = graph.list_weights(spark.createDataFrame(lists, "doc_id long, terms array<string>"))
    # Before, each pair of each document was a row of its own; now those of frequent terms are not.
    assert ("Generate explode" in _plan(got)) == (heavy < 20) and "MapInArrow" in _plan(got)
    f = Counter(t for _, terms in lists for t in terms)
    shared = Counter(p for _, terms in lists for p in itertools.combinations(terms, 2))
    rows = got.collect()
    assert len(rows) == len(shared) and {(r.a, r.b): r.weight for r in rows} == {(a, b): n / (f[a] + f[b] - n) for (a, b), n in shared.items()}


@pytest.mark.parametrize("listed", [200_000, 1])
def test_top_lists_rank_within_their_row(spark, monkeypatch, listed):
    monkeypatch.setattr(vectors, "LISTED", listed)
    rng = random.Random(1)
    docs = [(i, [f"t{min(rng.randrange(30), rng.randrange(30)):02d}" for _ in range(rng.randrange(25))]) for i in range(200)]
    counted = vectors.counted(spark.createDataFrame(docs, "doc_id long, w array<string>"))
    kept = vectors.kept_terms(vectors.counts_of(counted), len(docs), 0.1, 0.5)
    got = {r.doc_id: list(r.terms) for r in vectors.top_lists(counted, kept, len(docs), 4).collect()}
    df = Counter(t for _, w in docs for t in set(w))
    want = {}
    for i, w in docs:
        tf = {t: n for t, n in Counter(w).items() if 20 <= df[t] <= 100}
        weight = {t: n / sum(tf.values()) * math.log(len(docs) / df[t]) for t, n in tf.items()}
        if weight:
            want[i] = sorted(weight, key=lambda t: (-round(weight[t], 12), t))[:4]
    assert got == want
