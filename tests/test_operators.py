"""Micro-fixtures with hand-computed answers, and properties, for the operator inventory."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.html import parse
from corpusloom.functions.stem import stem
from corpusloom.operators import dense, graph, match, text, vectors


@pytest.mark.parametrize(
    "word,want",
    [("running", "run"), ("universities", "univers"), ("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("generously", "generous"), ("national", "nation"), ("sky", "sky"), ("dying", "die"), ("relational", "relat"), ("hoping", "hope"), ("at", "at")],
)
def test_stem(word, want):
    assert stem(word) == want


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'", min_size=1, max_size=14))
def test_stem_never_grows_by_more_than_a_letter(word):
    assert len(stem(word)) <= len(word) + 1


def test_parse_reads_broken_html():
    got = parse("<div class='about'><p>One<p> Two </div><h1>T</h1><a href='/x'>l", "about")
    assert got[0] == "One\n\nTwo" and got[1] == "T" and got[3] == ["/x"]
    assert parse(None) == (None, None, None, [])


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "The cross-disciplinary student lab, it’s Great and/or big."), (2, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in docs.select("doc_id", text.extract_tokens(F.col("text"))).collect()}
    assert got == {1: ["student", "lab", "great", "big"], 2: []}


def test_split_words(spark):
    words = spark.createDataFrame([("Researchcentre",), ("valid",), ("cat",)], "word string")
    known = spark.createDataFrame([("research",), ("centre",), ("valid",)], "word string")
    got = {r.word: (r.fixed, r.changed) for r in text.split_words(words, known).collect()}
    assert got == {"Researchcentre": ("Research centre", True), "valid": ("valid", False), "cat": ("cat", False)}


def test_rewrite_merged(spark):
    docs = spark.createDataFrame([(1, "A labwork,here."), (2, "")], "doc_id long, text string")
    fixes = spark.createDataFrame([("labwork", "lab work", True)], "word string, fixed string, changed boolean")
    got = {r.doc_id: (r.text, r.n_changes) for r in text.rewrite_merged(docs, fixes).collect()}
    assert got == {1: ("A lab work, here.", 1), 2: ("", 0)}


def test_window_filter(spark):
    docs = spark.createDataFrame([(1, "A b c d e f g h i j k l m Studying, key's o p"), (2, "x y"), (3, "x y"), (4, None)], "doc_id long, text string")
    targets = spark.createDataFrame([(1, "studi"), (1, "a"), (3, "z"), (4, "z")], "doc_id long, stem string")
    got = {r.doc_id: r.filtered for r in text.window_filter(docs, targets, 2).collect()}
    assert got == {1: "A b c ... l m Studying , key's", 2: "MISSING_KEY", 3: "", 4: ""}
    whole = {r.doc_id: r.filtered for r in text.window_filter(docs, targets, 2, stemmed=False).collect()}
    assert whole[1] == "A b c"
    counts = text.outcome_counts(text.window_filter(docs, targets, 2)).first()
    assert (counts.missing, counts.empty, counts.ok, counts.examples) == (1, 2, 1, [2])


def test_tfidf(spark):
    tf = vectors.term_counts(spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "doc_id long, term string"))
    got = {(r.doc_id, r.term): r.tfidf for r in vectors.tfidf(vectors.df_filter(tf, 4, 0.0, 1.0), 4).collect()}
    assert got[1, "b"] == pytest.approx(2 / 3 * np.log(4)) and got[2, "a"] == pytest.approx(np.log(2))


EDGES = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("x", "y", 1.0)]


def test_graph(spark):
    edges = spark.createDataFrame(EDGES, "a string, b string, weight double")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    big = graph.giant(edges)
    dist = graph.distances(big)
    assert {(r.s, r.v): r.d for r in dist.collect()}["a", "d"] == 3
    assert {r.node: r.betweenness for r in graph.betweenness(big).collect()} == {"a": 0, "b": pytest.approx(2 / 3), "c": pytest.approx(2 / 3), "d": 0}
    assert {r.node: r.rcc for r in graph.residual_closeness(big, top=0).collect()}["b"] == pytest.approx(1.0)
    assert {(r.a, r.b) for r in graph.gexf_rows(edges).collect()} == {(a, b) for a, b, _ in EDGES}


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, weight double")
    assert sum(r.rank for r in graph.pagerank(edges, 20).collect()) == pytest.approx(1, abs=1e-6)
    converged = {r.node: r.rank for r in graph.pagerank(edges).collect()}
    assert converged == pytest.approx({r.node: r.rank for r in graph.pagerank(edges, 60, tolerance=None).collect()}, abs=1e-6)
    hub = graph.hits(edges, 10).collect()
    assert sum(r.hub**2 for r in hub) == pytest.approx(1, abs=1e-6)


def test_ward_and_silhouette(spark):
    rows = [(i, [float(i % 2) * 10 + i * 0.01, 1.0]) for i in range(12)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    labels = {r.vec_id: r.cluster for r in dense.cut(v, dense.ward(v), 2).collect()}
    assert {labels[i] for i in range(0, 12, 2)} != {labels[i] for i in range(1, 12, 2)} and set(labels.values()) == {1, 2}
    s = dense.silhouette(v.withColumn("label", F.col("vec_id") % 2), "label").collect()
    assert all(0.9 < r.s <= 1 for r in s)


def test_fuzzy(spark):
    a = spark.createDataFrame([("oxford uni",), ("zzz",)], "name string")
    b = spark.createDataFrame([("oxford univ",), ("other",)], "name string")
    assert [(r.a, r.b) for r in match.best_matches(a, b).collect()] == [("oxford uni", "oxford univ")]


def test_fuzzy_best_meets_every_pair(spark, tmp_path):
    import difflib
    import random

    from corpusloom.plans import registry

    rng = random.Random(3)
    base = ["university of oxford", "leeds college", "tokyo institute", "ecole normale", "kyoto", "rio state"]
    names = sorted({("x" if rng.random() < 0.4 else "") + "".join(c for c in rng.choice(base) if rng.random() > 0.1) for _ in range(60)})
    left, right = [n for i, n in enumerate(names) if i % 4 == 0], [n for i, n in enumerate(names) if i % 4]
    want = []
    for a in left:
        if found := difflib.get_close_matches(a, right, n=1, cutoff=0.6):
            want.append((a, found[0], difflib.SequenceMatcher(None, a, found[0]).ratio()))
    assert any(a[0] != b[0] for a, b, _ in want)
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, registry.QUERIES["fuzzy_best"](spark, str(tmp_path)).collect())) == sorted(want)
    frames = [spark.createDataFrame([(n,) for n in x], "name string") for x in (left + left[:2] + [None], right + right[:5] + [None])]
    got = match.best_matches(*frames, prefix=0, chunk_rows=4).collect()
    assert sorted(map(tuple, got)) == sorted(want + [w for w in want if w[0] in left[:2]])


def test_split_words_takes_long_words(spark, tmp_path):
    import re

    from corpusloom.plans import registry

    words = ["of", "amazing", "university", "research", "internationalisation"]
    merged = ["universityresearch", "internationalisationresearch", "ofamazing", "researchof", "universityxresearch", "ofofo", "of_research"]
    rows = [(i, " ".join(words)) for i in range(50)] + [(50, " ".join(merged)), (51, None), (52, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for w in set(re.findall(r"\w+", " ".join(t or "" for _, t in rows).lower())) - set(words):
        cut = next((i for i in range(2, len(w) - 2) if w[:i] in words and w[i:] in words), None)
        want += [(w, f"{w[:cut]} {w[cut:]}")] if cut else []
    assert max(len(w) for w, _ in want) > 20 and len(want) == 3
    assert sorted(map(tuple, registry.QUERIES["split_words"](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("fixes_sent", [200_000, 0])
def test_rewrite_merged_shuffles_no_pieces(spark, monkeypatch, fixes_sent):
    monkeypatch.setattr(text, "FIXES", fixes_sent)
    docs = spark.createDataFrame([(1, "labwork a, b labwork.C"), (1, "labwork"), (None, "labwork"), (2, None)], "doc_id long, text string")
    fixes = spark.createDataFrame([("labwork", "lab work", True), ("a", "a", False)], "word string, fixed string, changed boolean")
    out = text.rewrite_merged(docs, fixes)
    # Blanks and signs were rows of one key each before, and rows of one id were mixed into one text.
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = [(1, "lab work a, b lab work. C", 2), (1, "lab work", 1), (None, "lab work", 1), (2, "", 0)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
