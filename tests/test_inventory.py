"""Cleaning, joins, aggregations, pages, matrices and graphs on fixtures with answers worked out by hand or by brute force."""

import difflib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html, tables
from corpusloom.functions.stem import stem
from corpusloom.operators import aggregate, clean, dense, graph, joins, text, vectors
from corpusloom.sources import features


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clean(spark):
    df = spark.createDataFrame([(" A\t", "\n a"), ("B", " . "), ("C", "\t"), ("D", None), (None, " x\n"), ("E", "text")], "name string, description string")
    kept = clean.described(df)
    assert rows(kept) == rows(spark.createDataFrame([(None, "x"), ("E", "text")], "name string, description string"))
    assert tuple(clean.removed(df, kept).first()) == (6, 2, 4)
    assert clean.non_blank(df, "description").count() == 4
    assert clean.without_values(df, "name", ["B", "C"]).count() == 4
    assert clean.complete(df, "name", "description").count() == 4
    ranks = spark.createDataFrame([("=12",), ("101–150",), ("101-150 ",), ("500+",), ("N/A",), ("",), (None,), ("\t7 ",)], "r string")
    assert [r[0] for r in ranks.select(clean.rank_value(F.col("r"))).collect()] == [12, 101, 101, 500, None, None, None, 7]
    names = spark.createDataFrame([("The University of Oxford",), ("Aix-Marseille University",), ("Theatre",), (None,)], "n string")
    assert [r[0] for r in names.select(clean.normal_name(F.col("n"))).collect()] == ["oxford", "aix marseille", "theatre", ""]
    countries = spark.createDataFrame([("France",), ("Canada",), ("Fiji",), ("Mars",), (None,)], "c string")
    assert [r[0] for r in countries.select(clean.region_of(F.col("c"))).collect()] == ["Europe", "North America", "Asia", "Other", "Other"]
    assert len(tables.COUNTRY_REGION) == 74
    keys, meta = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x", 3)], "k long, region string, rank long")
    assert rows(clean.aligned(keys, meta, "k", {"region": "Other", "rank": None})) == [(1, "x", 3), (2, "Other", None)]
    assert rows(clean.looked_up(keys, meta, "k", "region", "none")) == [(1, "x"), (2, "none")]
    assert clean.region_or_other(keys, "region") is not None


def test_joins(spark):
    left = spark.createDataFrame([("Oxford", 1), ("University of Oxford", 2), ("Leads", 3), ("Zzz", 4)], "name string, pos long")
    right = spark.createDataFrame([("The Oxford", 1), ("Leeds", 2), ("leeds", 3), ("Other", 4)], "name string, pos long")
    exact = joins.exact_matches(left, right)
    assert rows(exact) == [("University of Oxford", "The Oxford", 1.0, "Exact")]
    assert rows(joins.unmatched(left, exact, "left_name")) == [("Leads",), ("Oxford",), ("Zzz",)]
    full = joins.mapping(left, right)
    score = difflib.SequenceMatcher(None, "leads", "leeds").ratio()
    assert rows(full) == [("Leads", "Leeds", score, "Fuzzy"), ("Oxford", None, 0.0, "No Match"), ("University of Oxford", "The Oxford", 1.0, "Exact"), ("Zzz", None, 0.0, "No Match")]
    assert tuple(joins.match_report(full).first()) == (1, 1, 2, 1 + (score > 0.8), int(0.6 <= score <= 0.7), 4)
    corpus = spark.createDataFrame([("Leads", 1), ("University of Oxford", 2)], "name string, x long")
    assert rows(joins.matched_rows(corpus, full, "name")) == [("University of Oxford", 2)]


def test_levenshtein_loses_no_match(spark):
    rng = random.Random(4)
    names = ["".join(rng.choices("ab", k=rng.randrange(0, 9))) for _ in range(60)]
    left, right = sorted(set(names[:20])), sorted(set(names[20:]))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, before = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
        return row[-1]

    want = []
    for a in left:
        best = max((1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0, b) for b in right)
        want += [(a, best[1], pytest.approx(best[0]))] if best[0] >= 0.6 else []
    got = joins.levenshtein_matches(*(spark.createDataFrame([(n,) for n in x], "name string") for x in (left, right)))
    assert sorted(map(tuple, got.collect())) == want


TOKENS = [(1, "x", t) for t in "top world job job study".split()] + [(2, "x", t) for t in "none of these".split()] + [(3, "y", t) for t in "study science top finance accounting".split()]


def test_thesaurus_and_groups(spark):
    tokens = spark.createDataFrame(TOKENS, "doc_id long, source string, term string")
    scored = aggregate.thesaurus_scores(tokens, keep=["source"])
    got = {r.doc_id: (r.words, r.EXCELLENCE, r.CAREER, r.RESEARCH, r.dominant) for r in scored.collect()}
    assert got == {1: (5, 2, 2, 1, "EXCELLENCE"), 2: (3, 0, 0, 0, "Neutral"), 3: (5, 1, 0, 2, "RESEARCH")}
    cats = list(tables.THESAURUS)
    cross = {r.source: (r.EXCELLENCE, r.RESEARCH, r.Neutral, r.CAREER) for r in aggregate.crosstab(scored, "source", [*cats, "Neutral"]).collect()}
    assert cross == {"x": (1, 0, 1, 0), "y": (0, 1, 0, 0)}
    radar = {r.source: (r.EXCELLENCE, r.RESEARCH, r.axis) for r in aggregate.radar(scored, "source", cats).collect()}
    assert radar == {"x": (250.0, 125.0, 440.0), "y": (200.0, 400.0, 440.0)}
    share = {r.source: (r.EXCELLENCE, r.RESEARCH) for r in aggregate.regional_share(scored, "source", [*cats, "Neutral"]).collect()}
    assert share == {"x": (100.0, 0.0), "y": (0.0, 100.0)}
    assert rows(aggregate.word_detail(tokens, keep=["source"]))[0] == ("x", 1, "CAREER", "job", 2)
    found = {(r.doc_id, r.category): (r["count"], r.found, r.missing, r.kind) for r in aggregate.term_groups(tokens).collect()}
    assert found == {(3, "finance"): (2, ["finance", "accounting"], [], "perfect")}
    docs = {(r.category, r.term): r.docs for r in aggregate.term_documents(tokens).collect()}
    assert docs["finance", "accounting"] == 1 and docs["politics", "prime"] == 0 and len(docs) == 22
    assert rows(aggregate.perfect_by_region(aggregate.term_groups(tokens, keep=["source"]), "source")) == [("finance", "y", 1, 100.0)]


def test_overlapping_thesaurus(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, term string")
    words = aggregate.word_table(spark, {"P": ["a"], "Q": ["b", "a"]})
    assert tuple(aggregate.thesaurus_scores(tokens, words).first()) == (1, 3, 2, 3, "Q")
    assert rows(aggregate.word_detail(tokens, words)) == [(1, "P", "a", 4), (1, "Q", "b", 1)]


def test_timeline_and_pools(spark):
    tokens = spark.createDataFrame([(1, "founded"), (1, "x"), (2, "founded"), (3, "science")], "doc_id long, term string")
    docs = spark.createDataFrame([(1, "2012"), (2, "2012"), (3, "2021"), (4, "2025")], "doc_id long, year string")
    got = {(r.year, r.term): r.freq for r in aggregate.timeline(tokens, docs, "year").collect()}
    assert len(got) == 30 and got["2012", "founded"] == 6666.7 and got["2021", "science"] == 10000.0 and got["2025", "founded"] == 0.0
    first = {(r.year, r.term): r.freq for r in aggregate.timeline(tokens, docs, "year", ["founded"], first_docs=1).collect()}
    assert first["2012", "founded"] == 5000.0
    pairs = aggregate.cooccurrences(spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (2, "c")], "doc_id long, term string"), spark.createDataFrame([("a",), ("b",)], "term string"))
    assert rows(pairs) == [("a", "b", 2)]


def test_matrices(spark):
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "c", 1)], "doc_id long, term string, tf long")
    assert rows(vectors.df_elbow(tf, 4)) == [(1, "a", 50.0), (2, "b", 25.0), (3, "c", 25.0)]
    assert rows(vectors.threshold_sweep(tf, 4, (0, 0.3), 0.75)) == [(0.0, pytest.approx(100 * (1 - 4 / 12)), 3), (30.0, 50.0, 1)]
    assert tuple(vectors.vocabulary_change(tf, 4, 0.3, 0.85).first()) == (3, 1)
    w = vectors.tfidf(vectors.df_filter(tf, 4, 0, 1), 4)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "a long, b long")
    got = {(r.a, r.b): r.cosine for r in vectors.matched_cosine(w, pairs).collect()}
    a, b = 2 / 3 * np.log(2), 1 / 3 * np.log(4)
    assert got == {(1, 2): pytest.approx(a / np.hypot(a, b)), (1, 3): 0.0}
    assert rows(vectors.matched_jaccard(w, pairs)) == [(1, 2, 1, 2, 0.5), (1, 3, 0, 3, 0.0)]
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.a, r.b): r.cosine for r in vectors.matched_dense(emb, pairs).collect()} == {(1, 2): pytest.approx(2**-0.5), (1, 3): 0.0}
    sims = spark.createDataFrame([("terms", 0.5, 1), ("terms", 0.0, 3), ("embedding", 0.4, 1)], "method string, score double, times long")
    stats = {r.method: (r.mean, r.median, r.high, r.low, r.winner) for r in vectors.method_stats(sims).collect()}
    assert stats == {"terms": (0.125, 0.0, 0.5, 0.0, False), "embedding": (0.4, 0.4, 0.4, 0.4, True)}
    reports = vectors.score_reports(spark.createDataFrame([(0.1,), (0.5,), (0.9,), (0.8,), (0.3,)], "score double")).collect()
    assert [r.score for r in reports] == [0.9, 0.8, 0.1, 0.3]


PAGE = """<section class='main-content'><header class='header big'><h1> Name </h1></header><div class='details'><span class='rank'>7</span></div>
<section class='infomation'><p> One <b>b</b></p><p> </p><p>two</section><p class='region'>in <span>Asia</span></p></section>"""


def test_pages():
    assert html.ranked_record(html.tree(PAGE)) == {"rank": "7", "name": "Name", "description": "Oneb\n\ntwo", "region": "Asia"}
    assert html.ranked_record(html.tree(PAGE.replace("'rank'", "'x'")))["rank"] == "N/A"
    assert html.ranked_record(html.tree(PAGE.replace("infomation", "x"))) is None
    read = "<div class='about_section'><div class='textsection'>Some <b>text</b> <span class='read-more'>more</span></div></div>"
    assert html.section_text(html.tree(read), "about_section", "textsection") == "Some text"
    assert html.section_text(html.tree(read), "absent") is None
    assert html.cell_links(html.tree("<table><td class='a uni'><b><a href='x'>1</a></b></td><td><a href='y'></a>"), "uni") == ["x"]
    assert html.pane_record(html.tree("<p>x")) is None
    state = html.parse("<script id='s'>{\"a\": \"<b>\"}</script><h1></h1><h1>T <i>u</i></h1>", script="s")
    assert state[1] == "T u" and state[2] == '{"a": "<b>"}'
    assert html.parse("<p>" * 200_000 + "</x>" * 200_000 + "<div>" * 200_000)[0] is None


def test_rewrite_merged_matches_a_plain_loop(spark):
    known = {"lab", "work", "research", "centre", "of", "the"}
    texts = ["Labwork of researchcentre,here", "labwork1 élabwork lab-work LABWORK.x", "ofthe of\nthe;ofthe", "", None, "cross-labwork ab-cé"]

    def fix(word):
        low = word.lower()
        if len(word) < 5 or low in known:
            return word, 0
        cut = next((i for i in range(2, len(word) - 2) if low[:i] in known and low[i:] in known), None)
        if cut is None:
            return word, 0
        return (low[:cut].capitalize() if word[0].isupper() else low[:cut]) + " " + low[cut:], 1

    want, total = [], 0
    for t in texts:
        if t is None:
            want.append((None, 0))
            continue
        n = 0

        def replaced(m):
            nonlocal n
            out, changed = fix(m.group())
            n += changed
            return out

        new = re.sub(r"\b[a-zA-Z]+(?:-[a-zA-Z]+)*\b", replaced, t)
        want.append((re.sub(r"([.,!?;:])([a-zA-Z])", r"\1 \2", new), n))
        total += n
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+(?:-[a-zA-Z]+)*"), F.lit(0))).alias("word"))
    fixes = text.split_words(words, spark.createDataFrame([(w,) for w in known], "word string"))
    out = text.rewrite_merged(docs, fixes)
    got = {r.doc_id: (r.text, r.n_changes) for r in out.collect()}
    assert total > 3 and {i: got[i] for i in range(len(texts)) if texts[i] is not None} == {i: w for i, w in enumerate(want) if texts[i] is not None}
    assert clean.total_changes(out).first()[0] == total


def test_token_modes(spark):
    docs = spark.createDataFrame([(1, "Universities study studies; the study's studying")], "doc_id long, text string")
    got = [(r.pos, r.term, r.stem, r.lemma) for r in text.token_modes(docs).orderBy("pos").collect()]
    assert got == [(k, t, stem(t), lemma) for k, (t, lemma) in enumerate([("universities", "universities"), ("study", "study"), ("studies", "study"), ("study", "study"), ("studying", "studying")])]


def test_graph_against_brute_force(spark):
    rng = random.Random(9)
    names = list("abcdefgh")
    edges = [(a, b, round(rng.random() + 0.1, 3)) for a, b in itertools.combinations(names, 2) if rng.random() < 0.35 or ord(b) - ord(a) == 1]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    near = {v: {y for x, y, _ in edges if x == v} | {x for x, y, _ in edges if y == v} for v in names}

    def paths(s, t):
        best, todo = [], [[s]]
        while todo and not best:
            best = [p for p in todo if p[-1] == t]
            todo = [p + [v] for p in todo for v in near[p[-1]] if v not in p]
        return best

    between = dict.fromkeys(names, 0.0)
    for s, t in itertools.combinations(names, 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                between[v] += 1 / len(found)
    assert {r.node: r.betweenness for r in graph.betweenness(df, normalised=False).collect()} == pytest.approx(between, abs=1e-7)

    def residual(gone):
        total = 0.0
        for s in names:
            seen, front, d = {s, gone}, {s}, 0
            while front and s != gone:
                d += 1
                front = {v for u in front for v in near[u]} - seen
                seen |= front
                total += len(front) * 2.0**-d
        return total

    assert {r.node: r.rcc for r in graph.residual_closeness(df, top=0).collect()} == pytest.approx({v: residual(v) for v in names})
    frame = {r.node: (r.degree, r.label) for r in graph.degree_and_katz(df, 0.01, labelled=2).collect()}
    assert {v: n for v, (n, _) in frame.items()} == {v: len(near[v]) for v in names} and sum(label is not None for _, label in frame.values()) == 2
    adjacency = np.array([[float(v in near[u]) for v in names] for u in names])
    want = np.linalg.inv(np.eye(8) - 0.01 * adjacency).sum(axis=1) - 1
    assert {r.node: r.katz for r in graph.katz(df).collect()} == pytest.approx(dict(zip(names, want)), abs=1e-9)
    label = {v: k % 2 for k, v in enumerate(names)}
    leaders = graph.leaders(df, spark.createDataFrame(list(label.items()), "node string, community int"), k=10).collect()
    assert {r.node: r.degree for r in leaders} == {v: n for v in names if (n := sum(label[u] == label[v] for u in near[v]))}


def test_louvain_reaches_the_modularity_of_the_planted_split(spark):
    rng = random.Random(2)
    names = [f"{c}{i:02d}" for c in "xyz" for i in range(12)]
    edges = [(a, b, 1.0) for a, b in itertools.combinations(names, 2) if rng.random() < (0.7 if a[0] == b[0] else 0.05)]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    degree = {v: sum(v in e for e in edges) for v in names}

    def modularity(label):
        m = len(edges)
        return sum(label[a] == label[b] for a, b, _ in edges) / m - sum(sum(degree[v] for v in names if label[v] == c) ** 2 for c in set(label.values())) / (4 * m * m)

    assert modularity(got) >= modularity({v: v[0] for v in names}) - 1e-9


def test_sweep_and_profile(spark):
    points = [(i, [np.cos(i % 3 * 2 + i * 0.001), np.sin(i % 3 * 2 + i * 0.001)]) for i in range(18)]
    v = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in points], "vec_id long, embedding array<double>")
    scores = {r.k: r.silhouette for r in dense.sweep(v, dense.ward(v), [2, 3, 5]).collect()}
    assert max(scores, key=scores.get) == 3 and scores[3] > 0.9
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, cluster int")
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "doc_id long, term string")
    regions = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, region string")
    sil = spark.createDataFrame([(1, 0.5), (2, 0.7)], "doc_id long, s double")
    got = {r.cluster: (r.size, r.silhouette, r.terms, r.region, r.share, r.examples) for r in aggregate.cluster_profile(labels, tokens, regions, sil).collect()}
    assert got == {0: (2, pytest.approx(0.6), ["b", "a"], "x", 100.0, [1, 2]), 1: (1, None, ["c"], "y", 100.0, [3])}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', "é"), (2, None, "")], "k long, t string, u string")
    features.write_csv(df, f"{tmp_path}/c")
    assert rows(features.read_csv(spark, f"{tmp_path}/c", df.schema.simpleString()[7:-1].replace(":", " "))) == rows(df)
    features.write_parquet(df, f"{tmp_path}/p", "u")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    assert features.mode_paths("the_2012", "/d")[0].startswith("/d/JSON")
    with pytest.raises(ValueError, match="one of qs, the"):
        features.mode_paths("x", "/d")
    assert features.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/c"]) == f"{tmp_path}/c"
