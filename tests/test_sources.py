"""Readers and writers on small files with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.html import embedded_rows
from corpusloom.sources import features


def test_score_nodes(spark, tmp_path):
    node = {"title": "A", "path": "/a", "rank_display": "=1", "region": "Europe", "country": "France"}
    (tmp_path / "p0.json").write_text(json.dumps({"score_nodes": [node, node | {"title": "B", "path": "https://b.example/b", "region": None}]}, indent=1))
    (tmp_path / "p1.json").write_text(json.dumps({"score_nodes": []}))
    got = features.read_score_nodes(spark, [str(tmp_path / f"p{k}.json") for k in (0, 1)], "https://a.example").collect()
    assert [tuple(r) for r in got] == [
        ("A", "https://a.example/a", "=1", "Europe", "France"), ("B", "https://b.example/b", "=1", None, "France"),
    ]


def test_embedded_rows(spark):
    state = json.dumps({"props": {"data": [{"name": "A", "rank": 1}, {"name": "B"}]}})
    rows = [(1, f"<p>x</p><script id=__NEXT_DATA__>{state}</script>"), (2, "<script id='__NEXT_DATA__'>{broken</script>"), (3, "<p>none</p>"), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = embedded_rows(pages, ("props", "data"), "name string, rank int")
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, "A", 1), (1, "B", None)]
    assert embedded_rows(pages.filter("page_id > 9"), ("props", "data"), "name string").count() == 0
    assert embedded_rows(pages, ("props",), "name string").count() == 0


def test_features_round_trip(spark, tmp_path):
    doc = {"info": {"n_docs": 2}, "tokens": {"A": ["x", "y"], "B": []}, "regions": {"A": "Europe"}, "ranks": {"A": 1.0, "B": None}}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=4))
    tokens, docs = features.read_features(spark, str(tmp_path / "f.json"))
    assert sorted(map(tuple, tokens.collect())) == [("A", 0, "x"), ("A", 1, "y")]
    assert sorted(map(tuple, docs.collect())) == [("A", "Europe", 1.0), ("B", None, None)]


def test_features_json_keeps_term_order(spark):
    top = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "c", 1)], "doc_id long, term string, rank int")
    docs = spark.createDataFrame([(1, " ", 7)], "doc_id long, lang string, n_chars long")
    assert json.loads(features.features_json(top, docs).first().json) == {"tokens": ["c", "b", "a"], "region": "Other", "rank": 7}


def test_union_of_existing_sources(spark, tmp_path):
    spark.range(2).select(F.col("id"), F.lit("t").alias("text")).write.parquet(str(tmp_path / "one"))
    spark.range(1).write.parquet(str(tmp_path / "two"))
    paths = {"one": str(tmp_path / "one"), "two": str(tmp_path / "two"), "none": str(tmp_path / "none")}
    got = features.union_sources(spark, paths).groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("t")).collect()
    assert {r.source: (r.n, r.t) for r in got} == {"one": (2, 2), "two": (1, 0)}
    with pytest.raises(FileNotFoundError):
        features.union_sources(spark, {"none": paths["none"]})


def test_csv_html_and_text_column(spark, tmp_path):
    (tmp_path / "c.csv").write_text('name,description\nA,"two\nlines, ""quoted"""\n')
    table = features.read_csv(spark, str(tmp_path / "c.csv"), "name string, description string")
    assert [tuple(r) for r in table.collect()] == [("A", 'two\nlines, "quoted"')]
    assert features.text_column(table) == "description" and features.text_column(table.select("name")) == "name"
    with pytest.raises(ValueError):
        features.text_column(spark.range(1))
    (tmp_path / "p.html").write_text("<p>a\nb</p>")
    assert features.read_html(spark, str(tmp_path / "p.html")).first().html == "<p>a\nb</p>"


def test_label_rows(spark):
    labels = spark.createDataFrame([("A", "{'X': 2, 'Y': 3, 'Z': 3}")], "University string, Full_Scores string")
    row = features.label_rows(labels).first()
    assert row.dominant == "Y" and row.intensity == 3 and row.scores == {"X": 2, "Y": 3, "Z": 3}
