"""Readers and writers (S3, S6-S13, O1-O4): explicit schemas, path fallbacks, the features document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "info struct<n_docs:bigint>, tokens map<string,array<string>>, regions map<string,string>, ranks map<string,double>"
NODES = "score_nodes array<struct<title:string,path:string,rank_display:string,region:string,country:string>>"


NULL_TEXT = "\\N"
#: The corpora by mode, as (features, descriptions) paths below a data folder.
MODES = {
    "qs": ("JSON/features_qs.json", "PARQUET/corpus_qs.parquet"),
    "the": ("JSON/features_the.json", "PARQUET/corpus_the.parquet"),
    "the_2012": ("JSON/features_the_2012.json", "PARQUET/corpus_the_2012.parquet"),
    "the_2021": ("JSON/features_the_2021.json", "PARQUET/corpus_the_2021.parquet"),
}


def mode_paths(mode: str, root: str, modes: dict[str, tuple[str, str]] = MODES) -> tuple[str, str]:
    """The paths of a mode; an unknown one is an error that names the known ones."""
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(sorted(modes))}")
    features, corpus = modes[mode]
    return f"{root}/{features}", f"{root}/{corpus}"


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of the paths that exists."""
    have = existing(spark, paths)
    if not have:
        raise FileNotFoundError(f"none of {', '.join(paths)} exists")
    return have[0]


def write_csv(df: DataFrame, path: str) -> None:
    """O1: CSV files with a header, as read_csv expects them: quotes doubled, blanks and line feeds kept, an empty string
    in quotes and a null as NULL_TEXT."""
    out = df.write.mode("overwrite").option("header", True).option("escape", '"')
    out.option("nullValue", NULL_TEXT).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    """O2: Parquet files, in folders by the values of the columns `by` if given."""
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """O3: JSON lines, letters of all scripts as they are."""
    df.write.mode("overwrite").json(path)


def features_json(top: DataFrame, docs: DataFrame) -> DataFrame:
    """O3: one (doc_id, json) a document: its terms in order, region and rank."""
    terms = top.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("tokens"))
    rows = terms.join(docs.select("doc_id", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("Other")).alias("region"), F.col("n_chars").alias("rank")), "doc_id")
    return rows.select("doc_id", F.to_json(F.struct("tokens", "region", "rank")).alias("json"))


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tokens: name, pos, term) and (docs: name, region, rank) of a features document."""
    raw = spark.read.schema(FEATURES).json(path, multiLine=True)
    tokens = raw.select(F.explode("tokens").alias("name", "list")).select("name", F.posexplode("list").alias("pos", "term"))
    regions = raw.select(F.explode("regions").alias("name", "region"))
    ranks = raw.select(F.explode("ranks").alias("name", "rank"))
    return tokens, regions.join(ranks, "name", "full_outer")


def read_score_nodes(spark: SparkSession, paths: Sequence[str], base: str, lines: bool = False) -> DataFrame:
    """S3: one row a node of saved API pages, relative paths made absolute; a page a file, or a line of one."""
    raw = spark.read.schema(NODES).json(list(paths), multiLine=not lines)
    node = raw.select(F.explode("score_nodes").alias("n")).select("n.*")
    url = F.when(F.col("path").startswith("/"), F.concat(F.lit(base), F.col("path"))).otherwise(F.col("path"))
    return node.select("title", url.alias("url"), F.col("rank_display").alias("rank"), "region", "country")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header; a blank field and NULL_TEXT are null, an empty string in quotes is one."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', nullValue=NULL_TEXT)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html), a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that any of Spark's file systems has."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, a in zip(paths, at) if a.getFileSystem(conf).exists(a)]


def union_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet sources that exist, by name, in one table with a `source` column."""
    have = existing(spark, list(paths.values()))
    parts = [spark.read.parquet(p).withColumn("source", F.lit(name)) for name, p in paths.items() if p in have]
    if not parts:
        raise FileNotFoundError("none of the sources exists")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def text_column(df: DataFrame, candidates: Sequence[str] = ("description", "QS_description", "text")) -> str:
    """The first candidate the table has, else its first string column."""
    types = dict(df.dtypes)
    found = next((c for c in candidates if c in types), None) or next((c for c, t in df.dtypes if t == "string"), None)
    if found is None:
        raise ValueError("no text column")
    return found


def label_rows(labels: DataFrame) -> DataFrame:
    """The label file's Full_Scores text as a map, with its first highest entry."""
    scores = F.from_json(F.replace("Full_Scores", F.lit("'"), F.lit('"')), "map<string,int>")
    best = F.array_max(F.map_values("scores"))
    first = F.element_at(F.filter(F.map_entries("scores"), lambda e: e["value"] == best), 1)["key"]
    return labels.withColumn("scores", scores).withColumns({"dominant": first, "intensity": best})
