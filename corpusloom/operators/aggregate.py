"""Counts, trends, thesaurus scores and term groups (A1-A20) over token tables (doc_id, term, and grouping columns)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.tables import TERM_GROUPS, THESAURUS, TIMELINE_DOCS, TIMELINE_WORDS


def word_table(spark: SparkSession, groups: Mapping[str, Sequence[str]], name: str = "category") -> DataFrame:
    """(category, cat_pos, word_pos, term) of a dictionary of word lists: a parameter of fixed size."""
    rows = [(g, i, j, w) for i, (g, words) in enumerate(groups.items()) for j, w in enumerate(words)]
    return spark.createDataFrame(rows, f"{name} string, cat_pos int, word_pos int, term string")


def pooled(tokens: DataFrame, pool: Column, name: str) -> DataFrame:
    """A2: token counts of each term in each pool."""
    return tokens.groupBy(pool.alias(name), "term").agg(F.count("*").alias("n"))


def pool_sizes(tokens: DataFrame, *by: str) -> DataFrame:
    """A3: tokens and documents of each group."""
    return tokens.groupBy(*by).agg(F.count("*").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"))


def median_by(df: DataFrame, column: str, *by: str) -> DataFrame:
    """A4: the exact median and the number of non-null values; null and 0 for a group without any."""
    return df.groupBy(*by).agg(F.median(F.col(column).cast("double")).alias("median"), F.count(column).alias("n"))


def largest_groups(tokens: DataFrame, by: str, floor: int = 1000, k: int = 8, batch: int = 4) -> DataFrame:
    """A5: the k groups of most tokens, of those with more than `floor`, in batches; ties by name."""
    sizes = tokens.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > floor)
    top = sizes.orderBy(F.desc("n"), by).limit(k)  # ranks are taken of k rows only
    rank = F.row_number().over(Window.orderBy(F.desc("n"), by))
    return top.select(by, "n", F.floor((rank - 1) / batch).cast("int").alias("batch"))


def top_terms(tokens: DataFrame, k: int) -> DataFrame:
    """A1: the k most frequent terms, ties alphabetical."""
    return tokens.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def ranked_terms(tokens: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms with their place from 1."""
    return top_terms(tokens, k).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "term")))


def cooccurrences(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b, n), a < b: in how many documents both of two of the words are."""
    own = tokens.join(F.broadcast(words.select("term")), "term", "left_semi").select("doc_id", "term").distinct()
    lists = own.groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("w"))  # at most as many as words
    pairs = F.flatten(F.transform("w", lambda a, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def timeline(tokens: DataFrame, docs: DataFrame, by: str, words: Sequence[str] = TIMELINE_WORDS, first_docs: int | None = TIMELINE_DOCS, order: str = "doc_id") -> DataFrame:
    """(by, term, freq): occurrences of each word per 10,000 tokens of each snapshot's first documents, to one
    place; 0 for a snapshot without tokens."""
    chosen = docs.select(by, F.col(order).alias("at"), "doc_id")
    if first_docs is not None:
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("at"))).filter(F.col("r") <= first_docs)
    read = tokens.select("doc_id", "term").join(chosen.select("doc_id", by), "doc_id")
    hits = [F.count_if(F.col("term") == w).alias(f"w{k}") for k, w in enumerate(words)]
    counts = chosen.select(by).distinct().join(read.groupBy(by).agg(F.count("*").alias("total"), *hits), by, "left")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"w{k}").alias("n")) for k, w in enumerate(words)])).alias("x")
    freq = F.round(F.coalesce(F.try_divide(F.col("x.n") * 10000, F.col("total")), F.lit(0.0)), 1)
    return counts.select(by, "total", each).select(by, "x.term", freq.alias("freq"))


def _categories(thesaurus: DataFrame) -> list[str]:
    """Categories in order; a thesaurus is a parameter table, so its categories are few."""
    return [r.category for r in thesaurus.groupBy("category").agg(F.min("cat_pos").alias("p")).orderBy("p").collect()]


def thesaurus_scores(tokens: DataFrame, thesaurus: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., words, a count for each category, dominant) for each document with tokens.

    A token counts in every category that lists it. Dominant is the category of the highest count, ties to the earlier
    one, "Neutral" if all are 0. The thesaurus is (category, cat_pos, term).
    """
    thesaurus = word_table(tokens.sparkSession, THESAURUS) if thesaurus is None else thesaurus
    names = _categories(thesaurus)
    lists = thesaurus.groupBy("term").agg(F.collect_set("category").alias("cats"))
    met = tokens.join(F.broadcast(lists), "term", "left")
    counts = [F.count_if(F.coalesce(F.array_contains("cats", c), F.lit(False))).alias(c) for c in names]
    scored = met.groupBy("doc_id", *keep).agg(F.count("*").alias("words"), *counts)
    most = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    dominant = F.when(most == 0, "Neutral")
    for c in names:
        dominant = dominant.when(F.col(c) == most, c)
    return scored.withColumn("dominant", dominant)


def word_detail(tokens: DataFrame, thesaurus: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., doc_id, category, term, n): thesaurus words of each document, under the first category that lists
    them; a word counts once for each category that does."""
    thesaurus = word_table(tokens.sparkSession, THESAURUS) if thesaurus is None else thesaurus
    first = thesaurus.groupBy("term").agg(F.min_by("category", "cat_pos").alias("category"), F.countDistinct("category").alias("listed"))
    met = tokens.join(F.broadcast(first), "term").groupBy(*keep, "doc_id", "category", "term", "listed").agg(F.count("*").alias("times"))
    return met.select(*keep, "doc_id", "category", "term", (F.col("times") * F.col("listed")).alias("n"))


def crosstab(scored: DataFrame, by: str, categories: Sequence[str]) -> DataFrame:
    """Documents by group and dominant category, 0 where there is none."""
    return scored.groupBy(by).pivot("dominant", list(categories)).count().fillna(0, list(categories))


def radar(scored: DataFrame, by: str, categories: Sequence[str]) -> DataFrame:
    """Each category per 1000 words of the group, to two places, and the chart's limit: 1.1 times the highest."""
    sums = scored.groupBy(by).agg(F.sum("words").alias("words"), *[F.sum(c).alias(c) for c in categories])
    rates = sums.select(by, *[(F.col(c) * 1000 / F.col("words")).alias(c) for c in categories])
    limit = rates.agg(F.max(F.greatest(*categories)).alias("top"))  # one row
    return rates.crossJoin(F.broadcast(limit)).select(by, *[F.round(c, 2).alias(c) for c in categories], F.round(F.col("top") * 1.1, 2).alias("axis"))


def regional_share(scored: DataFrame, by: str, categories: Sequence[str], exclude: Sequence[str] = ("CAREER", "Neutral"), only: Sequence[str] | None = None) -> DataFrame:
    """A column for each dominant category: its share of the region's documents in percent, to one place, after
    the excluded categories are gone; 0 where there is none. `only` names regions to look at."""
    names = [c for c in categories if c not in exclude]
    rows = scored.filter(F.col("dominant").isin(*names))
    rows = rows.filter(F.col(by).isin(*only)) if only is not None else rows
    counts = rows.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col("dominant") == c).alias(c) for c in names])
    return counts.select(by, *[F.round(F.col(c) * 100 / F.col("total"), 1).alias(c) for c in names])


def term_groups(tokens: DataFrame, groups: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., category, count, found, missing, kind) for each document and group that it has a word
    of: the words it has and lacks, in the group's order, and whether that is all of them (perfect) or not (partial)."""
    groups = word_table(tokens.sparkSession, TERM_GROUPS) if groups is None else groups
    words = groups.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_pos", "term"))), lambda x: x["term"]).alias("wanted"))
    listed = groups.groupBy("term").agg(F.collect_set("category").alias("cats"))
    own = tokens.join(F.broadcast(listed), "term").groupBy("doc_id", *keep).agg(F.collect_set("term").alias("have"), F.flatten(F.collect_set("cats")).alias("cats"))
    met = own.select("doc_id", *keep, "have", F.explode(F.array_distinct("cats")).alias("category")).join(F.broadcast(words), "category")
    found = F.array_intersect("wanted", "have")
    out = met.select("doc_id", *keep, "category", F.size(found).alias("count"), found.alias("found"), F.array_except("wanted", "have").alias("missing"))
    return out.withColumn("kind", F.when(F.size("missing") == 0, "perfect").otherwise("partial"))


def best_partial(found: DataFrame, k: int = 20) -> DataFrame:
    """Of each group the k partial matches with most words, ties by document."""
    order = Window.partitionBy("category").orderBy(F.desc("count"), "doc_id")
    return found.filter("kind = 'partial'").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def term_documents(tokens: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """In how many documents each word of each group is, 0 included."""
    groups = word_table(tokens.sparkSession, TERM_GROUPS) if groups is None else groups
    counts = tokens.join(F.broadcast(groups.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.countDistinct("doc_id").alias("docs"))
    return groups.select("category", "term").join(counts, "term", "left").select("category", "term", F.coalesce("docs", F.lit(0)).alias("docs"))


def perfect_by_region(found: DataFrame, region: str) -> DataFrame:
    """Perfect matches of each group by region, and their share in percent."""
    counts = found.filter("kind = 'perfect'").groupBy("category", region).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("category"))
    return counts.select("category", region, "n", F.round(F.col("n") * 100 / total, 6).alias("pct"))


def cluster_profile(labels: DataFrame, tokens: DataFrame, regions: DataFrame, silhouettes: DataFrame, terms: int = 5, examples: int = 3) -> DataFrame:
    """One row a cluster: its most frequent terms, its most frequent region with that region's share in percent,
    its first documents, size and mean silhouette. labels is (doc_id, cluster), the others are by doc_id."""
    counts = labels.join(tokens, "doc_id").groupBy("cluster", "term").agg(F.count("*").alias("n"))
    by_n = Window.partitionBy("cluster").orderBy(F.desc("n"), "term")
    top = counts.withColumn("r", F.row_number().over(by_n)).filter(F.col("r") <= terms)
    words = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    by_region = labels.join(regions, "doc_id").groupBy("cluster", "region").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("cluster").orderBy(F.desc("n"), "region")
    total = F.sum("n").over(Window.partitionBy("cluster"))
    mode = by_region.select("cluster", "region", F.round(F.col("n") * 100 / total, 6).alias("share"), F.row_number().over(rank).alias("r")).filter("r = 1").drop("r")
    first = Window.partitionBy("cluster").orderBy("doc_id")
    shown = labels.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= examples).groupBy("cluster").agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    sizes = labels.join(silhouettes, "doc_id", "left").groupBy("cluster").agg(F.count("*").alias("size"), F.avg("s").alias("silhouette"))
    return sizes.join(words, "cluster", "left").join(mode, "cluster", "left").join(shown, "cluster", "left")
