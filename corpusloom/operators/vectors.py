"""Term-document operators (M): sparse long tables, never wide ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import blocks
from corpusloom.session import Table, ship

#: Kept terms up to this number are with each task that ranks them.
LISTED = 200_000


def term_counts(tokens: DataFrame) -> DataFrame:
    """M1: (doc_id, term, tf)."""
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def counted(lists: DataFrame) -> DataFrame:
    """M1 in one row a document: (doc_id, terms, tf) of (doc_id, w), w being all terms of a row in a list; each distinct
    term once. Terms are counted within their row; rows of one id are joined to one first."""
    ship(lists.sparkSession)
    rows, ids = lists.agg(F.count("*"), F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).first()
    if rows > (ids or 0):
        lists = lists.groupBy("doc_id").agg(F.flatten(F.collect_list("w")).alias("w"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            words = batch.column(1).flatten().dictionary_encode()
            width = max(1, len(words.dictionary))
            cell = np.repeat(np.arange(len(batch)), np.diff(ends)) * width + words.indices.to_numpy(zero_copy_only=False)
            cell, times = np.unique(cell, return_counts=True)
            at = pa.array(np.searchsorted(cell, np.arange(len(batch) + 1) * width).astype(np.int32))
            terms, tf = words.dictionary.take(pa.array(cell % width)), pa.array(times.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, tf)], ["doc_id", "terms", "tf"])

    kind = lists.schema["doc_id"].dataType.simpleString()
    return lists.select("doc_id", "w").mapInArrow(count, f"doc_id {kind}, terms array<string>, tf array<int>")


def counts_of(documents: DataFrame) -> DataFrame:
    """M1: (doc_id, term, tf) of `counted` rows."""
    cell = F.explode(F.arrays_zip("terms", "tf")).alias("c")
    return documents.select("doc_id", cell).select("doc_id", F.col("c.terms").alias("term"), F.col("c.tf").cast("long").alias("tf"))


def kept_terms(tf: DataFrame, n_docs: int, low: float = 0.02, high: float = 0.75) -> DataFrame:
    """M2: (term, df) of terms with low * N <= df <= high * N; N counts all documents, empty ones too."""
    return tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df").between(F.lit(low * n_docs), F.lit(high * n_docs)))


def df_filter(tf: DataFrame, n_docs: int, low: float = 0.02, high: float = 0.75) -> DataFrame:
    """M2: rows of the terms that kept_terms keeps, with their document frequency."""
    return tf.join(kept_terms(tf, n_docs, low, high), "term")


def tfidf(kept: DataFrame, n_docs: int) -> DataFrame:
    """M5: count over the document's kept count, times ln(N / df), unsmoothed."""
    total = F.sum("tf").over(Window.partitionBy("doc_id"))
    return kept.select("doc_id", "term", "tf", "df", (F.col("tf") / total * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("tfidf"))


def top_k(weights: DataFrame, k: int = 100) -> DataFrame:
    """M6: each document's k heaviest terms above 0; ties by term after rounding to 12 places."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("tfidf", 12)), "term")
    return weights.filter("tfidf > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_lists(documents: DataFrame, kept: DataFrame, n_docs: int, k: int = 100) -> DataFrame:
    """M6 in one row a document: (doc_id, terms) of `counted` rows and kept terms (term, df), heaviest first; documents
    without any have no row. Weights are worked out within a row, the kept terms being with each task."""
    ship(documents.sparkSession)
    if kept.count() > LISTED:
        best = top_k(tfidf(counts_of(documents).join(kept, "term"), n_docs), k).groupBy("doc_id")
        return best.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    known = sorted(map(tuple, kept.select("term", F.log(F.lit(float(n_docs)) / F.col("df"))).collect()))  # LISTED at most
    names, idf = pa.array([t for t, _ in known], pa.string()), np.array([w for _, w in known], float)

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            at = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=names), -1).to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(ends))[at >= 0]
            tf, at = batch.column(2).flatten().to_numpy()[at >= 0], at[at >= 0]
            weight = tf / np.bincount(row, tf, len(batch))[row] * idf[at]
            row, at, weight = row[weight > 0], at[weight > 0], weight[weight > 0]
            order = np.lexsort((at, -np.round(weight, 12), row))
            row, at = row[order], at[order]
            first = np.searchsorted(row, np.arange(len(batch)))
            row, at = (x[np.arange(len(row)) - first[row] < k] for x in (row, at))
            found = np.unique(row)
            cuts = np.append(np.searchsorted(row, found), len(row)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), names.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found)), lists], ["doc_id", "terms"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "terms", "tf").mapInArrow(best_of, f"doc_id {kind}, terms array<string>")


def sparsity(kept: DataFrame, n_docs: int) -> DataFrame:
    """M3: the share of empty cells of the matrix in percent; null without terms."""
    shape = kept.agg(F.count("*").alias("nnz"), F.countDistinct("term").alias("terms"))
    return shape.select((100 * (1 - F.try_divide(F.col("nnz"), F.col("terms") * F.lit(float(n_docs))))).alias("sparsity"))


def threshold_sweep(tf: DataFrame, n_docs: int, lows: Sequence[float] = (0, 0.01, 0.02, 0.03, 0.04, 0.05), high: float = 0.75) -> DataFrame:
    """M4: (threshold in percent, sparsity, words) for each lower bound: one aggregate over the terms, no join."""
    df = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") <= F.lit(high * n_docs))
    sums = [f(F.when(F.col("df") >= F.lit(low * n_docs), F.col("df"))).alias(f"{n}{k}") for k, low in enumerate(lows) for n, f in (("s", F.sum), ("w", F.count))]
    each = F.array(*[F.struct(F.lit(100.0 * low).alias("threshold"), F.col(f"s{k}").alias("s"), F.col(f"w{k}").alias("words")) for k, low in enumerate(lows)])
    rows = df.agg(*sums).select(F.explode(each).alias("x")).select("x.*")
    return rows.select("threshold", (100 * (1 - F.try_divide(F.col("s"), F.col("words") * F.lit(float(n_docs))))).alias("sparsity"), "words")


def df_elbow(tf: DataFrame, n_docs: int) -> DataFrame:
    """M4: (place, term, pct): all terms by the share of documents that have them, places from 1, ties by term."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return places(df, F.desc("df"), F.col("term")).select("place", "term", (F.col("df") * 100 / F.lit(float(n_docs))).alias("pct"))


def places(df: DataFrame, *order: Column) -> DataFrame:
    """df with a column `place` from 1 in the order, which has to be total: a range sort, then an offset for each of its
    partitions, so that no task sees all rows."""
    sorted_ = Table(df.orderBy(*order).withColumn("part", F.spark_partition_id())).df
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("rows"))  # a row a partition
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return sorted_.withColumn("local", local).join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + F.col("local")).drop("part", "local", "before")


def vocabulary_change(tf: DataFrame, n_docs: int, low: float = 0.02, high: float = 0.85) -> DataFrame:
    """M4: (n_before, n_after): terms before and after the filter."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    inside = F.col("df").between(F.lit(low * n_docs), F.lit(high * n_docs))
    return df.agg(F.count("*").alias("n_before"), F.count_if(inside).alias("n_after"))


def binarised(weights: DataFrame, above: float = 0.0, value: str = "tfidf") -> DataFrame:
    """M7: (doc_id, term) of the cells above a threshold."""
    return weights.filter(F.col(value) > above).select("doc_id", "term")


def aligned_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """M8: (term, left_n, right_n) over the union of two vocabularies (term, n), 0 where a side lacks the term."""
    a, b = left.select("term", F.col("n").alias("left_n")), right.select("term", F.col("n").alias("right_n"))
    return a.join(b, "term", "full").fillna(0, ["left_n", "right_n"])


def unit_weights(weights: DataFrame, value: str = "tfidf") -> DataFrame:
    """(doc_id, term, u): weights over their document's length; documents of length 0 have no row."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy("doc_id")))
    return weights.withColumn("norm", norm).filter("norm > 0").select("doc_id", "term", (F.col(value) / F.col("norm")).alias("u"))


def cosine_rows(weights: DataFrame, value: str = "tfidf") -> DataFrame:
    """(id, terms, u): the unit rows of documents, terms by number, as blocks take them."""
    unit = Table(unit_weights(weights, value)).df
    names = Table(unit.select("term").distinct().withColumn("n", F.monotonically_increasing_id())).df
    cells = unit.join(names, "term").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("n", "u")).alias("c"))
    return Table(cells.select("id", F.col("c.n").alias("terms"), F.col("c.u").alias("u"))).df


def cosine_pairs(weights: DataFrame, value: str = "tfidf", places: int | None = None) -> DataFrame:
    """M9: (a, b, score), a < b, of documents that share a term, in blocks of two chunks; all others score 0."""
    return blocks.scored_pairs(cosine_rows(weights, value), "terms", blocks.sparse_cosine(places))


def jaccard_pairs(sets: DataFrame, places: int | None = None) -> DataFrame:
    """(a, b, i, u, score), a < b, of documents that share a term: shared terms, all terms of both and their ratio, in
    blocks of two chunks. (doc_id, term) is unique."""
    names = Table(sets.groupBy("term").agg(F.count("*").alias("f")).withColumn("n", F.monotonically_increasing_id())).df
    # A term of one document only counts in the number of its terms.
    met = sets.join(names, "term").groupBy(F.col("doc_id").alias("id"))
    rows = met.agg(F.collect_list(F.when(F.col("f") > 1, F.col("n"))).alias("terms"), F.array(F.count("*")).alias("size"))
    return blocks.scored_pairs(Table(rows).df, "terms", blocks.jaccard(places), "i long, u long, score double")


def matched_cosine(weights: DataFrame, mapping: DataFrame, value: str = "tfidf") -> DataFrame:
    """(a, b, cosine) of the mapping's pairs whose documents both have weights; 0 without a common term."""
    have = weights.select("doc_id").distinct()
    pairs = mapping.select("a", "b").join(have.select(F.col("doc_id").alias("a")), "a", "left_semi").join(have.select(F.col("doc_id").alias("b")), "b", "left_semi")
    unit = unit_weights(weights, value)
    x = unit.select(F.col("doc_id").alias("a"), "term", F.col("u").alias("x"))
    y = unit.select(F.col("doc_id").alias("b"), "term", F.col("u").alias("y"))
    sums = pairs.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return pairs.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def matched_dense(vectors: DataFrame, mapping: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, cosine) of the mapping's pairs that both have a vector; 0 if one of them is zero."""
    v = F.col(vector_col).cast("array<double>")
    x, y = vectors.select(F.col(id_col).alias("a"), v.alias("x")), vectors.select(F.col(id_col).alias("b"), v.alias("y"))

    def dot(p: str, q: str) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)

    cosine = F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x") * dot("y", "y")))
    return mapping.select("a", "b").join(x, "a").join(y, "b").select("a", "b", F.coalesce(cosine, F.lit(0.0)).alias("cosine"))


def matched_jaccard(sets: DataFrame, mapping: DataFrame) -> DataFrame:
    """(a, b, i, u, score) of the mapping's pairs that both have a row of terms (doc_id, term): shared terms, all
    terms, and their ratio, 0 for an empty union."""
    own = sets.select("doc_id", "term").distinct()
    sizes = own.groupBy("doc_id").agg(F.count("term").alias("n"))
    pairs = mapping.select("a", "b").join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a")
    pairs = pairs.join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
    x, y = own.select(F.col("doc_id").alias("a"), "term"), own.select(F.col("doc_id").alias("b"), "term")
    shared = pairs.select("a", "b").join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.count("*").alias("i"))
    i = F.coalesce("i", F.lit(0))
    out = pairs.join(shared, ["a", "b"], "left").select("a", "b", i.alias("i"), (F.col("na") + F.col("nb") - i).alias("u"))
    return out.withColumn("score", F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(0.0))


def triangle(pairs: DataFrame, n_docs: int) -> DataFrame:
    """(score, times): the scores of all n * (n - 1) / 2 pairs, those that `pairs` lacks as one row of score 0."""
    rest = pairs.agg((F.lit(n_docs * (n_docs - 1) // 2) - F.count("*")).alias("times")).filter("times > 0")
    return pairs.select("score", F.lit(1).cast("long").alias("times")).unionByName(rest.select(F.lit(0.0).alias("score"), "times"))


def method_stats(scores: DataFrame) -> DataFrame:
    """(method, mean, median, high, low, winner, verdict) of a (method, score, times) table, one row a method; the
    winner has the highest mean, ties to the smaller name."""
    s, times = F.col("score"), F.col("times")
    mean = F.sum(s * times) / F.sum(times)
    median = F.percentile(s, F.lit(0.5), times)
    stats = scores.groupBy("method").agg(mean.alias("mean"), median.alias("median"), F.max(s).alias("high"), F.min(s).alias("low"))
    first = stats.agg(F.max(F.struct("mean", "method"))["mean"].alias("best"))  # one row
    winner = stats.crossJoin(F.broadcast(first)).filter("mean = best").agg(F.min("method").alias("first"))
    verdict = F.when(F.col("first").contains("embedding"), "embeddings score highest: texts agree in meaning").otherwise(
        "a vocabulary method scores highest: texts repeat words"
    )
    out = stats.crossJoin(F.broadcast(winner))
    return out.select("method", "mean", "median", "high", "low", (F.col("method") == F.col("first")).alias("winner"), verdict.alias("verdict"))


def score_reports(scores: DataFrame, low: float = 0.4, high: float = 0.7, column: str = "score") -> DataFrame:
    """Rows below `low` and above `high`, with their band and their place in it: lowest first, highest first."""
    c = F.col(column)
    bands = scores.withColumn("band", F.when(c < low, "low").when(c > high, "high")).filter("band is not null")
    return bands.withColumn("order", F.when(F.col("band") == "low", c).otherwise(-c)).orderBy("band", "order").drop("order")


def five_numbers(scores: DataFrame, column: str, *by: str) -> DataFrame:
    """Least, quartiles and greatest of each group of a (column, times) table."""
    c = F.col(column)
    quartiles = [F.percentile(c, F.lit(p), F.col("times")).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return scores.groupBy(*by).agg(F.min(c).alias("low"), *quartiles, F.max(c).alias("high"))


def describe(scores: DataFrame, column: str = "score", *by: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of a column, in one row for each group."""
    c = F.col(column)
    quartile = [F.percentile(c, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return scores.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), *quartile, F.max(c).alias("high"))


def histogram(scores: DataFrame, column: str = "score", bins: int = 20) -> DataFrame:
    """(bin, n) of equal bins between the extremes, the last one closed."""
    edge = scores.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return scores.crossJoin(F.broadcast(edge)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def zscore(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, pos, z) by column, population deviation, a zero deviation counting as 1."""
    cells = vectors.select(F.col(id_col).alias("vec_id"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("pos", "x"))
    stats = cells.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return cells.join(F.broadcast(stats), "pos").select("vec_id", "pos", ((F.col("x") - F.col("m")) / scale).alias("z"))


def pca(vectors: DataFrame, k: int = 30, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, float]:
    """(vec_id, scores) of the centred first k components, and the share of variance they explain."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select(F.col(id_col).alias("vec_id"), array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(data)
    projected = model.transform(data).select("vec_id", vector_to_array("p").alias("p"))
    means = projected.agg(F.array(*[F.avg(F.col("p")[i]) for i in range(k)]).alias("m"))
    centred = projected.crossJoin(F.broadcast(means)).select("vec_id", F.zip_with("p", "m", lambda x, m: x - m).alias("scores"))
    return centred, float(sum(model.explainedVariance))
