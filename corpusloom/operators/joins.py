"""Joins of two lists of names (J1-J8): exact, fuzzy, the remainder, their union and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.clean import normal_name
from corpusloom.operators.match import best_matches


def _last_by_norm(names: DataFrame, name: str, position: str) -> DataFrame:
    """(norm, name): of names that are equal once normalised, the one at the last position."""
    return names.groupBy(normal_name(F.col(name)).alias("norm")).agg(F.max_by(F.col(name), F.col(position)).alias("name"))


def exact_matches(left: DataFrame, right: DataFrame, name: str = "name", position: str = "pos") -> DataFrame:
    """(left_name, right_name, score 1.0, method) of names that are equal once normalised. Of several names of one
    normal form the last position wins, on either side. Empty normal forms match like others."""
    a = _last_by_norm(left, name, position).withColumnRenamed("name", "left_name")
    b = _last_by_norm(right, name, position).withColumnRenamed("name", "right_name")
    return a.join(b, "norm").select("left_name", "right_name", F.lit(1.0).alias("score"), F.lit("Exact").alias("method"))


def unmatched(names: DataFrame, matches: DataFrame, side: str, name: str = "name") -> DataFrame:
    """The distinct names that no match has on this side."""
    return names.select(F.col(name).alias("name")).distinct().join(matches.select(F.col(side).alias("name")), "name", "left_anti")


def with_remainder(names: DataFrame, matches: DataFrame, name: str = "name") -> DataFrame:
    """Every distinct left name with its match, or with none: null, score 0, "No Match"."""
    own = names.select(F.col(name).alias("left_name")).distinct().join(matches, "left_name", "left")
    return own.select(
        "left_name", "right_name", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("method", F.lit("No Match")).alias("method")
    )


def mapping(left: DataFrame, right: DataFrame, name: str = "name", position: str = "pos", least: float = 0.6) -> DataFrame:
    """(left_name, right_name, score, method) for every left name: exact matches, then the best fuzzy match of
    the normal forms of the rest with the right names' normal forms that are left, then the remainder.

    A right name can be matched by several left ones; of right names of one normal form the first position is taken.
    """
    exact = exact_matches(left, right, name, position)
    rest = unmatched(left, exact, "left_name", name).withColumn("norm", normal_name(F.col("name")))
    free = right.join(exact.select(F.col("right_name").alias(name)).distinct(), name, "left_anti")
    first = free.groupBy(normal_name(F.col(name)).alias("norm")).agg(F.min_by(F.col(name), F.col(position)).alias("right_name"))
    best = best_matches(rest.select(F.col("norm").alias("name")).distinct(), first.select(F.col("norm").alias("name")), least)
    fuzzy = (
        rest.join(best.select(F.col("a").alias("norm"), "b", "score"), "norm")
        .join(first.select(F.col("norm").alias("b"), "right_name"), "b")
        .select(F.col("name").alias("left_name"), "right_name", "score", F.lit("Fuzzy").alias("method"))
    )
    return with_remainder(left, exact.unionByName(fuzzy), name)


def match_report(matches: DataFrame) -> DataFrame:
    """Names by method, and by the bands of the score: above 0.8, from 0.6 to 0.7, all."""
    score, method = F.col("score"), F.col("method")
    return matches.agg(
        F.count_if(method == "Exact").alias("exact"),
        F.count_if(method == "Fuzzy").alias("fuzzy"),
        F.count_if(method == "No Match").alias("none"),
        F.count_if(score > 0.8).alias("high"),
        F.count_if(score.between(0.6, 0.7)).alias("low"),
        F.count("*").alias("n"),
    )


def matched_rows(corpus: DataFrame, matches: DataFrame, name: str, side: str = "left_name", above: float = 0.857) -> DataFrame:
    """Rows of the corpus whose name has a match above the score."""
    return corpus.join(matches.filter(F.col("score") > above).select(F.col(side).alias(name)), name, "left_semi")


def levenshtein_matches(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """J3 by edit distance: (a, b, score) for each distinct left name, the right name of the highest
    1 - distance / longer length, ties to the larger one; names without a match of `least` give no row.

    Lengths decide who meets: a score of `least` needs the shorter name to have at least that share of the longer
    one's letters, so each left name meets the lengths in that range, by an equi-join, and no match is lost.
    """
    def named(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.col("name").alias(column)).distinct().withColumn("size", F.length(column))

    least_size, most_size = F.ceil(F.col("size") * least - 1e-9), F.floor(F.col("size") / least + 1e-9)
    a = named(left, "a").withColumn("size", F.explode(F.sequence(least_size.cast("int"), most_size.cast("int"))))
    pairs = a.join(named(right, "b"), "size")
    longer: Column = F.greatest(F.length("a"), F.length("b"))
    score = F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein("a", "b") / longer)
    scored = pairs.select("a", "b", score.alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy("a").agg(F.max(F.struct("score", "b")).alias("best"))
    return best.select("a", "best.b", "best.score")
