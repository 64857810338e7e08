"""Fuzzy best match by Ratcliff-Obershelp similarity, blocked on a prefix if one is given."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Table, ship


def best_matches(left: DataFrame, right: DataFrame, least: float = 0.6, prefix: int = 0, chunk_rows: int = 4096) -> DataFrame:
    """(a, b, score) for each left name: the right name of the highest ratio, ties to the larger name; the score is
    the ratio with its arguments in query order. Names without a match of `least` give no row. Only names of equal
    prefix meet, with prefix=0 all do; a common prefix is dealt out over pairs of chunks of left and right names, and
    the best of the chunks' bests counts."""
    ship(left.sparkSession)
    block = F.lower(F.substring("name", 1, prefix))
    a = left.groupBy(F.col("name").alias("a"), block.alias("block")).agg(F.count("*").alias("times"))
    b = right.select(F.col("name").alias("b"), block.alias("block")).distinct()
    size = F.ceil(F.count("*") / chunk_rows)
    chunks = Table(a.groupBy("block").agg(size.alias("chunks")).join(b.groupBy("block").agg(size.alias("parts")), "block")).df
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks"))).select("a", "times", "block", "chunk", every("parts").alias("part"))
    b = b.join(chunks, "block").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("b", "block", every("chunks").alias("chunk"), "part")

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows, names = [], sorted(set(y.b))
        seq = difflib.SequenceMatcher()
        for query, times in zip(x.a, x.times):
            seq.set_seq2(query)
            best = (0.0, "")
            for name in names:
                seq.set_seq1(name)
                floor = max(least, best[0])
                if seq.real_quick_ratio() >= floor and seq.quick_ratio() >= floor:
                    best = max(best, (seq.ratio(), name))
            if best[0] >= least:
                rows.append((query, times, *best, difflib.SequenceMatcher(None, query, best[1]).ratio()))
        return pd.DataFrame(rows, columns=["a", "times", "ratio", "b", "score"])

    keys = ("block", "chunk", "part")
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(match, "a string, times long, ratio double, b string, score double")
    best = found.groupBy("a", "times").agg(F.max(F.struct("ratio", "b", "score")).alias("best"))
    return best.select("a", F.explode(F.array_repeat("best", F.col("times").cast("int"))).alias("best")).select("a", "best.b", "best.score")
