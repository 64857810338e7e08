"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and tokens, each stage on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, linedup, minhash, mixing, toxicity
from corpusloom.session import Table

#: SQL has no near-duplicate candidates, trained scores or BPE automata; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Labels of held-out ids teach it nothing. A row is judged by its own
    text, whatever its id; null, empty and wordless texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.toxicity(docs, model)
    return scored.filter(F.col("__corpusloom_predicted") == 0).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later occurrences of three-line windows go; n_chars follows the text. Every document stays a row.
    Null texts and rows of null id stay as they are; n_chars of a null text stays too."""
    cut = linedup.line_dedup(docs)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id. Shingles of five words, Jaccard 0.8.

    Rows are judged by their own texts: of rows of one id with unlinked texts each is in a group of its own text. A
    repeated row stays once. Rows of null id and texts without words are in no group and stay.
    """
    return minhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or sampled so that sources come near their target weights; n_chars follows the text. A document
    of which the mix takes nothing, as one without words, goes; rows of null id or source take part like others."""
    out = mixing.mixed(docs)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded text of each row, repeated rows
    each by itself. A null text counts as empty: no tokens, no bytes."""
    import public_tokenizers

    coded = bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("bpe tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if n == len(STAGES) - 1 else Table(out).df
    return docs
