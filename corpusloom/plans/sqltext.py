"""One SQL text for both engines: shared CTEs, and the few spellings in which Spark and DuckDB differ."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.text import DOMAIN_WORDS, STOPWORDS, extract_tokens, word_tokens

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in (*STOPWORDS, *DOMAIN_WORDS))
_STEPS = (
    ("’", "''"), (r"''[\p{L}\p{N}_]+", ""), (r'[;@#$%&?!()\[\]{}<>"“”«»*]|--|\.\.+', " "), (r"[,:]([^0-9])", r" \1"), (r"[.,:](\s|$)", r" \1"),
)


def _clean() -> str:
    out = "lower(coalesce(text, ''))"
    for pattern, to in _STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


#: CTEs for DuckDB; in Spark the same tables are views of the text operators.
BASES = {
    "tok": r"tok0 AS (SELECT doc_id, lang, source, n_chars, list_filter(string_split_regex(" + _clean()
    + rf", '\s+'), lambda w: regexp_full_match(w, '\p{{L}}{{3,}}') AND NOT list_contains([{_STOP}], w)) AS l FROM documents),"
    " tok AS (SELECT doc_id, lang, source, n_chars, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS term FROM tok0)",
    "wrd": r"wrd0 AS (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS l FROM documents),"
    " wrd AS (SELECT doc_id, lang, source, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS word FROM wrd0)",
}


def _view(spark: SparkSession, sf_dir: str, base: str) -> str:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens, name = (extract_tokens(F.col("text")), "term") if base == "tok" else (word_tokens(F.coalesce("text", F.lit(""))), "word")
    view = f"corpusloom_{base}_{zlib.crc32(sf_dir.encode()):08x}"
    docs.select("doc_id", "lang", "source", "n_chars", F.posexplode(tokens).alias("pos", name)).createOrReplaceTempView(view)
    return view


#: Term weights of all documents: counts, document-frequency filter, TF-IDF, top 100.
WEIGHTS = """
n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
kept_terms AS (SELECT term, df FROM dfreq CROSS JOIN n WHERE df >= CAST(0.02 AS DOUBLE) * n AND df <= CAST(0.75 AS DOUBLE) * n),
kept AS (SELECT tf.doc_id, tf.term, tf.tf, k.df, sum(tf.tf) OVER (PARTITION BY tf.doc_id) AS total FROM tf JOIN kept_terms k ON k.term = tf.term),
w AS (SELECT doc_id, term, tf, df, CAST(tf AS DOUBLE) / CAST(total AS DOUBLE) * ln(CAST(n AS DOUBLE) / CAST(df AS DOUBLE)) AS tfidf FROM kept CROSS JOIN n),
ranked AS (SELECT doc_id, term, tfidf, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 12) DESC, term) AS INTEGER) AS rank FROM w WHERE tfidf > 0),
top100 AS (SELECT doc_id, term, tfidf, rank FROM ranked WHERE rank <= 100)"""

#: The token graph: Jaccard over documents of the terms' top-100 lists.
GRAPH = (
    WEIGHTS
    + """,
freq AS (SELECT term, count(*) AS f FROM top100 GROUP BY term),
co AS (SELECT a.term AS a, b.term AS b, count(*) AS i FROM top100 a JOIN top100 b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY a.term, b.term),
jac AS (SELECT co.a, co.b, CAST(i AS DOUBLE) / CAST(fa.f + fb.f - i AS DOUBLE) AS weight FROM co JOIN freq fa ON fa.term = co.a JOIN freq fb ON fb.term = co.b),
edges AS (SELECT a, b, weight FROM jac WHERE weight > 0.2)"""
)

_SPELL = {"@pct(": ("percentile(", "quantile_cont("), "AS STRING)": ("AS STRING)", "AS VARCHAR)"), " SEMI JOIN ": (" LEFT SEMI JOIN ", " SEMI JOIN "), " ANTI JOIN ": (" LEFT ANTI JOIN ", " ANTI JOIN ")}


def text(bases: tuple[str, ...], ctes: str, final: str, views: dict[str, str] | None = None, sf_dir: str = "") -> str:
    """The whole statement in one engine's spelling, Spark's if there are views; @name is a table."""
    spark = views is not None
    parts = [f"{b} AS (SELECT * FROM {views[b]})" if spark else BASES[b] for b in bases] + ([ctes.strip()] if ctes.strip() else [])
    sql = (f"WITH {'RECURSIVE ' if 'reach(' in ctes else ''}{', '.join(parts)} " if parts else "") + final
    for mark, (a, b) in _SPELL.items():
        sql = sql.replace(mark, a if spark else b)
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        sql = sql.replace(f"@{t}", f"parquet.`{sf_dir}/{t}.parquet`" if spark else t)
    return sql


def run(spark: SparkSession, sf_dir: str, bases: tuple[str, ...], ctes: str, final: str) -> DataFrame:
    return spark.sql(text(bases, ctes, final, {b: _view(spark, sf_dir, b) for b in bases}, sf_dir))
