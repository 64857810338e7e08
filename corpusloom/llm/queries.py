"""The ten queries over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, hnsw, linedup, minhash, mixing, rabitq, secrets, substring, toxicity, warc

_P = "__corpusloom_"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.with_taken(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", *(F.col(_P + c).alias(c) for c in ("size", "source_size", "target", "taken")), F.col("source"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    coded = bpe.encoded(_table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.substring_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col(_P + "score").alias("score"),
        F.col(_P + "predicted").alias("predicted"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the kept text for each document."""
    cut = linedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", F.col(_P + "n_lines").alias("n_lines"), F.col(_P + "n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_minhash_dedup, op3_secret_scan, op4_bpe_codec, op5_substring_dedup, op6_toxicity,
        op7_embedding_dedup, op8_nearest_neighbours, op9_warc, op10_line_dedup,
    )
}

_COMPONENTS = """
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT {id}, {id} FROM {table} UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.node WHERE r.root < w.b
),
component AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""

ORACLES = {
    # Water level: sources in order of size over weight; those below the level that the rest would then share are full.
    "op1_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) * 8 AS u
  FROM documents
),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w, 2e0 * source_size AS cap FROM src),
levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER before_, 0)) / sum(w) OVER rest AS level FROM ranked
  WINDOW before_ AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
water AS (SELECT min_by(level, cap / w) AS level FROM levels WHERE cap > w * level),
target AS (SELECT ranked.*, coalesce(least(cap, w * level), cap) AS target FROM ranked LEFT JOIN water ON true),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    CAST(round(target) AS BIGINT) - CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END * source_size AS want
  FROM target
),
spot AS (SELECT source, u, sum(size) AS s FROM d WHERE size > 0 GROUP BY source, u),
upto AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY u) AS upto FROM spot)
SELECT d.doc_id, d.size, p.source_size, p.target, d.source, CAST(p.whole * d.size + CASE
    WHEN q.upto IS NULL OR p.want <= q.upto - q.s THEN 0
    WHEN q.upto <= p.want THEN d.size
    ELSE floor(d.size * (p.want - q.upto + q.s) / CAST(q.s AS DOUBLE)) END AS BIGINT) AS taken
FROM d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source
LEFT JOIN upto q ON q.source IS NOT DISTINCT FROM d.source AND q.u = d.u AND d.size > 0
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(p.sha, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f ON f.sha = p.sha
""",
    "op2_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
spot AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM spot),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
),"""
    + _COMPONENTS.format(id="doc_id", table="documents")
    + """
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN component c ON c.node = d.doc_id
""",
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM spot),
first_ AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
later AS (SELECT win.doc_id, i FROM win JOIN first_ ON win.k = first_.k WHERE first_.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM later),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
    coalesce(string_agg(CASE WHEN gone.i IS NULL THEN word.word END, ' ' ORDER BY word.i), '') AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.95
),"""
    + _COMPONENTS.format(id="vec_id", table="embeddings")
    + """,
n AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN component c ON c.node = v.vec_id
""",
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
spot AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3),
win AS (SELECT doc_id, i, array_to_string(ls[i:i + 2], chr(10)) AS k FROM spot),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM ranked WHERE r > 1),
line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l)
SELECT line.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(gone.i) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line.line END, chr(10) ORDER BY line.i), '')) AS kept_sha256
FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.i = line.i GROUP BY line.doc_id
""",
}
