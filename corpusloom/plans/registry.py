"""Named queries of the operator inventory, and DuckDB SQL that states the same results on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import html, stem, tables
from corpusloom.operators import aggregate, blocks, clean, dense, graph, joins, text, vectors
from corpusloom.operators.match import best_matches
from corpusloom.plans import sqltext
from corpusloom.plans.sqltext import GRAPH, WEIGHTS
from corpusloom.session import Table, spread
from corpusloom.sources import features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, final: str | None = None, ctes: str = "", *bases: str) -> Callable[[Query], Query]:
    """Register a DataFrame query, with SQL for the other engine where it can be expressed."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if final is not None:
            ORACLES[name] = sqltext.text(bases, ctes, final)
        return f

    return register


def both(name: str, final: str, ctes: str = "", *bases: str) -> None:
    """A relational query whose SQL text runs on both engines."""
    QUERIES[name] = lambda spark, sf_dir: sqltext.run(spark, sf_dir, bases, ctes, final)
    ORACLES[name] = sqltext.text(bases, ctes, final)


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, source, pos, term) of all documents."""
    docs = spread(_docs(spark, d).select("doc_id", "lang", "source", "text"), "doc_id")
    return docs.select("doc_id", "lang", "source", F.posexplode(text.extract_tokens(F.col("text"))).alias("pos", "term"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return spread(_docs(spark, d).select("doc_id", "text"), "doc_id").select("doc_id", F.explode(text.word_tokens(F.col("text"))).alias("word"))


def _rounded(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Cleaning (C1-C16)
_BLANK = r"[\x09-\x0D\x20]+"
_STRIP = rf"regexp_replace(regexp_replace({{0}}, '^{_BLANK}', ''), '{_BLANK}$', '')"
_DESCRIBED = f"""d AS (SELECT doc_id, {_STRIP.format('source')} AS name, {_STRIP.format('text')} AS description FROM documents),
kept AS (SELECT * FROM d WHERE description IS NOT NULL AND description <> '' AND description <> '.' AND lower(description) <> lower(coalesce(name, '')))"""


def _described(spark, d):
    return clean.renamed(_docs(spark, d).select("doc_id", "source", "text"), {"source": "name", "text": "description"})


@query("clean_mask", "SELECT doc_id, name, description FROM kept", _DESCRIBED)
def _(spark, d):
    return clean.described(_described(spark, d))


@query("clean_removed", "SELECT (SELECT count(*) FROM d) AS n_before, (SELECT count(*) FROM kept) AS n_after, (SELECT count(*) FROM d) - (SELECT count(*) FROM kept) AS n_removed", _DESCRIBED)
def _(spark, d):
    return clean.removed(_described(spark, d), clean.described(_described(spark, d)))


@query("clean_blank", f"SELECT doc_id FROM documents WHERE length({_STRIP.format('text')}) > 0")
def _(spark, d):
    return clean.non_blank(_docs(spark, d), "text").select("doc_id")


@query("drop_values", "SELECT doc_id, source FROM documents WHERE (source IS NULL OR source NOT IN ('src1', 'src2')) AND (lang IS NULL OR lang <> 'de')")
def _(spark, d):
    return clean.without_values(clean.without_values(_docs(spark, d), "source", ["src1", "src2"]), "lang", ["de"]).select("doc_id", "source")


@query("reorder_columns", "SELECT source AS name, lang AS region, n_chars, doc_id FROM documents")
def _(spark, d):
    return clean.renamed(_docs(spark, d), {"source": "name", "lang": "region", "absent": "x"}).select("name", "region", "n_chars", "doc_id")


@query("semi_anti_filter", """SELECT doc_id, 'has' AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'lacks' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'complete' FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL""")
def _(spark, d):
    docs, labels = _docs(spark, d), _read(spark, d, "labels")
    kinds = (("has", clean.having(docs, labels, "doc_id")), ("lacks", clean.lacking(docs, labels, "doc_id")), ("complete", clean.complete(docs, "lang", "text")))
    parts = [df.select("doc_id", F.lit(kind).alias("kind")) for kind, df in kinds]
    return parts[0].union(parts[1]).union(parts[2])


_RANK = """raw AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '=' || o_orderkey WHEN 1 THEN o_orderkey || '–' || (o_orderkey + 49) WHEN 2 THEN o_orderkey || '+'
WHEN 3 THEN 'N/A' WHEN 4 THEN ' ' ELSE chr(9) || o_orderkey || ' ' END AS r FROM orders)"""


@query("rank_clean", f"SELECT o_orderkey, TRY_CAST(trim(split_part(split_part(replace(replace({_STRIP.format('r')}, '=', ''), '–', '-'), '-', 1), '+', 1)) AS DOUBLE) AS rank FROM raw", _RANK)
def _(spark, d):
    key = F.col("o_orderkey")
    printed = (
        F.when(key % 6 == 0, F.concat(F.lit("="), key)).when(key % 6 == 1, F.concat(key, F.lit("–"), key + 49)).when(key % 6 == 2, F.concat(key, F.lit("+")))
        .when(key % 6 == 3, "N/A").when(key % 6 == 4, " ").otherwise(F.concat(F.lit("\t"), key, F.lit(" ")))
    )
    return _read(spark, d, "orders").select("o_orderkey", clean.rank_value(printed).alias("rank"))


_COUNTRY = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in tables.COUNTRY_REGION.items()) + ") v(c, r))"


@query("region_map", "SELECT n_nationkey, coalesce(r, 'Other') AS region FROM nation LEFT JOIN m ON lower(c) = lower(n_name)", _COUNTRY)
def _(spark, d):
    return _read(spark, d, "nation").select("n_nationkey", clean.region_of(F.initcap("n_name")).alias("region"))


@query("region_default", f"SELECT coalesce(nullif({_STRIP.format('lang')}, ''), 'Other') AS region, 'Other' AS absent, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    docs = _docs(spark, d)
    return docs.groupBy(clean.region_or_other(docs, "lang").alias("region"), clean.region_or_other(docs, "nowhere").alias("absent")).agg(F.count("*").alias("n"))


@query("meta_align", "SELECT c_custkey AS key, coalesce(s_name, 'Other') AS region, s_suppkey * 2 AS rank FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def _(spark, d):
    keys = _read(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    metadata = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("region"), (F.col("s_suppkey") * 2).alias("rank"))
    return clean.aligned(keys, metadata, "key", {"region": "Other", "rank": None})


_NORM = "trim(replace(replace(replace(replace(trim(lower(coalesce({0}, ''))), 'the ', ''), '-', ' '), 'university of', ''), 'university', ''))"


@query("name_norm", f"SELECT doc_id, {_NORM.format('name')} AS norm FROM (SELECT doc_id, 'The University of ' || lang || '-' || source AS name FROM documents) x")
def _(spark, d):
    name = F.concat(F.lit("The University of "), "lang", F.lit("-"), "source")
    return _docs(spark, d).select("doc_id", clean.normal_name(name).alias("norm"))


@query("distinct_names", "SELECT DISTINCT p_name AS name FROM part")
def _(spark, d):
    return clean.distinct_names(_read(spark, d, "part"), "p_name")


# Merged words (C8-C10): the dictionary is the corpus's frequent words.
_SPLIT = """dict AS (SELECT word FROM (SELECT word, count(*) AS n FROM wrd GROUP BY 1) x WHERE n >= 50),
todo AS (SELECT DISTINCT word FROM wrd WHERE length(word) >= 5 AND word NOT IN (SELECT word FROM dict)),
cuts AS (SELECT word, unnest(range(2, length(word) - 2)) AS i FROM todo),
ok AS (SELECT c.word, min(c.i) AS i FROM cuts c JOIN dict l ON l.word = substring(c.word, 1, c.i) JOIN dict r ON r.word = substring(c.word, c.i + 1) GROUP BY c.word)"""


def _fixes(spark, d, least: int = 50):
    words = _words(spark, d).select("word")
    return text.split_words(words, words.groupBy("word").count().filter(F.col("count") >= least))


@query("split_words", "SELECT word, concat(substring(word, 1, i), ' ', substring(word, i + 1)) AS fixed FROM ok", _SPLIT, "wrd")
def _(spark, d):
    return _fixes(spark, d).filter("changed").select("word", "fixed")


def _rewritten(spark, d):
    docs = _docs(spark, d)
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[a-zA-Z]+(?:-[a-zA-Z]+)*"), F.lit(0))).alias("word"))
    frequent = _words(spark, d).groupBy("word").count().filter("count >= 50").select("word")
    return text.rewrite_merged(docs, text.split_words(words, frequent))


@query("rewrite_merged")
def _(spark, d):
    return _rewritten(spark, d).select("doc_id", "n_changes", F.md5("text").alias("text_md5"))


@query("sum_changes")
def _(spark, d):
    return clean.total_changes(_rewritten(spark, d))


@query("punct_space", r"SELECT doc_id, md5(regexp_replace(text, '([.,!?;:])([a-zA-Z])', '\1 \2', 'g')) AS text_md5 FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.punctuation_space(F.col("text"))).alias("text_md5"))


# Joins of names (J1-J8). Every third customer's name comes again, last, with an article; the last of equal names wins.
_NAMES = f"""l0 AS (SELECT replace(c_name, 'Customer', 'Supplier') AS name, c_custkey AS pos FROM customer),
l AS (SELECT * FROM l0 UNION ALL SELECT 'The ' || name, pos + 1000000000 FROM l0 WHERE pos % 3 = 0), r AS (SELECT s_name AS name, s_suppkey AS pos FROM supplier),
ln AS (SELECT {_NORM.format('name')} AS norm, arg_max(name, pos) AS name FROM l GROUP BY 1), rn AS (SELECT {_NORM.format('name')} AS norm, arg_max(name, pos) AS name FROM r GROUP BY 1),
exact AS (SELECT ln.name AS left_name, rn.name AS right_name FROM ln JOIN rn ON ln.norm = rn.norm)"""


def _names(spark, d):
    plain = _read(spark, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"), F.col("c_custkey").alias("pos"))
    again = plain.filter("pos % 3 = 0").select(F.concat(F.lit("The "), "name").alias("name"), (F.col("pos") + 1_000_000_000).alias("pos"))
    return plain.union(again), _read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos"))


@query("name_exact", "SELECT left_name, right_name, CAST(1 AS DOUBLE) AS score, 'Exact' AS method FROM exact", _NAMES)
def _(spark, d):
    return joins.exact_matches(*_names(spark, d))


@query("name_unmatched", "SELECT DISTINCT name FROM l WHERE name NOT IN (SELECT left_name FROM exact)", _NAMES)
def _(spark, d):
    left, right = _names(spark, d)
    return joins.unmatched(left, joins.exact_matches(left, right), "left_name")


@query("name_mapping", """SELECT l.name AS left_name, e.right_name, CASE WHEN e.left_name IS NULL THEN 0e0 ELSE 1e0 END AS score,
CASE WHEN e.left_name IS NULL THEN 'No Match' ELSE 'Exact' END AS method FROM (SELECT DISTINCT name FROM l) l LEFT JOIN exact e ON e.left_name = l.name""", _NAMES)
def _(spark, d):
    left, right = _names(spark, d)
    return joins.with_remainder(left, joins.exact_matches(left, right))


@query("name_semi", "SELECT c_custkey, c_name FROM customer WHERE replace(c_name, 'Customer', 'Supplier') IN (SELECT left_name FROM exact)", _NAMES)
def _(spark, d):
    corpus = _read(spark, d, "customer").select("c_custkey", "c_name", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"))
    return joins.matched_rows(corpus, joins.exact_matches(*_names(spark, d)), "name").select("c_custkey", "c_name")


@query("lookup_default", "SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, d):
    return clean.looked_up(_docs(spark, d).select("doc_id"), _read(spark, d, "labels"), "doc_id", "toxic", -1)


def _parts(spark, d):
    part = _read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    return part.filter("pos % 4 = 0"), part.filter("pos % 4 <> 0")


_LEV = """p AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 4 = 0), q AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 4 <> 0),
s AS (SELECT p.name AS a, q.name AS b, 1 - CAST(levenshtein(p.name, q.name) AS DOUBLE) / greatest(length(p.name), length(q.name)) AS score FROM p CROSS JOIN q),
best AS (SELECT a, b, score FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) = 1)"""


@query("fuzzy_lev", "SELECT a, b, round(score, 6) AS score FROM best", _LEV)
def _(spark, d):
    return _rounded(joins.levenshtein_matches(*_parts(spark, d)), "score", places=6)


@query("match_bands", """SELECT 0 AS exact, (SELECT count(*) FROM best) AS fuzzy, (SELECT count(*) FROM p) - (SELECT count(*) FROM best) AS none,
(SELECT count(*) FROM best WHERE score > 0.8) AS high, (SELECT count(*) FROM best WHERE score BETWEEN 0.6 AND 0.7) AS low, (SELECT count(*) FROM p) AS n""", _LEV)
def _(spark, d):
    left, right = _parts(spark, d)
    found = joins.levenshtein_matches(left, right).select(F.col("a").alias("left_name"), F.col("b").alias("right_name"), "score", F.lit("Fuzzy").alias("method"))
    return joins.match_report(joins.with_remainder(left, found))


@query("fuzzy_best")
def _(spark, d):
    return best_matches(*(df.select("name").distinct() for df in _parts(spark, d)))


@query("fuzzy_mapping")
def _(spark, d):
    return joins.mapping(*_parts(spark, d))


# Pages (H1-H8, S4)
@query("url_abs", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://example.org/p' || page_id ELSE url END AS url FROM pages")
def _(spark, d):
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/p"), "page_id")).otherwise(F.col("url"))
    return _read(spark, d, "pages").select("page_id", html.absolute(path, "https://example.org").alias("url"))


@query("url_repair", "SELECT page_id, replace(replace(url, ' ', ''), 'mp_/', '/') AS url FROM pages")
def _(spark, d):
    return _read(spark, d, "pages").select("page_id", html.repaired(F.col("url")).alias("url"))


@query("record_filter", "SELECT page_id, url FROM pages WHERE page_id % 7 <> 0 AND page_id % 10 <> 3")
def _(spark, d):
    key = F.col("page_id")
    records = _read(spark, d, "pages").select("page_id", "url", F.when(key % 7 != 0, "n").alias("name"), F.when(key % 10 == 3, "Reporter").when(key % 10 == 4, "1").alias("rank"))
    return html.usable_records(records).select("page_id", "url")


QUERIES["link_extract"] = lambda spark, d: spark.sql(rf"SELECT page_id, pos, link FROM parquet.`{d}/pages.parquet` LATERAL VIEW posexplode(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS pos, link")
ORACLES["link_extract"] = r"""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages) SELECT page_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS link FROM l"""


def _pages_with(spark, d, *parts) -> DataFrame:
    """The test pages, which hold no such records of their own, behind a piece of markup made of their columns."""
    return _read(spark, d, "pages").select("page_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("<p>"), "html").alias("html"))


@query("cell_links", "SELECT page_id, 0 AS pos, 'https://example.org/a//u' || page_id AS link FROM pages UNION ALL SELECT page_id, 1, replace(replace(url || '/u', ' ', ''), 'mp_/', '/') FROM pages")
def _(spark, d):
    key = F.col("page_id").cast("string")
    first = ("<table class='ranking main'><tr><td class='big uni'><a href='/a/ mp_/u", key, "'>u</a><a href='/second'>v</a></td><td><a href='/no'>n</a></td></tr>")
    marked = _pages_with(spark, d, *first, "<tr><td class=uni><b>none</b></td><td class=uni><a href='", F.col("url"), "/u'>w</a></td></tr></table>")
    return html.page_links(marked, "uni", base="https://example.org")


@query("ranked_pages", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'N/A' ELSE CAST(page_id AS VARCHAR) END AS rank, 'Name ' || page_id AS name,
'One ' || page_id || chr(10) || chr(10) || 'two' AS description, 'Europe' AS region FROM pages WHERE page_id % 5 <> 0""")
def _(spark, d):
    key = F.col("page_id").cast("string")
    rank = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<span class='rank'> "), key, F.lit("</span>"))).otherwise("")
    info = F.when(F.col("page_id") % 5 != 0, "infomation").otherwise("other")
    parts = ("<section class='main-content wide'><header class=header><h1> Name ", key, "</h1></header><div class=details>", rank, "</div><section class='", info, "'><p>One ", key, "<p> </p><p>two</section><p class=region>in <span>Europe</span></p></section>")
    return html.ranked_pages(_pages_with(spark, d, *parts))


@query("pane_pages", """SELECT page_id, 'Rank not found' AS rank, 'N' || page_id AS name, CASE page_id % 3 WHEN 0 THEN 'third' WHEN 1 THEN 'fourth' ELSE 'Description not found' END AS description,
'France' AS country FROM pages""")
def _(spark, d):
    key = F.col("page_id")
    pane = "<div class='pane-content'>"
    third, fourth = F.when(key % 3 == 0, "third").otherwise(" "), F.when(key % 3 == 2, "").otherwise("fourth")
    parts = ("<h1 class='institution-info__title'>N", key.cast("string"), f"</h1>{pane}none</div>{pane}<div class='institution-info__country clearfix'><a href='/f'>France</a></div></div>{pane}<p>", third, f"</p></div>{pane}<p>", fourth, "</p></div>")
    return html.pane_pages(_pages_with(spark, d, *parts))


@query("section_text", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'One' || chr(10) || chr(10) || 'two' ELSE 'all of it' END AS description FROM pages")
def _(spark, d):
    inner = F.when(F.col("page_id") % 2 == 0, "<p>One</p><p> <p>two").otherwise("all <b>of</b> <span class='read-more'>more</span>it")
    marked = _pages_with(spark, d, "<div class='block about_section d-md-block'><i>x</i><div class='textsection abt'>", inner, "</div>y</div>")
    return html.page_fields(marked, "about_section", "textsection").select("page_id", "description")


@query("page_text")
def _(spark, d):
    return html.page_fields(_read(spark, d, "pages"))


@query("next_data", "SELECT page_id, url AS name, page_id % 100 AS rank FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 'none' AS name, CAST(NULL AS BIGINT) AS rank FROM pages WHERE page_id % 3 <> 0")
def _(spark, d):
    # The tables' pages hold no state of their own: two of three get one, with two rows.
    row = F.struct(F.col("url").alias("name"), (F.col("page_id") % 100).alias("rank"))
    state = F.to_json(F.struct(F.struct(F.array(row, F.struct(F.lit("none").alias("name"), F.lit(None).cast("long").alias("rank"))).alias("data")).alias("props")))
    script = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<script id=__NEXT_DATA__>"), state, F.lit("</script>")))
    pages = _read(spark, d, "pages").select("page_id", F.concat_ws("", script, "html").alias("html"))
    return html.embedded_rows(pages, ("props", "data"), "name string, rank long")


# Sources (S3, S6-S13) and sinks (O1-O3): round trips through files in the shared folder.
@query("source_union", "SELECT source, count(*) AS n FROM (SELECT 'documents' AS source FROM documents UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT 'conversations' FROM conversations) x GROUP BY source")
def _(spark, d):
    paths = {name: f"{d}/{file}.parquet" for name, file in (("documents", "documents"), ("benchmark", "benchmark"), ("absent", "no_such_table"), ("conversations", "conversations"))}
    return features.union_sources(spark, paths).groupBy("source").agg(F.count("*").alias("n"))


@query("scan_limit", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 200")
def _(spark, d):
    return _docs(spark, d).select("doc_id", "source").orderBy("doc_id").limit(200)


@query("labels_parse", "SELECT doc_id, CASE WHEN quality >= toxic THEN 'quality' ELSE 'toxic' END AS dominant, greatest(quality, toxic) AS intensity FROM labels")
def _(spark, d):
    printed = F.concat(F.lit("{'quality': "), "quality", F.lit(", 'toxic': "), "toxic", F.lit("}"))
    return features.label_rows(_read(spark, d, "labels").select("doc_id", printed.alias("Full_Scores"))).select("doc_id", "dominant", "intensity")


def _round_trip(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    from corpusloom.session import scratch

    path = scratch(spark)
    write(path)
    return read(path)


@query("csv_round_trip", "SELECT doc_id, text, lang FROM documents")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", "text", "lang")
    return _round_trip(spark, lambda p: features.write_csv(docs, p), lambda p: features.read_csv(spark, p, "doc_id long, text string, lang string"))


@query("parquet_round_trip", "SELECT doc_id, text, lang FROM documents")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", "text", "lang")
    return _round_trip(spark, lambda p: features.write_parquet(docs, p, "lang"), spark.read.parquet).select("doc_id", "text", "lang")


_NODES = "SELECT page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'https://example.org/p' || page_id ELSE url END AS url, CAST(page_id AS VARCHAR) AS rank FROM pages"


@query("score_nodes", _NODES.replace("page_id AS title", "'T' || page_id AS title"))
def _(spark, d):
    key = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/p"), key)).otherwise(F.col("url"))
    node = F.struct(F.concat(F.lit("T"), key).alias("title"), path.alias("path"), key.alias("rank_display"))
    pages = _read(spark, d, "pages").groupBy((F.col("page_id") % 10).alias("g")).agg(F.collect_list(node).alias("score_nodes")).select("score_nodes")
    return _round_trip(spark, lambda p: features.write_json(pages, p), lambda p: features.read_score_nodes(spark, [p], "https://example.org", lines=True)).select("title", "url", "rank")


@query("source_fallback", "SELECT 'text' AS name, count(text) AS n FROM documents")
def _(spark, d):
    path = features.first_existing(spark, [f"{d}/no_such_table.parquet", f"{d}/documents.parquet"])
    docs = spark.read.parquet(path)
    column = features.text_column(docs)
    return docs.agg(F.lit(column).alias("name"), F.count(column).alias("n"))


# A feature file is one JSON object over all its documents: that of the first 200 is written and read back.
@query("features_read", """SELECT CAST(t.doc_id AS VARCHAR) AS name, rank - 1 AS pos, term, lang AS region, CAST(n_chars AS DOUBLE) AS rank FROM top100 t
JOIN documents d ON d.doc_id = t.doc_id WHERE rank <= 5 AND t.doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 200)""", WEIGHTS, "tok")
def _(spark, d):
    first = _docs(spark, d).orderBy("doc_id").limit(200).select("doc_id", "lang", "n_chars")
    top = vectors.top_k(_weights(spark, d), 5).select("doc_id", "term", "rank").join(first, "doc_id")
    lists = top.groupBy("doc_id", "lang", "n_chars").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    key = F.col("doc_id").cast("string")
    maps = [F.map_from_entries(F.collect_list(F.struct(key, v))).alias(n) for n, v in (("tokens", F.col("terms")), ("regions", F.col("lang")), ("ranks", F.col("n_chars").cast("double")))]
    whole = lists.agg(F.struct(F.count("*").alias("n_docs")).alias("info"), *maps)

    def read(path: str) -> DataFrame:
        tokens, docs = features.read_features(spark, path)
        return tokens.join(docs, "name").select("name", "pos", "term", "region", "rank")

    return _round_trip(spark, lambda p: features.write_json(whole, p), read)


# Tokens and text
@query("tokens", "SELECT doc_id, pos, term FROM tok", "", "tok")
def _(spark, d):
    return _tokens(spark, d).select("doc_id", "pos", "term")


_FORMS = " UNION ALL ".join(
    f"SELECT term, concat(substring(term, 1, length(term) - {len(a)}), '{b}') AS lemma FROM v WHERE right(term, {len(a)}) = '{a}'" for a, b in stem.NOUN_RULES
)
_LEMMA = f"v AS (SELECT DISTINCT term FROM tok), forms AS ({_FORMS} UNION ALL SELECT term, term FROM v), lem AS (SELECT f.term, f.lemma FROM forms f JOIN v k ON k.term = f.lemma QUALIFY row_number() OVER (PARTITION BY f.term ORDER BY length(f.lemma), f.lemma) = 1)"


@query("lemma_vocab", "SELECT term, lemma FROM lem", _LEMMA, "tok")
def _(spark, d):
    words = _tokens(spark, d).select("term").distinct()
    return stem.lemmas(words, words)


@query("token_modes", "SELECT doc_id, pos, t.term, lemma FROM tok t JOIN lem ON lem.term = t.term WHERE pos < 20", _LEMMA, "tok")
def _(spark, d):
    return text.token_modes(_docs(spark, d)).drop("stem")


@query("stem_vocab")
def _(spark, d):
    return stem.stems(_tokens(spark, d))


@query("regex_words", "SELECT word, count(*) AS n FROM wrd GROUP BY word", "", "wrd")
def _(spark, d):
    return _words(spark, d).groupBy("word").agg(F.count("*").alias("n"))


@query("word_freq", "SELECT term, count(*) AS n FROM tok GROUP BY term", "", "tok")
def _(spark, d):
    return _tokens(spark, d).groupBy("term").agg(F.count("*").alias("n"))


@query("top_words", "SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 50", "", "tok")
def _(spark, d):
    return aggregate.top_terms(_tokens(spark, d), 50)


@query("title_case", "SELECT doc_id, upper(lang) AS title, lower(concat(source, ' ', lang)) AS label FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.upper("lang").alias("title"), F.lower(F.concat("source", F.lit(" "), "lang")).alias("label"))


# Targets of the window filter: the corpus's ten most frequent terms, where a document has them; every seventh has none.
_WINDOW = r"""top10 AS (SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 10),
keys AS (SELECT doc_id, list(DISTINCT t.term) AS k FROM tok t JOIN top10 ON top10.term = t.term WHERE doc_id % 7 <> 0 GROUP BY doc_id),
l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+(?:[-''’.][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\x09-\x0D\x20]') AS w FROM documents),
h AS (SELECT l.doc_id, w, k, CASE WHEN k IS NULL THEN [] ELSE list_filter(range(0, len(w)), lambda i: list_contains(k, lower(w[i + 1]))) END AS hits FROM l LEFT JOIN keys ON keys.doc_id = l.doc_id),
near AS (SELECT doc_id, w, k, list_sort(list_distinct(flatten(list_transform(hits, lambda i: range(greatest(i - 5, 0), least(i + 6, len(w))))))) AS p FROM h),
filtered AS (SELECT doc_id, CASE WHEN k IS NULL THEN 'MISSING_KEY' ELSE coalesce(array_to_string(list_transform(p, lambda x, j: CASE WHEN j > 1 AND p[j - 1] < x - 1 THEN '... ' ELSE '' END || w[x + 1]), ' '), '') END AS filtered FROM near)"""


def _window_filtered(spark, d, stemmed=False):
    tokens = _tokens(spark, d)
    top = aggregate.top_terms(tokens, 10).select("term")
    targets = tokens.filter("doc_id % 7 <> 0").join(F.broadcast(top), "term", "left_semi").select("doc_id", F.col("term").alias("stem")).distinct()
    return text.window_filter(_docs(spark, d), targets, stemmed=stemmed)


@query("window_filter", "SELECT doc_id, filtered FROM filtered", _WINDOW, "tok")
def _(spark, d):
    return _window_filtered(spark, d)


@query("outcome_counts", """SELECT count(CASE WHEN filtered = 'MISSING_KEY' THEN 1 END) AS missing, count(CASE WHEN filtered = '' THEN 1 END) AS empty,
count(CASE WHEN filtered NOT IN ('', 'MISSING_KEY') THEN 1 END) AS ok, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (SELECT doc_id FROM filtered WHERE filtered = 'MISSING_KEY' ORDER BY doc_id LIMIT 3) x) AS examples FROM filtered""", _WINDOW, "tok")
def _(spark, d):
    return text.outcome_counts(_window_filtered(spark, d)).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


_KWIC_STOP = ", ".join(f"'{w}'" for w in text.KWIC_STOPWORDS)


@query("kwic_prev", f"SELECT prev AS word, count(*) AS n FROM lagged WHERE word = 'thnt' AND prev IS NOT NULL AND prev NOT IN ({_KWIC_STOP}) GROUP BY prev ORDER BY n DESC, word LIMIT 15",
       "lagged AS (SELECT word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM wrd)", "wrd")
def _(spark, d):
    return text.previous_words(_docs(spark, d), "thnt")


_SNIP = "array_to_string(list_transform(l[greatest(h.pos - 6, 0) + 1:h.pos + 7], lambda w: CASE WHEN w = 'thnt' THEN upper(w) ELSE w END), ' ') AS snippet FROM wrd h JOIN wrd0 ON wrd0.doc_id = h.doc_id WHERE h.word = 'thnt'"


@query("kwic_snip", f"SELECT h.doc_id, h.pos, {_SNIP}", "", "wrd")
def _(spark, d):
    return text.snippets(_docs(spark, d), "thnt")


@query("kwic_sample", f"SELECT snippet FROM (SELECT DISTINCT {_SNIP}) x ORDER BY md5(snippet) LIMIT 5", "", "wrd")
def _(spark, d):
    return text.snippets(_docs(spark, d), "thnt").select("snippet").distinct().orderBy(F.md5("snippet")).limit(5)


both("kwic_context", "SELECT doc_id, hit_pos, pos, word FROM near", "hit AS (SELECT doc_id, pos FROM wrd WHERE word = 'thnt'), near AS (SELECT h.doc_id, h.pos AS hit_pos, w.pos, CASE WHEN w.word = 'thnt' THEN upper(w.word) ELSE w.word END AS word FROM hit h JOIN wrd w ON w.doc_id = h.doc_id AND w.pos BETWEEN h.pos - 6 AND h.pos + 6)", "wrd")


@query("ngram_after", "SELECT ngram, count(*) AS n FROM (SELECT array_to_string(l[w.pos + 3:w.pos + 8], ' ') AS ngram FROM wrd w JOIN wrd0 ON wrd0.doc_id = w.doc_id WHERE w.word = 'of' AND l[w.pos + 2] = 'the' AND w.pos <= len(l) - 2 - 6 - 1) x GROUP BY ngram ORDER BY n DESC, ngram LIMIT 20", "", "wrd")
def _(spark, d):
    return text.ngrams_after(_docs(spark, d), ["of", "the"])


# Matrices (M1-M20)
def _tf(spark, d) -> tuple[DataFrame, int]:
    return vectors.term_counts(_tokens(spark, d)), _docs(spark, d).count()


def _counted(spark, d) -> DataFrame:
    """(doc_id, terms, tf): the distinct terms of each document, written once for all that count them."""
    docs = spread(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return Table(vectors.counted(docs.select("doc_id", text.extract_tokens(F.col("text")).alias("w")))).df


def _weights(spark, d) -> DataFrame:
    tf, n = vectors.counts_of(_counted(spark, d)), _docs(spark, d).count()
    kept = Table(vectors.kept_terms(tf, n)).df  # as a table its size is known, and that of a few terms is broadcast
    return vectors.tfidf(tf.join(kept, "term"), n)


def _top100(spark, d) -> DataFrame:
    return vectors.top_k(_weights(spark, d), 100)


@query("tdm", "SELECT doc_id, term, tf FROM tf", WEIGHTS, "tok")
def _(spark, d):
    return _tf(spark, d)[0]


@query("tdm_shape", "SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS nnz FROM tf", WEIGHTS, "tok")
def _(spark, d):
    return _tf(spark, d)[0].agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("n_terms"), F.count("*").alias("nnz"))


@query("df_filter", "SELECT term, df FROM kept_terms", WEIGHTS, "tok")
def _(spark, d):
    return vectors.kept_terms(*_tf(spark, d))


@query("sparsity", "SELECT round(100 * (1 - CAST(count(*) AS DOUBLE) / (CAST(max(n) AS DOUBLE) * CAST(count(DISTINCT term) AS DOUBLE))), 6) AS sparsity FROM kept CROSS JOIN n", WEIGHTS, "tok")
def _(spark, d):
    tf, n = _tf(spark, d)
    return _rounded(vectors.sparsity(vectors.df_filter(tf, n), n), "sparsity", places=6)


@query("threshold_sweep", """SELECT CAST(t AS DOUBLE) AS threshold, round(100 * (1 - CAST(sum(df) AS DOUBLE) / (CAST(max(n) AS DOUBLE) * CAST(count(*) AS DOUBLE))), 6) AS sparsity, count(*) AS words
FROM dfreq CROSS JOIN n JOIN (SELECT unnest(range(0, 6)) AS t) th ON 100 * df >= t * n AND df <= CAST(0.75 AS DOUBLE) * n GROUP BY t""", WEIGHTS, "tok")
def _(spark, d):
    return _rounded(vectors.threshold_sweep(*_tf(spark, d)), "sparsity", places=6)


@query("df_elbow", "SELECT row_number() OVER (ORDER BY df DESC, term) AS place, term, round(100 * CAST(df AS DOUBLE) / n, 6) AS pct FROM dfreq CROSS JOIN n", WEIGHTS, "tok")
def _(spark, d):
    return _rounded(vectors.df_elbow(*_tf(spark, d)), "pct", places=6)


@query("vocabulary_change", "SELECT count(*) AS n_before, count(CASE WHEN df >= CAST(0.02 AS DOUBLE) * n AND df <= CAST(0.85 AS DOUBLE) * n THEN 1 END) AS n_after FROM dfreq CROSS JOIN n", WEIGHTS, "tok")
def _(spark, d):
    return vectors.vocabulary_change(*_tf(spark, d))


@query("tfidf", "SELECT doc_id, term, round(tfidf, 9) AS tfidf FROM w", WEIGHTS, "tok")
def _(spark, d):
    return _rounded(_weights(spark, d).select("doc_id", "term", "tfidf"), "tfidf", places=9)


@query("topk_terms", "SELECT doc_id, term, rank FROM top100", WEIGHTS, "tok")
def _(spark, d):
    return _top100(spark, d).select("doc_id", "term", "rank")


@query("binarize", "SELECT doc_id, term FROM w WHERE tfidf > 0.01", WEIGHTS, "tok")
def _(spark, d):
    return vectors.binarised(_weights(spark, d), 0.01)


@query("vocab_align", "SELECT coalesce(a.term, b.term) AS term, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM (SELECT term, count(*) AS n FROM tok WHERE source < 'src15' GROUP BY term) a FULL OUTER JOIN (SELECT term, count(*) AS n FROM tok WHERE source >= 'src15' GROUP BY term) b ON a.term = b.term", "", "tok")
def _(spark, d):
    pools = aggregate.pooled(_tokens(spark, d), F.when(F.col("source") < "src15", "left").when(F.col("source") >= "src15", "right"), "side")
    pools = Table(pools).df
    return vectors.aligned_counts(*(pools.filter(F.col("side") == side) for side in ("left", "right")))


_COS = WEIGHTS + """, nrm AS (SELECT doc_id, sqrt(sum(tfidf * tfidf)) AS nrm FROM w GROUP BY doc_id),
u AS (SELECT w.doc_id, term, tfidf / nrm AS u FROM w JOIN nrm ON nrm.doc_id = w.doc_id WHERE nrm > 0),
cos AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.u * y.u) AS score FROM u x JOIN u y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)"""  # fmt: skip
_EMB = """emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ecos AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) AS score FROM emb x JOIN emb y ON x.vec_id < y.vec_id)"""
#: All pairs by method, those of documents without a common term included.
_METHODS = f"""{_COS}, {_EMB}, ids AS (SELECT doc_id FROM documents),
sims AS (SELECT 'terms' AS method, coalesce(score, 0) AS score FROM ids x JOIN ids y ON x.doc_id < y.doc_id LEFT JOIN cos ON a = x.doc_id AND b = y.doc_id UNION ALL SELECT 'embedding', score FROM ecos)"""


@query("cos_tfidf_pairs", "SELECT a, b, round(score, 8) AS score FROM cos", _COS, "tok")
def _(spark, d):
    return vectors.cosine_pairs(_weights(spark, d), places=8)


def _all_sims(spark, d) -> DataFrame:
    """(method, score, times): similarities of all pairs, condensed to rows of the same mean, extremes and quartiles."""
    terms = blocks.condensed(vectors.cosine_rows(_weights(spark, d)), "terms", blocks.sparse_cosine(), zeros_of=_docs(spark, d).count())
    dense_ = blocks.condensed(dense.unit_rows(_vectors(spark, d)), "v", blocks.dense_cosine())
    return Table(terms.withColumn("method", F.lit("terms")).unionByName(dense_.withColumn("method", F.lit("embedding")))).df


@query("sim_stats", """SELECT s.*, mean = max(mean) OVER () AS winner FROM (SELECT method, round(avg(score), 8) AS mean, round(@pct(score, 0.5), 8) AS median, round(max(score), 8) AS high, round(min(score), 8) AS low FROM sims GROUP BY method) s""", _METHODS, "tok")
def _(spark, d):
    return _rounded(vectors.method_stats(_all_sims(spark, d)), "mean", "median", "high", "low").drop("verdict")


@query("sim_box", "SELECT method, round(min(score), 8) AS low, round(@pct(score, 0.25), 8) AS q1, round(@pct(score, 0.5), 8) AS q2, round(@pct(score, 0.75), 8) AS q3, round(max(score), 8) AS high FROM sims GROUP BY method", _METHODS, "tok")
def _(spark, d):
    return _rounded(vectors.five_numbers(_all_sims(spark, d), "score", "method"), "low", "q1", "q2", "q3", "high")


# Matched pairs: each even document with the next one.
_PAIRS = "m AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 2 = 0)"
_MATCHED = f"""{_COS}, {_EMB}, {_PAIRS}, mt AS (SELECT m.a, m.b, coalesce(cos.score, 0) AS score FROM m LEFT JOIN cos ON cos.a = m.a AND cos.b = m.b
 WHERE m.a IN (SELECT doc_id FROM w) AND m.b IN (SELECT doc_id FROM w)), md AS (SELECT m.a, m.b, score FROM m JOIN ecos ON ecos.a = m.a AND ecos.b = m.b),
s AS (SELECT DISTINCT doc_id, term FROM w WHERE tfidf > 0.01), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT m.a, m.b, count(*) AS i FROM m JOIN s x ON x.doc_id = m.a JOIN s y ON y.doc_id = m.b AND y.term = x.term GROUP BY m.a, m.b),
mj AS (SELECT m.a, m.b, coalesce(i, 0) AS i, ca.n + cb.n - coalesce(i, 0) AS u, CASE WHEN ca.n + cb.n - coalesce(i, 0) > 0 THEN CAST(coalesce(i, 0) AS DOUBLE) / (ca.n + cb.n - coalesce(i, 0)) ELSE 0 END AS score
 FROM m JOIN c ca ON ca.doc_id = m.a JOIN c cb ON cb.doc_id = m.b LEFT JOIN inter ON inter.a = m.a AND inter.b = m.b),
matched AS (SELECT 'terms' AS method, a, b, score FROM mt UNION ALL SELECT 'embedding', a, b, score FROM md UNION ALL SELECT 'jaccard', a, b, score FROM mj)"""


def _pairs(spark, d) -> DataFrame:
    ids = _docs(spark, d).select("doc_id")
    return ids.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(ids.withColumnRenamed("doc_id", "b"), "b", "left_semi")


def _matched(spark, d) -> DataFrame:
    weights, pairs = Table(_weights(spark, d)).df, _pairs(spark, d)
    parts = {
        "terms": vectors.matched_cosine(weights, pairs).select("a", "b", F.col("cosine").alias("score")),
        "embedding": vectors.matched_dense(_read(spark, d, "embeddings"), pairs).select("a", "b", F.col("cosine").alias("score")),
        "jaccard": vectors.matched_jaccard(vectors.binarised(weights, 0.01), pairs).select("a", "b", "score"),
    }
    terms, embedding, jaccard = (df.select(F.lit(method).alias("method"), "*") for method, df in parts.items())
    return Table(terms.union(embedding).union(jaccard)).df


@query("matched_sim", "SELECT method, a, b, round(score, 8) AS score FROM matched WHERE method <> 'jaccard'", _MATCHED, "tok")
def _(spark, d):
    return _rounded(_matched(spark, d).filter("method <> 'jaccard'"), "score")


@query("matched_jaccard", "SELECT a, b, i, u, round(score, 8) AS score FROM mj", _MATCHED, "tok")
def _(spark, d):
    return _rounded(vectors.matched_jaccard(vectors.binarised(_weights(spark, d), 0.01), _pairs(spark, d)), "score")


@query("sim_describe", """SELECT method, count(score) AS n, round(avg(score), 8) AS mean, round(stddev_samp(score), 8) AS std, round(min(score), 8) AS low, round(@pct(score, 0.25), 8) AS p25, round(@pct(score, 0.5), 8) AS p50,
round(@pct(score, 0.75), 8) AS p75, round(max(score), 8) AS high FROM matched GROUP BY method""", _MATCHED, "tok")
def _(spark, d):
    return _rounded(vectors.describe(_matched(spark, d), "score", "method"), "mean", "std", "low", "p25", "p50", "p75", "high")


@query("sim_bands", "SELECT a, b, round(score, 8) AS score, CASE WHEN score < 0.4 THEN 'low' ELSE 'high' END AS band FROM mt WHERE score < 0.4 OR score > 0.7", _MATCHED, "tok")
def _(spark, d):
    matched = _matched(spark, d).filter("method = 'terms'").select("a", "b", "score")
    return _rounded(vectors.score_reports(matched), "score")


@query("sim_hist", "SELECT CAST(least(floor((score - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM mt CROSS JOIN (SELECT min(score) AS lo, max(score) AS hi FROM mt) e GROUP BY 1", _MATCHED, "tok")
def _(spark, d):
    return vectors.histogram(_matched(spark, d).filter("method = 'terms'"))


_JAC = "s AS (SELECT DISTINCT doc_id, term FROM tok), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)"


@query("jaccard_pairs", "SELECT a, b, i, ca.n + cb.n - i AS u, round(CAST(i AS DOUBLE) / CAST(ca.n + cb.n - i AS DOUBLE), 8) AS score FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b", _JAC, "tok")
def _(spark, d):
    sets = vectors.counts_of(_counted(spark, d)).select("doc_id", "term")
    return vectors.jaccard_pairs(sets, places=8)


def _vectors(spark, d):
    return _read(spark, d, "embeddings")


@query("cos_dense_pairs", "SELECT a, b, round(score, 6) AS score FROM ecos", _EMB)
def _(spark, d):
    return dense.cosine_blocks(_vectors(spark, d), least=-2.0)


_CELL = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), cell AS (SELECT vec_id, label, CAST(unnest(range(0, len(e))) AS INTEGER) AS pos, unnest(e) AS x FROM v)"


@query("l2norm", "SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 8) AS x FROM cell", _CELL)
def _(spark, d):
    return _rounded(dense.cells(dense.l2norm(_vectors(spark, d))).select("vec_id", "pos", "x"), "x")


@query("zscore", "SELECT vec_id, pos, round((x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos), 6) AS z FROM cell", _CELL)
def _(spark, d):
    return _rounded(vectors.zscore(_vectors(spark, d)).select("vec_id", "pos", "z"), "z", places=6)


@query("pca_var")
def _(spark, d):
    scores, ratio = vectors.pca(_vectors(spark, d), 30)
    return scores.agg(F.count("*").alias("n"), F.round(F.lit(ratio), 8).alias("explained"))


# Clustering (K1-K7)
_SIL = _CELL + """, un AS (SELECT vec_id, label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS u FROM cell),
cs AS (SELECT label, pos, sum(u) AS s FROM un GROUP BY label, pos), cn AS (SELECT label, count(*) AS n FROM v GROUP BY label),
dots AS (SELECT un.vec_id, un.label, cs.label AS other, sum(un.u * cs.s) AS dot FROM un JOIN cs ON cs.pos = un.pos GROUP BY un.vec_id, un.label, cs.label),
dist AS (SELECT vec_id, d.label, other, n, CASE WHEN d.label = other THEN CASE WHEN n > 1 THEN (n - 1 - (dot - 1)) / (n - 1) END ELSE 1 - dot / n END AS m FROM dots d JOIN cn ON cn.label = other),
ab AS (SELECT vec_id, label, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b FROM dist GROUP BY vec_id, label),
sil AS (SELECT vec_id, label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""  # fmt: skip


@query("silhouette", "SELECT vec_id, round(s, 6) AS s FROM sil", _SIL)
def _(spark, d):
    return _rounded(dense.silhouette(_vectors(spark, d), "label").select("vec_id", "s"), "s", places=6)


@query("silhouette_by_cluster", "SELECT label, count(*) AS n, round(avg(s), 6) AS mean FROM sil GROUP BY label", _SIL)
def _(spark, d):
    return dense.silhouette(_vectors(spark, d), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"))


def _linked(spark, d) -> tuple[DataFrame, DataFrame]:
    """The rows that Ward linkage can hold, all if they are few enough, and their merges."""
    rows = dense.sampled(_vectors(spark, d), dense.WARD_ROWS)
    return rows, Table(dense.ward(rows)).df


@query("ward_cut")
def _(spark, d):
    rows, merges = _linked(spark, d)
    return dense.cut(rows, merges, 7)


@query("ward_dendrogram")
def _(spark, d):
    return _linked(spark, d)[1]


@query("cluster_sweep")
def _(spark, d):
    rows, merges = _linked(spark, d)
    return _rounded(dense.sweep(rows, merges, range(2, 11)), "silhouette", places=6)


@query("seeded_sample", "SELECT vec_id FROM embeddings ORDER BY md5(concat('42:', CAST(vec_id AS VARCHAR))), vec_id LIMIT 150")
def _(spark, d):
    return dense.sampled(_vectors(spark, d), 150).select("vec_id")


# Frequencies, trends, thesaurus, term groups
@query("era_pool", "SELECT CASE WHEN source < 'src15' THEN 'pre' ELSE 'post' END AS era, term, count(*) AS n FROM tok GROUP BY 1, 2", "", "tok")
def _(spark, d):
    return aggregate.pooled(_tokens(spark, d), F.when(F.col("source") < "src15", "pre").otherwise("post"), "era")


@query("region_pool", "SELECT lang AS region, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY lang", "", "tok")
def _(spark, d):
    return aggregate.pool_sizes(_tokens(spark, d), "lang").withColumnRenamed("lang", "region")


@query("median_rank", "SELECT lang AS region, @pct(CAST(n_chars AS DOUBLE), 0.5) AS median, count(n_chars) AS n FROM documents GROUP BY lang")
def _(spark, d):
    return aggregate.median_by(_docs(spark, d), "n_chars", "lang").withColumnRenamed("lang", "region")


@query("region_floor", "SELECT source, n, CAST(floor((r - 1) / 4e0) AS INTEGER) AS batch FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM tok GROUP BY source HAVING count(*) > 1000) x WHERE r <= 8", "", "tok")
def _(spark, d):
    return aggregate.largest_groups(_tokens(spark, d), "source")


@query("region_top", "SELECT lang, term, n, r AS rank FROM (SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r FROM tok GROUP BY lang, term) x WHERE r <= 10", "", "tok")
def _(spark, d):
    return text.top_words(_tokens(spark, d), 10, "lang")


@query("wordcloud", "SELECT term, n, round(CAST(n AS DOUBLE) / max(n) OVER (), 8) AS size FROM (SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 60) x", "", "tok")
def _(spark, d):
    return aggregate.top_terms(_tokens(spark, d), 60).withColumn("size", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 8))


_COOC = "top20 AS (SELECT term FROM (SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 20) x), own AS (SELECT DISTINCT t.doc_id, t.term FROM tok t JOIN top20 k ON k.term = t.term), prs AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY a.term, b.term)"


def _cooc(spark, d) -> DataFrame:
    tokens = _tokens(spark, d)
    return aggregate.cooccurrences(tokens, aggregate.top_terms(tokens, 20))


@query("cooc_pairs", "SELECT a, b, n FROM prs", _COOC, "tok")
def _(spark, d):
    return _cooc(spark, d)


@query("cooc_edges", "SELECT a, b, n FROM prs WHERE n >= 10 ORDER BY n DESC, a, b", _COOC, "tok")
def _(spark, d):
    return _cooc(spark, d).filter("n >= 10").orderBy(F.desc("n"), "a", "b")


@query("cooc_nodes", "SELECT term, count(*) AS size FROM tok WHERE term IN (SELECT a FROM prs WHERE n >= 10 UNION SELECT b FROM prs WHERE n >= 10) GROUP BY term", _COOC, "tok")
def _(spark, d):
    tokens = _tokens(spark, d)
    counts = Table(aggregate.top_terms(tokens, 20)).df
    edges = Table(aggregate.cooccurrences(tokens, counts).filter("n >= 10")).df
    ends = edges.select(F.col("a").alias("term")).union(edges.select("b"))
    return counts.join(ends, "term", "left_semi").select("term", F.col("n").alias("size"))


both("basket_pairs", "SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM @lineitem a JOIN @lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY a.l_partkey, b.l_partkey HAVING count(*) >= 3")


@query("timeline_10k", """SELECT s.lang, k.term, round(10000 * CAST(coalesce(c.n, 0) AS DOUBLE) / CAST(s.total AS DOUBLE), 1) AS freq FROM (SELECT lang, count(*) AS total FROM read_ GROUP BY lang) s CROSS JOIN keys k
LEFT JOIN (SELECT lang, term, count(*) AS n FROM read_ GROUP BY lang, term) c ON c.lang = s.lang AND c.term = k.term""",
       "first_ AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 200), read_ AS (SELECT * FROM tok WHERE doc_id IN (SELECT doc_id FROM first_)), keys AS (SELECT unnest(['the', 'ind', 'innd', 'and', 'stion', 'ence', 'thnt', 'qué', 'absent', 'entst']) AS term)", "tok")
def _(spark, d):
    return aggregate.timeline(_tokens(spark, d), _docs(spark, d), "lang", "the ind innd and stion ence thnt qué absent entst".split())


# The fixed thesaurus is English; the corpus is invented prose, so its 400 most frequent terms stand in, dealt out over the categories.
_CATS = list(tables.THESAURUS)
_TH = f"""th AS (SELECT term, CAST((r - 1) % 5 AS INTEGER) AS p FROM (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM tok GROUP BY term) x WHERE r <= 400),
sc AS (SELECT t.doc_id, t.source, t.lang, count(*) AS words, {', '.join(f'count(CASE WHEN p = {i} THEN 1 END) AS "{c}"' for i, c in enumerate(_CATS))} FROM tok t LEFT JOIN th ON th.term = t.term GROUP BY t.doc_id, t.source, t.lang),
dom AS (SELECT *, greatest({', '.join(_CATS)}) AS most, CASE WHEN most = 0 THEN 'Neutral' {' '.join(f"WHEN {c} = most THEN '{c}'" for c in _CATS)} END AS dominant FROM sc)"""


def _thesaurus(tokens: DataFrame) -> DataFrame:
    ranked = aggregate.ranked_terms(tokens, 400)
    name = F.element_at(F.array(*map(F.lit, _CATS)), (F.col("r") - 1) % 5 + 1)
    return Table(ranked.select("term", name.alias("category"), ((F.col("r") - 1) % 5).cast("int").alias("cat_pos"))).df


def _scored(spark, d) -> DataFrame:
    tokens = _tokens(spark, d)
    return aggregate.thesaurus_scores(tokens, _thesaurus(tokens), ["source", "lang"])


@query("thesaurus_scores", f"SELECT doc_id, words, {', '.join(_CATS)} FROM sc", _TH, "tok")
def _(spark, d):
    return _scored(spark, d).select("doc_id", "words", *_CATS)


@query("dominant", "SELECT doc_id, dominant FROM dom", _TH, "tok")
def _(spark, d):
    return _scored(spark, d).select("doc_id", "dominant")


_KINDS = [*_CATS, "Neutral"]


@query("crosstab", "SELECT source, " + ", ".join(f"count(CASE WHEN dominant = '{c}' THEN 1 END) AS \"{c}\"" for c in _KINDS) + " FROM dom GROUP BY source", _TH, "tok")
def _(spark, d):
    return aggregate.crosstab(_scored(spark, d), "source", _KINDS)


_RATE = ", ".join(f"1000 * CAST(sum({c}) AS DOUBLE) / sum(words) AS \"{c}\"" for c in _CATS)


@query("radar", f"SELECT source, {', '.join(f'round({c}, 2) AS {c}' for c in _CATS)}, round((SELECT max(greatest({', '.join(_CATS)})) FROM rates) * 1.1e0, 2) AS axis FROM rates", _TH + f", rates AS (SELECT source, {_RATE} FROM sc GROUP BY source)", "tok")
def _(spark, d):
    return aggregate.radar(_scored(spark, d), "source", _CATS)


_SHARES = [c for c in _CATS if c != "CAREER"]


@query("regional_share", "SELECT lang, " + ", ".join(f"round(100 * CAST(count(CASE WHEN dominant = '{c}' THEN 1 END) AS DOUBLE) / count(*), 1) AS \"{c}\"" for c in _SHARES) + " FROM dom WHERE dominant NOT IN ('CAREER', 'Neutral') GROUP BY lang", _TH, "tok")
def _(spark, d):
    return aggregate.regional_share(_scored(spark, d), "lang", _KINDS)


@query("word_detail", "SELECT t.source, t.doc_id, " + "CASE p " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATS)) + " END AS category, t.term, count(*) AS n FROM tok t JOIN th ON th.term = t.term GROUP BY ALL", _TH, "tok")
def _(spark, d):
    tokens = _tokens(spark, d)
    return aggregate.word_detail(tokens, _thesaurus(tokens), ["source"])


_GR = """grp AS (SELECT term, 'g' || (r % 8) AS category, r AS word_pos FROM (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM tok GROUP BY term) x WHERE r <= 24),
own AS (SELECT DISTINCT doc_id, lang, term FROM tok), met AS (SELECT o.doc_id, o.lang, g.category, count(*) AS n, string_agg(g.term, ',' ORDER BY word_pos) AS found FROM own o JOIN grp g ON g.term = o.term GROUP BY ALL),
hits AS (SELECT m.*, (SELECT count(*) FROM grp WHERE grp.category = m.category) AS size, coalesce((SELECT string_agg(term, ',' ORDER BY word_pos) FROM grp WHERE grp.category = m.category AND NOT list_contains(string_split(m.found, ','), term)), '') AS missing FROM met m)"""


def _groups(tokens: DataFrame) -> DataFrame:
    ranked = aggregate.ranked_terms(tokens, 24)
    return Table(ranked.select("term", F.concat(F.lit("g"), F.col("r") % 8).alias("category"), F.col("r").alias("word_pos"))).df


def _grouped(spark, d) -> DataFrame:
    tokens = _tokens(spark, d)
    return aggregate.term_groups(tokens, _groups(tokens), ["lang"])


@query("term_groups", "SELECT doc_id, category, n AS count, found, missing, CASE WHEN n = size THEN 'perfect' ELSE 'partial' END AS kind FROM hits", _GR, "tok")
def _(spark, d):
    return _grouped(spark, d).select("doc_id", "category", F.col("count").cast("long").alias("count"), F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"), "kind")


@query("term_group_top", "SELECT doc_id, category, n AS count FROM hits WHERE n < size QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, doc_id) <= 20", _GR, "tok")
def _(spark, d):
    return aggregate.best_partial(_grouped(spark, d)).select("doc_id", "category", F.col("count").cast("long").alias("count"))


@query("term_occurrence", "SELECT category, g.term, count(*) AS docs FROM own o JOIN grp g ON g.term = o.term GROUP BY ALL", _GR, "tok")
def _(spark, d):
    tokens = _tokens(spark, d)
    return aggregate.term_documents(tokens, _groups(tokens))


@query("fixed_groups", "SELECT category, term, CAST(0 AS BIGINT) AS docs FROM (VALUES " + ", ".join(f"('{g}', '{w}')" for g, words in tables.TERM_GROUPS.items() for w in words) + ") v(category, term) WHERE term NOT IN (SELECT term FROM tok)", "", "tok")
def _(spark, d):
    return aggregate.term_documents(_tokens(spark, d)).filter("docs = 0")


@query("term_regions", "SELECT category, lang, count(*) AS n, round(100 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY category), 6) AS pct FROM hits WHERE n = size GROUP BY category, lang", _GR, "tok")
def _(spark, d):
    return aggregate.perfect_by_region(_grouped(spark, d), "lang")


# Clusters of the profile: the embeddings' labels, an embedding standing for the document of its number.
@query("cluster_profile", """SELECT l.cluster, count(*) AS size, round(avg(sil.s), 6) AS silhouette,
(SELECT string_agg(term, ',' ORDER BY n DESC, term) FROM (SELECT * FROM tc WHERE tc.cluster = l.cluster ORDER BY n DESC, term LIMIT 5) x) AS terms,
(SELECT region FROM rc WHERE rc.cluster = l.cluster ORDER BY n DESC, region LIMIT 1) AS region, round(100 * (SELECT max(n) FROM rc WHERE rc.cluster = l.cluster) / CAST((SELECT sum(n) FROM rc WHERE rc.cluster = l.cluster) AS DOUBLE), 6) AS share,
(SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (SELECT doc_id FROM labels_ y WHERE y.cluster = l.cluster ORDER BY doc_id LIMIT 3) z) AS examples
FROM labels_ l JOIN sil ON sil.vec_id = l.doc_id GROUP BY l.cluster""", f"""{WEIGHTS}, {_SIL}, labels_ AS (SELECT vec_id AS doc_id, label AS cluster FROM embeddings),
tc AS (SELECT cluster, term, count(*) AS n FROM labels_ JOIN top100 ON top100.doc_id = labels_.doc_id GROUP BY ALL), rc AS (SELECT cluster, lang AS region, count(*) AS n FROM labels_ JOIN documents ON documents.doc_id = labels_.doc_id GROUP BY ALL)""", "tok")
def _(spark, d):
    labels = _vectors(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    regions = _docs(spark, d).select("doc_id", F.col("lang").alias("region"))
    scores = dense.silhouette(_vectors(spark, d), "label").select(F.col("vec_id").alias("doc_id"), "s")
    profile = aggregate.cluster_profile(labels, _top100(spark, d).select("doc_id", "term"), regions, scores)
    return profile.select("cluster", "size", F.round("silhouette", 6).alias("silhouette"), F.array_join("terms", ",").alias("terms"), "region", "share", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("features_json", """SELECT doc_id, '{"tokens":[' || string_agg('"' || term || '"', ',' ORDER BY rank) || '],"region":"' || any_value(lang) || '","rank":' || any_value(n_chars) || '}' AS json
FROM (SELECT t.doc_id, t.term, t.rank, x.lang, x.n_chars FROM top100 t JOIN documents x ON x.doc_id = t.doc_id) y GROUP BY doc_id""", WEIGHTS, "tok")
def _(spark, d):
    return features.features_json(_top100(spark, d), _docs(spark, d))


# The token graph
def _lists(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, terms): the top-100 terms of each document in one row."""
    documents, n = _counted(spark, d), _docs(spark, d).count()
    kept = Table(vectors.kept_terms(vectors.counts_of(documents), n)).df
    return Table(vectors.top_lists(documents, kept, n, 100)).df


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return Table(graph.list_weights(_lists(spark, d)).filter("weight > 0.2")).df


def _knn(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    return Table(graph.knn_edges(graph.list_weights(lists), graph.entropies(lists.select("doc_id", F.explode("terms").alias("term"))))).df


@query("jaccard_edges", "SELECT a, b, round(weight, 8) AS weight FROM edges", GRAPH, "tok")
def _(spark, d):
    return _rounded(_edges(spark, d), "weight")


_ENT = GRAPH + """, dn AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS d FROM top100),
ent0 AS (SELECT term, CAST(f AS DOUBLE) AS f, d, CAST(f AS DOUBLE) * (1 + 1e-10) + (d - f) * 1e-10 AS s FROM freq CROSS JOIN dn),
ent AS (SELECT term, -(f * ((1 + 1e-10) / s) * ln((1 + 1e-10) / s) + (d - f) * (1e-10 / s) * ln(1e-10 / s)) AS entropy FROM ent0)"""  # fmt: skip


def _entropies(spark, d) -> DataFrame:
    return graph.entropies(_lists(spark, d).select("doc_id", F.explode("terms").alias("term")))


@query("entropy", "SELECT term, round(entropy, 8) AS entropy FROM ent", _ENT, "tok")
def _(spark, d):
    return _rounded(_entropies(spark, d), "entropy")


# Ranked by rounded values: entropies that are equal in one engine may differ in the last bit in the other.
@query("generic_terms", """SELECT * FROM (SELECT 'generic' AS kind, term, e AS entropy FROM (SELECT term, round(entropy, 8) AS e FROM ent) x ORDER BY e DESC, term LIMIT 10) g
UNION ALL SELECT * FROM (SELECT 'specific' AS kind, term, e AS entropy FROM (SELECT term, round(entropy, 8) AS e FROM ent) x ORDER BY e, term LIMIT 10) s""", _ENT, "tok")
def _(spark, d):
    return graph.extreme_terms(_rounded(_entropies(spark, d), "entropy"))


_KNN = _ENT + """, both_ AS (SELECT a, b, weight FROM jac UNION ALL SELECT b, a, weight FROM jac),
nn AS (SELECT a, b, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM both_ WHERE weight >= 0.2),
knn AS (SELECT DISTINCT CASE WHEN ea.entropy > eb.entropy OR (ea.entropy = eb.entropy AND nn.a < nn.b) THEN nn.a ELSE nn.b END AS src, CASE WHEN ea.entropy > eb.entropy OR (ea.entropy = eb.entropy AND nn.a < nn.b) THEN nn.b ELSE nn.a END AS dst, weight FROM nn JOIN ent ea ON ea.term = nn.a JOIN ent eb ON eb.term = nn.b WHERE r <= 5)"""  # fmt: skip


@query("knn_edges", "SELECT src, dst, round(weight, 8) AS weight FROM knn", _KNN, "tok")
def _(spark, d):
    return _rounded(_knn(spark, d), "weight")


@query("weighted_degree", "SELECT term, round(sum(weight), 8) AS degree FROM (SELECT src AS term, weight FROM knn UNION ALL SELECT dst, weight FROM knn) x GROUP BY term", _KNN, "tok")
def _(spark, d):
    return _rounded(graph.node_attributes(_knn(spark, d)).select(F.col("node").alias("term"), F.col("weighted").alias("degree")), "degree")


@query("degree_in_out", "SELECT term, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS term, 1 AS o, 0 AS i FROM knn UNION ALL SELECT dst, 0, 1 FROM knn) x GROUP BY term", _KNN, "tok")
def _(spark, d):
    return graph.node_attributes(_knn(spark, d)).select(F.col("node").alias("term"), "n_out", "n_in")


_SYM = GRAPH + ", sym AS (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges), deg AS (SELECT a AS term, count(*) AS degree FROM sym GROUP BY a)"


@query("degree", "SELECT term AS node, degree, round(CAST((SELECT count(*) FROM deg) - 1 AS DOUBLE) / degree, 8) AS inverse FROM deg", _SYM, "tok")
def _(spark, d):
    return graph.degrees(_edges(spark, d))


@query("degree_top", "SELECT 'degree' AS metric, term AS node, CAST(degree AS DOUBLE) AS value, row_number() OVER (ORDER BY degree DESC, term) AS rank FROM deg QUALIFY rank <= 10", _SYM, "tok")
def _(spark, d):
    return graph.top_nodes(graph.degrees(_edges(spark, d)).select("node", "degree"))


@query("common_neighbors", "SELECT x.b AS a, y.b AS b, count(*) AS n FROM sym x JOIN sym y ON x.a = y.a AND x.b < y.b GROUP BY x.b, y.b", _SYM, "tok")
def _(spark, d):
    return graph.common_neighbours(_edges(spark, d))


#: Rounds that the SQL unrolls. The queries named without rounds stop by tolerance, as tests compare.
_ROUNDS = 20
_PR = _KNN + ", nodes AS (SELECT src AS v FROM knn UNION SELECT dst FROM knn), nn_ AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), outw AS (SELECT src, sum(weight) AS o FROM knn GROUP BY src), p0 AS MATERIALIZED (SELECT v, 1 / n AS p FROM nodes CROSS JOIN nn_)"
for _k in range(_ROUNDS):
    _PR += f""", g{_k} AS (SELECT sum(CASE WHEN o.src IS NULL THEN p ELSE 0 END) AS g FROM p{_k} LEFT JOIN outw o ON o.src = v),
i{_k} AS (SELECT dst, sum(p * weight / o) AS i FROM knn JOIN outw ON outw.src = knn.src JOIN p{_k} ON v = knn.src GROUP BY dst),
p{_k + 1} AS MATERIALIZED (SELECT v, 0.15e0 / n + 0.85e0 * (coalesce(i, 0) + coalesce(g, 0) / n) AS p FROM nodes LEFT JOIN i{_k} ON dst = v CROSS JOIN g{_k} CROSS JOIN nn_)"""
_HITS = _KNN + ", h0 AS MATERIALIZED (SELECT v, CAST(1 AS DOUBLE) AS h FROM (SELECT src AS v FROM knn UNION SELECT dst FROM knn) x)"
for _k in range(_ROUNDS):
    _HITS += f""", ra{_k} AS MATERIALIZED (SELECT dst AS v, sum(weight * h) AS a FROM knn JOIN h{_k} ON v = src GROUP BY dst), na{_k} AS (SELECT sqrt(sum(a * a)) AS z FROM ra{_k}),
a{_k} AS MATERIALIZED (SELECT h0.v, coalesce(a, 0) / z AS a FROM h0 LEFT JOIN ra{_k} r ON r.v = h0.v CROSS JOIN na{_k}),
rh{_k} AS MATERIALIZED (SELECT src AS v, sum(weight * a) AS h FROM knn JOIN a{_k} ON v = dst GROUP BY src), nh{_k} AS (SELECT sqrt(sum(h * h)) AS z FROM rh{_k}),
h{_k + 1} AS MATERIALIZED (SELECT h0.v, coalesce(r.h, 0) / z AS h FROM h0 LEFT JOIN rh{_k} r ON r.v = h0.v CROSS JOIN nh{_k})"""
_PR, _HITS = (s.replace(", knn AS (", ", knn AS MATERIALIZED (").replace(",\nknn AS (", ",\nknn AS MATERIALIZED (") for s in (_PR, _HITS))


@query("pagerank_k", f"SELECT v AS node, round(p, 8) AS rank FROM p{_ROUNDS}", _PR, "tok")
def _(spark, d):
    return graph.pagerank(_knn(spark, d), _ROUNDS, tolerance=None)


@query("pagerank")
def _(spark, d):
    return graph.pagerank(_knn(spark, d))


@query("hits")
def _(spark, d):
    return _rounded(graph.hits(_knn(spark, d)), "authority", "hub", places=6)


@query("hits_k", f"SELECT h.v AS node, round(a, 8) AS authority, round(h, 8) AS hub FROM h{_ROUNDS} h JOIN a{_ROUNDS - 1} a ON a.v = h.v", _HITS, "tok")
def _(spark, d):
    return graph.hits(_knn(spark, d), _ROUNDS, None)


_KATZ = _SYM.replace("edges AS (", "edges AS MATERIALIZED (") + ", k0 AS (SELECT term AS v, CAST(1 AS DOUBLE) AS x FROM deg)"
for _k in range(20):
    _KATZ += f", k{_k + 1} AS MATERIALIZED (SELECT a AS v, 0.001e0 * sum(x) AS x FROM sym JOIN k{_k} ON v = b GROUP BY a)"
_KATZ += ", kz AS (SELECT v, round(sum(x), 10) AS katz FROM (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(1, 21)) + ") x GROUP BY v)"


@query("katz_k", "SELECT v AS node, katz FROM kz", _KATZ, "tok")
def _(spark, d):
    return graph.katz(_edges(spark, d), 0.001)


@query("degree_katz", "SELECT v AS node, degree, katz, CASE WHEN row_number() OVER (ORDER BY katz DESC, v) <= 5 THEN v END AS label FROM kz JOIN deg ON term = v", _KATZ, "tok")
def _(spark, d):
    return graph.degree_and_katz(_edges(spark, d), 0.001)


_COMP = _SYM.replace("edges AS (", "edges AS MATERIALIZED (") + ", reach(node, root) AS (SELECT term, term FROM deg UNION SELECT s.b, r.root FROM reach r JOIN sym s ON s.a = r.node WHERE r.root < s.b), comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"


@query("components", "SELECT node, component FROM comp", _COMP, "tok")
def _(spark, d):
    return graph.components(_edges(spark, d))


_GIANT = _COMP + ", big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), ge AS MATERIALIZED (SELECT s.a, s.b, s.weight FROM sym s JOIN comp c ON c.node = s.a JOIN big ON big.component = c.component)"


def _giant(spark, d) -> DataFrame:
    return graph.giant(_edges(spark, d))


@query("giant_component", "SELECT a, b FROM ge WHERE a < b", _GIANT, "tok")
def _(spark, d):
    return _giant(spark, d).select("a", "b")


_LEVELS = 14
_DIST = _GIANT + ", d0 AS MATERIALIZED (SELECT DISTINCT a AS s, a AS v, 0 AS d, CAST(1 AS DOUBLE) AS sigma FROM ge), l0 AS (SELECT * FROM d0)"
for _k in range(_LEVELS):
    _DIST += f""", l{_k + 1} AS MATERIALIZED (SELECT x.s, e.b AS v, {_k + 1} AS d, sum(x.sigma) AS sigma FROM l{_k} x JOIN ge e ON e.a = x.v ANTI JOIN d{_k} y ON y.s = x.s AND y.v = e.b GROUP BY x.s, e.b),
d{_k + 1} AS MATERIALIZED (SELECT * FROM d{_k} UNION ALL SELECT * FROM l{_k + 1})"""
_DIST += f", dd AS (SELECT * FROM d{_LEVELS})"


@query("apsp", "SELECT s, v, d FROM dd", _DIST, "tok")
def _(spark, d):
    return graph.distances(_giant(spark, d)).select("s", "v", "d")


@query("closeness", "SELECT s AS node, round(CASE WHEN sum(d) > 0 THEN CAST(count(*) - 1 AS DOUBLE) / CAST(sum(d) AS DOUBLE) ELSE 0 END, 8) AS closeness FROM dd GROUP BY s", _DIST, "tok")
def _(spark, d):
    return graph.closeness(graph.distances(_giant(spark, d)))


@query("eccentricity", "SELECT s AS node, max(d) AS far, round(1 / CAST(max(d) AS DOUBLE), 8) AS eccentricity FROM dd GROUP BY s", _DIST, "tok")
def _(spark, d):
    return graph.eccentricity(graph.distances(_giant(spark, d)))


@query("center_periphery", "SELECT node, far, CASE WHEN far = lo THEN 'center' ELSE 'periphery' END AS kind FROM (SELECT node, far, min(far) OVER () AS lo, max(far) OVER () AS hi FROM (SELECT s AS node, max(d) AS far FROM dd GROUP BY s) x) y WHERE far = lo OR far = hi", _DIST, "tok")
def _(spark, d):
    return graph.center_periphery(graph.distances(_giant(spark, d)))


_BETWEEN = "SELECT n.v AS node, round(coalesce(b, 0) / ((c - 1) * (c - 2) / 2), 8) AS betweenness FROM (SELECT DISTINCT s AS v FROM dd) n LEFT JOIN (SELECT x.v, sum(x.sigma * y.sigma / z.sigma) AS b FROM dd x JOIN dd y ON y.s = x.v JOIN dd z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s < y.v AND x.d > 0 AND y.d > 0 GROUP BY x.v) t ON t.v = n.v CROSS JOIN (SELECT CAST(count(DISTINCT s) AS DOUBLE) AS c FROM dd) k"


@query("betweenness", _BETWEEN, _DIST, "tok")
def _(spark, d):
    return graph.betweenness(_giant(spark, d))


@query("freeman_betweenness", _BETWEEN.replace(" / ((c - 1) * (c - 2) / 2), 8)", ", 8)"), _DIST, "tok")
def _(spark, d):
    return graph.betweenness(_giant(spark, d), normalised=False)


@query("rcc_top")
def _(spark, d):
    return graph.residual_closeness(_giant(spark, d), top=10)


@query("rcc_all")
def _(spark, d):
    return graph.residual_closeness(_giant(spark, d), top=0)


@query("top_metrics")
def _(spark, d):
    knn = _knn(spark, d)
    scores = graph.pagerank(knn).join(graph.hits(knn), "node").join(graph.node_attributes(knn).select("node", "weighted", "n_in", "n_out"), "node")
    return graph.top_nodes(Table(scores).df)


def _communities(spark, d) -> tuple[DataFrame, DataFrame]:
    edges = _edges(spark, d)
    return edges, graph.communities(edges)


@query("louvain")
def _(spark, d):
    return _communities(spark, d)[1]


@query("community_leaders")
def _(spark, d):
    return graph.leaders(*_communities(spark, d))


@query("broker_context")
def _(spark, d):
    return graph.brokers(*_communities(spark, d))


# With labels that SQL can name, the first letter in place of a community, both can be held against it.
_LETTERS = _SYM + ", lab AS (SELECT term AS node, CAST(unicode(substring(term, 1, 1)) AS INTEGER) AS community FROM deg)"


def _lettered(spark, d) -> tuple[DataFrame, DataFrame]:
    edges = _edges(spark, d)
    nodes = graph.degrees(edges).select("node")
    return edges, nodes.withColumn("community", F.ascii(F.substring("node", 1, 1)))


@query("leaders_by_letter", "SELECT community, node, degree, r AS rank FROM (SELECT x.community, x.node, count(*) AS degree, row_number() OVER (PARTITION BY x.community ORDER BY count(*) DESC, x.node) AS r FROM sym JOIN lab x ON x.node = a JOIN lab y ON y.node = b AND y.community = x.community GROUP BY x.community, x.node) z WHERE r <= 5", _LETTERS, "tok")
def _(spark, d):
    return graph.leaders(*_lettered(spark, d))


@query("brokers_by_letter", "SELECT a AS node, count(*) AS neighbours, count(DISTINCT community) AS communities FROM sym JOIN lab ON node = b GROUP BY a", _LETTERS, "tok")
def _(spark, d):
    return graph.brokers(*_lettered(spark, d))


@query("gexf_export", "SELECT a, b, weight FROM edges", GRAPH, "tok")
def _(spark, d):
    return graph.gexf_rows(_edges(spark, d))
