"""Token and text operators (T, C9): declarative, no Python on the data path except where a callback regex needs it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import Table, ship

# The NLTK English stop words, and the domain words that the reference adds.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his "
    "himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had having do does did doing a an the and but "
    "if or because as until while of at by for with about against between into through during before after above "
    "below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don don't "
    "should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn "
    "wasn't weren weren't won won't wouldn wouldn't 's"
).split()
DOMAIN_WORDS = "qs http https www com org one two also since many well".split()
KWIC_STOPWORDS = "the a an of in to for and on with its their our have has".split()
MIN_WORD_LENGTH = 3
#: Split words up to this number are with each task that looks them up.
FIXES = 200_000
_SIGNS = ";@#$%&?!()[]{}<>\"“”«»*"


def raw_tokens(text: Column) -> Column:
    """Lower-cased word tokens as a Treebank-like tokeniser leaves them: mixed and hyphenated forms stay whole."""
    t = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    t = F.regexp_replace(t, r"'[\p{L}\p{N}_]+", "")
    # Signs one by one without a regular expression; each of these is a word's end wherever it stands.
    t = F.replace(F.translate(t, _SIGNS, " " * len(_SIGNS)), F.lit("--"), F.lit(" "))
    t = F.regexp_replace(t, r"\.\.+", " ")
    t = F.regexp_replace(t, r"[,:]([^0-9])", " $1")
    t = F.regexp_replace(t, r"[.,:](\s|$)", " $1")
    return F.split(t, r"\s+")


def extract_tokens(text: Column, extra: Sequence[str] = DOMAIN_WORDS) -> Column:
    """Alphabetic tokens of three letters or more that are no stop words; null text gives an empty array."""
    word = rf"^\p{{L}}{{{MIN_WORD_LENGTH},}}$"
    kept = F.filter(raw_tokens(text), lambda w: ~w.isin(*STOPWORDS, *extra) & w.rlike(word))
    return F.coalesce(kept, F.array().cast("array<string>"))


def word_tokens(text: Column) -> Column:
    """T5: runs of Unicode letters, digits and underscores on lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(doc_id, pos, term), pos from 0."""
    tokens = extract_tokens(F.col(text_col)) if tokens is None else tokens
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens).alias("pos", "term"))


def token_modes(docs: DataFrame, lexicon: DataFrame | None = None, first: int | None = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, term, stem, lemma): the first tokens of each document as they are, as stems and as lemmas.

    Stems and lemmas are taken of the distinct words only. A lemma has to be in the lexicon (term), by default the
    words themselves; first=None takes all tokens.
    """
    from corpusloom.functions.stem import lemmas, stems

    tokens = extract_tokens(F.col(text_col))
    shown = tokens if first is None else F.slice(tokens, 1, first)
    rows = token_rows(docs, id_col, text_col, shown)
    words = Table(token_rows(docs, id_col, text_col).select("term").distinct()).df
    return rows.join(stems(words), "term").join(lemmas(words, words if lexicon is None else lexicon), "term").select("doc_id", "pos", "term", "stem", "lemma")


def outcome_counts(filtered: DataFrame, examples: int = 3) -> DataFrame:
    """(missing, empty, ok, examples): outcomes of window_filter, and the first documents without targets."""
    text = F.col("filtered")
    missing = text == "MISSING_KEY"
    counts = filtered.agg(F.count_if(missing).alias("missing"), F.count_if(text == "").alias("empty"), F.count_if(~missing & (text != "")).alias("ok"))
    shown = filtered.filter(missing).select("doc_id").orderBy("doc_id").limit(examples).agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    return counts.crossJoin(shown)  # one row each


def previous_words(docs: DataFrame, pivot: str, stop: Sequence[str] = KWIC_STOPWORDS, k: int = 15) -> DataFrame:
    """Words right before the pivot, without stop words, most frequent first."""
    words = word_tokens(F.col("text"))
    at = F.transform(words, lambda w, i: F.when((w == pivot) & (i > 0), F.element_at(words, i)))
    return (
        docs.select(F.explode(at).alias("word"))
        .filter(F.col("word").isNotNull() & ~F.col("word").isin(*stop))
        .groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)
    )


def snippets(docs: DataFrame, pivot: str, window: int = 6) -> DataFrame:
    """(doc_id, pos, snippet) of each pivot with `window` words on either side, pivots in capitals."""
    rows = docs.select("doc_id", word_tokens(F.col("text")).alias("w")).select("doc_id", "w", F.posexplode("w").alias("pos", "word"))
    lo = F.greatest(F.col("pos") - window, F.lit(0))
    part = F.slice("w", lo + 1, F.least(F.col("pos") + window + 1, F.size("w")) - lo)
    shown = F.array_join(F.transform(part, lambda w: F.when(w == pivot, F.upper(w)).otherwise(w)), " ")
    return rows.filter(F.col("word") == pivot).select("doc_id", "pos", shown.alias("snippet"))


def ngrams_after(docs: DataFrame, trigger: Sequence[str], n: int = 6, k: int = 20, include_last: bool = False) -> DataFrame:
    """The n words after each trigger phrase, counted; the final valid position is skipped unless asked for."""
    t = len(trigger)
    w = word_tokens(F.col("text"))
    last = F.size("w") - t - n - (0 if include_last else 1)
    at = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
                  lambda i: F.slice("w", i + 1, t) == F.array(*map(F.lit, trigger)))
    return (
        docs.select(w.alias("w")).select("w", F.explode(at).alias("i"))
        .groupBy(F.array_join(F.slice("w", F.col("i") + t + 1, n), " ").alias("ngram")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "ngram").limit(k)
    )


def written_tokens(text: Column) -> Column:
    """Words and signs of a text as they are written; a word keeps its inner hyphens, dots and apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+(?:[-'’.][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\x09-\x0D\x20]"), F.lit(0))


def window_filter(docs: DataFrame, targets: DataFrame, window: int = 5, stemmed: bool = True) -> DataFrame:
    """(doc_id, filtered): words within `window` of any word whose stem is a target of the document, gaps shown as
    "..."; targets is (doc_id, stem), or whole words in lower case if not stemmed.

    Documents without targets give MISSING_KEY, those without a hit the empty string. Stems are taken of the distinct
    words only, and words meet their document's targets by an equi-join.
    """
    from corpusloom.functions.stem import stems

    words = docs.select("doc_id", F.coalesce(written_tokens(F.col("text")), F.array().cast("array<string>")).alias("w"))
    at = words.select("doc_id", F.posexplode("w").alias("pos", "word")).select("doc_id", "pos", F.lower("word").alias("term"))
    if stemmed:
        at = at.join(stems(at.select("term").distinct()), "term").withColumnRenamed("stem", "key")
    else:
        at = at.withColumnRenamed("term", "key")
    keys = targets.select("doc_id", F.col("stem").alias("key")).distinct()
    hits = at.join(keys, ["doc_id", "key"], "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("hits"))
    met = words.join(hits, "doc_id", "left").join(keys.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    spans = F.transform(F.coalesce("hits", F.array().cast("array<int>")), lambda i: F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, F.size("w") - 1)))
    near = met.select("doc_id", "w", "known", F.array_sort(F.array_distinct(F.flatten(spans))).alias("near"))
    gap = lambda p, k: F.when((k > 0) & (F.element_at("near", F.greatest(k, F.lit(1))) < p - 1), "... ").otherwise("")
    shown = F.array_join(F.transform("near", lambda p, k: F.concat(gap(p, k), F.element_at("w", p + 1))), " ")
    return near.select("doc_id", F.when(F.col("known").isNull(), "MISSING_KEY").otherwise(shown).alias("filtered"))


def punctuation_space(text: Column) -> Column:
    """C9, second step: a space between punctuation and the letter glued to it."""
    return F.regexp_replace(text, r"([.,!?;:])([a-zA-Z])", "$1 $2")


def split_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, fixed, changed) for distinct words: valid ones stay; else the first cut from 2 to length - 3 whose
    halves are both in the dictionary (word), the left one capitalised if the word was."""
    known = dictionary.select(F.lower("word").alias("d")).distinct()
    low = words.select("word").distinct().withColumn("low", F.lower("word"))
    todo = low.join(known, F.col("low") == F.col("d"), "left_anti").filter(F.length("word") >= 5)
    cuts = todo.withColumn("i", F.explode(F.sequence(F.lit(2), F.length("word") - 3)))
    halves = cuts.select("word", "i", F.substring("low", F.lit(1), F.col("i")).alias("l"), F.expr("substring(low, i + 1)").alias("r"))
    found = (
        halves.join(known.withColumnRenamed("d", "l"), "l", "left_semi").join(known.withColumnRenamed("d", "r"), "r", "left_semi")
        .groupBy("word").agg(F.min("i").alias("i"))
    )
    joined = low.join(found, "word", "left")
    left = F.when(F.substring("word", 1, 1).rlike("^[A-Z]$"), F.initcap(F.expr("substring(low, 1, i)"))).otherwise(F.expr("substring(low, 1, i)"))
    fixed = F.when(F.col("i").isNull(), F.col("word")).otherwise(F.concat(left, F.lit(" "), F.expr("substring(low, i + 1)")))
    return joined.select("word", fixed.alias("fixed"), F.col("i").isNotNull().alias("changed"))


def rewrite_merged(docs: DataFrame, fixes: DataFrame) -> DataFrame:
    """(doc_id, text, n_changes) with merged words split by `fixes` of split_words and punctuation spaced.

    Texts stay whole: of a document only its distinct words are looked up, and those that are split come back to it in
    one list. Rows of one id are rewritten each by itself; a null text counts as empty.
    """
    ship(docs.sparkSession)
    # A word ends where no letter, digit or underscore of any script follows; other runs of them are left alone.
    word = r"(?<![\p{L}\p{N}_])[a-zA-Z]+(?:-[a-zA-Z]+)*(?![\p{L}\p{N}_])"
    changed = Table(fixes.filter("changed").select("word", "fixed")).df
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(0)))).alias("word"))
    small = changed.limit(FIXES + 1).count() <= FIXES
    hits = words.join(F.broadcast(changed) if small else changed, "word").groupBy(F.col("doc_id").alias("id"))
    maps = hits.agg(F.collect_set(F.struct("word", "fixed")).alias("fixed"))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(maps, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    pieces = F.regexp_extract_all("text", F.lit(word + r"|[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    none = F.col("fixed").isNull()
    rows = met.select("doc_id", F.when(none, F.col("text")).alias("text"), F.when(~none, pieces).alias("p"), F.col("fixed.word").alias("w"), F.col("fixed.fixed").alias("f"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, times = [], []
            for text, p, w, f in zip(*(c.to_pylist() for c in batch.columns[1:])):
                n = 0
                if p is not None:
                    known = dict(zip(w, f))
                    found = [known.get(x) for x in p]
                    n = len(p) - found.count(None)
                    text = "".join([x if y is None else y for x, y in zip(p, found)])
                texts.append(text)
                times.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(times, pa.int64())], ["doc_id", "text", "n_changes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(put, f"doc_id {kind}, text string, n_changes long")
    return out.select("doc_id", punctuation_space(F.col("text")).alias("text"), "n_changes")


def top_words(terms: DataFrame, k: int, *by: str) -> DataFrame:
    """The k most frequent terms, of each group if given; ties alphabetical."""
    counts = terms.groupBy(*by, "term").agg(F.count("*").alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), "term").limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
