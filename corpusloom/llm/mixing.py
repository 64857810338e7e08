"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import Table, ship

WORD = r"[^\x20\x09-\x0D]+"
#: Per-source tables up to these bounds are broadcast; larger ones are joined by shuffles that AQE splits.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20
_P = "__corpusloom_"
_DIGIT = 12


def word_count(text: Column) -> Column:
    """Number of runs of characters other than \\x20 and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(key: Column, seed: int) -> Column:
    """63 bits of an order that is seeded by the id: the first 60 of an MD5, which any engine can recompute."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.shiftleft(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), 3)


def _fits(table: DataFrame, source: str) -> bool:
    n, size = table.agg(F.count("*"), F.sum(F.octet_length(F.coalesce(source, F.lit(""))))).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def _on_source(left: DataFrame, right: DataFrame, fits: bool, how: str, *more: str) -> DataFrame:
    """Null-safe join on the source (and `more`); right has its columns under names of its own."""
    cond = left[f"{_P}source"].eqNullSafe(right[f"{_P}of"])
    for c in more:
        cond = cond & (left[c] == right[f"{c}_"])
    return left.join(F.broadcast(right) if fits else right, cond, how).drop(f"{_P}of", *[f"{c}_" for c in more])


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0
) -> Table:
    """(of, source_size, target) for each source of a (source, size) table whose columns carry the internal prefix.

    Sources in code point order, null last, weigh `weights` in turn and share `share` times all sizes. Sources that
    would exceed max_epochs times their size stop there; what is left is reshared among the rest by weight, until none
    exceeds it. Each pass is one aggregate over the sources; one row a pass reaches the driver.
    """
    stats = sizes.groupBy(F.col(f"{_P}source").alias(f"{_P}of")).agg(F.sum(f"{_P}size").alias(f"{_P}all"))
    # Ranks without one task for all sources: a range sort, then an offset for each of its partitions.
    ranged = Table(
        stats.orderBy(F.col(f"{_P}of").isNull(), f"{_P}of").withColumn("part", F.spark_partition_id())
    )
    before, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.df.groupBy("part").count().collect())):
        offsets.append((part, before))
        before += n
    start = reduce(lambda c, po: c.when(F.col("part") == po[0], F.lit(po[1])), offsets, F.when(F.lit(False), F.lit(0)))
    order = Window.partitionBy("part").orderBy(F.col(f"{_P}of").isNull(), f"{_P}of")
    place = (start + F.row_number().over(order) - 1) % len(weights)
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    weighed = Table(ranged.df.withColumn("w", weigh).withColumn("cap", F.col(f"{_P}all") * F.lit(float(max_epochs))))
    total = weighed.df.agg(F.sum(f"{_P}all")).first()[0] or 0
    budget, level, clamped = share * total, None, -1
    while True:
        is_free = F.col("cap") > 0 if level is None else F.col("cap") > F.col("w") * F.lit(level)
        w, spent, n = weighed.df.agg(
            F.sum(F.when(is_free, F.col("w"))), F.sum(F.when(~is_free, F.col("cap"))), F.count(F.when(~is_free, 1))
        ).first()
        if not w or n == clamped:
            break
        level, clamped = max(0.0, budget - (spent or 0.0)) / w, n
    target = F.col("cap") if level is None else F.least("cap", F.col("w") * F.lit(level))
    out = Table(weighed.df.select(f"{_P}of", F.col(f"{_P}all").alias(f"{_P}source_size"), target.alias(f"{_P}target")))
    ranged.drop()
    weighed.drop()
    return out


def _cut(rows: DataFrame, wanted: DataFrame, fits: bool) -> Table:
    """(of, cut, cut_left, cut_size): in seeded order, documents below the cut add up to what a source still wants,
    but for cut_left words that the documents at the cut (cut_size words) give. Digits of the order are fixed from the
    top, 4,096 sums a source at a time, so that no task ever orders all documents of a source."""
    by = Window.partitionBy(f"{_P}source")
    now = Table(wanted.filter(f"{_P}want > 0"))
    for level in (0, 1, 2):
        live = rows
        if level:
            live = _on_source(rows.withColumn(f"{_P}d", F.shiftright(f"{_P}u", 63 - _DIGIT * level)), now.df, fits, "inner", f"{_P}d")
        else:
            live = _on_source(rows, now.df, fits, "inner")
        digit = F.shiftright(f"{_P}u", 63 - _DIGIT * (level + 1)) if level < 2 else F.col(f"{_P}u")
        summed = live.groupBy(f"{_P}source", f"{_P}want", digit.alias(f"{_P}d_")).agg(F.sum(f"{_P}size").alias("s"))
        upto = F.sum("s").over(by.orderBy(f"{_P}d_").rowsBetween(Window.unboundedPreceding, 0))
        after = Table(
            summed.withColumn("upto", upto)
            .filter((F.col("upto") >= F.col(f"{_P}want")) & (F.col("upto") - F.col("s") < F.col(f"{_P}want")))
            .select(F.col(f"{_P}source").alias(f"{_P}of"), f"{_P}d_", "s", (F.col(f"{_P}want") - F.col("upto") + F.col("s")).alias(f"{_P}want"))
        )
        now.drop()
        now = after
    return now


def with_taken(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """docs with five columns more, prefixed: size, source_size, target, whole (repetitions of every document of the
    source) and taken (words the mix takes, repeats counted).

    A source's target of t words over s is t // s whole repetitions of each of its documents; what is left goes, in an
    order seeded by the id, to one more repetition of as many documents, the last of them in part, so that a source's
    taken words add up to its rounded target. Documents of equal place (repeated ids) share in proportion. Null and
    blank texts have size 0 and give 0. Null sources are one source, the last. Empty tables give an empty table.
    """
    ship(docs.sparkSession)
    sized = docs.withColumns(
        {
            f"{_P}size": word_count(F.col(text_col)),
            f"{_P}source": F.col(source_col),
            f"{_P}u": _place(F.col(id_col), seed),
        }
    )
    small = Table(sized.select(f"{_P}source", f"{_P}size", f"{_P}u"))
    targets = source_targets(small.df, weights, share, max_epochs)
    fits = _fits(targets.df, f"{_P}of")
    whole = F.when(F.col(f"{_P}source_size") > 0, F.floor(F.col(f"{_P}target") / F.col(f"{_P}source_size"))).otherwise(0)
    plan = targets.df.withColumn(f"{_P}whole", whole.cast("long")).withColumn(
        f"{_P}want", F.round(f"{_P}target").cast("long") - F.col(f"{_P}whole") * F.col(f"{_P}source_size")
    )
    cut = _cut(small.df.filter(f"{_P}size > 0"), plan.select(f"{_P}of", f"{_P}want"), fits)
    of = cut.df.select(F.col(f"{_P}of").alias("of"), F.col(f"{_P}d_").alias(f"{_P}cut"), F.col("s").alias(f"{_P}cut_size"), F.col(f"{_P}want").alias(f"{_P}cut_left"))
    plan = plan.join(of, plan[f"{_P}of"].eqNullSafe(of["of"]), "left").drop("of", f"{_P}want")
    share_of_cut = F.floor(F.col(f"{_P}size") * F.col(f"{_P}cut_left") / F.col(f"{_P}cut_size"))
    more = (
        F.when(F.col(f"{_P}u") < F.col(f"{_P}cut"), F.col(f"{_P}size"))
        .when(F.col(f"{_P}u") == F.col(f"{_P}cut"), share_of_cut)
        .otherwise(0)
    )
    return (
        _on_source(sized, Table(plan).df, fits, "left")
        .withColumn(f"{_P}taken", (F.col(f"{_P}whole") * F.col(f"{_P}size") + more).cast("long"))
        .drop(f"{_P}source", f"{_P}u", f"{_P}cut", f"{_P}cut_left", f"{_P}cut_size")
    )


def mixed(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The mix itself: each document once for each whole repetition, and its first words for a fractional one.

    Columns are those of docs. A document of which the mix takes nothing is absent.
    """
    planned = with_taken(docs, text_col=text_col, **how)
    size, taken = F.col(f"{_P}size"), F.col(f"{_P}taken")
    full = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    part = F.when(size > 0, taken % size).otherwise(0)
    # Words taken of each repetition: `size` for whole ones, `part` for the last.
    copies = F.concat(F.array_repeat(size, full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col(f"{_P}words").cast("int")), "")
    kept = F.when(F.col(f"{_P}words") == size, F.col(text_col)).otherwise(head)
    return planned.withColumn(f"{_P}words", F.explode(copies)).withColumn(text_col, kept).select(*docs.columns)
