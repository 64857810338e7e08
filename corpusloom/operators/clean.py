"""Cleaning (C1-C7, C10-C16): column expressions and `DataFrame -> DataFrame` filters with parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tables import COUNTRY_REGION


def strip(column: Column) -> Column:
    """As a string without white space at either end, tabs and line feeds included."""
    return F.regexp_replace(F.regexp_replace(column.cast("string"), r"^[\x09-\x0D\x20]+", ""), r"[\x09-\x0D\x20]+$", "")


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns under new names; names that the table does not have are passed over."""
    return df.withColumnsRenamed(dict(names))


def described(df: DataFrame, name: str = "name", text: str = "description") -> DataFrame:
    """Rows with a description, both columns stripped: not null, not empty, not ".", not just the name."""
    out = df.withColumns({name: strip(F.col(name)), text: strip(F.col(text))})
    same = F.lower(F.col(text)) == F.lower(F.coalesce(F.col(name), F.lit("")))
    return out.filter(F.col(text).isNotNull() & ~F.col(text).isin("", ".") & ~same)


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_before, n_after, n_removed) in one row."""
    counts = before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))  # one row each
    return counts.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """C4."""
    return df.filter(F.length(strip(F.col(column))) > 0)


def without_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is none of the values; nulls stay."""
    return df.filter(F.coalesce(~F.col(column).isin(*values), F.lit(True)))


def having(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def lacking(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the columns."""
    return df.dropna(subset=list(columns))


def total_changes(rewritten: DataFrame) -> DataFrame:
    """The changes of all rewritten texts."""
    return rewritten.agg(F.coalesce(F.sum("n_changes"), F.lit(0)).cast("long").alias("total"))


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Df with the value of its key's row in the table, the default where there is none. The table's keys are
    unique; whether it is small enough to broadcast is left to its statistics."""
    out = df.join(table.select(key, value), key, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def region_of(country: Column, regions: Mapping[str, str] = COUNTRY_REGION, default: str = "Other") -> Column:
    """C11: the region of a country, by a literal map of fixed size."""
    table = F.create_map(*[F.lit(x) for pair in regions.items() for x in pair])
    return F.coalesce(F.try_element_at(table, country), F.lit(default))


def region_or_other(df: DataFrame, column: str = "region", default: str = "Other") -> Column:
    """The stripped region, the default for an empty or null one or if the table has no such column."""
    if column not in df.columns:
        return F.lit(default)
    return F.coalesce(F.nullif(strip(F.col(column)), F.lit("")), F.lit(default))


def rank_value(rank: Column) -> Column:
    """The number that a printed rank begins with ("=12", "101-150", "101–150", "500+"); null if there is none."""
    plain = F.replace(F.replace(strip(rank), F.lit("="), F.lit("")), F.lit("–"), F.lit("-"))
    first = F.split_part(F.split_part(plain, F.lit("-"), F.lit(1)), F.lit("+"), F.lit(1))
    return F.trim(first).try_cast("double")


def aligned(keys: DataFrame, metadata: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """C14: one row a key, with the metadata columns of `defaults`; keys without metadata get the defaults."""
    out = keys.join(metadata.select(key, *defaults), key, "left")
    for column, value in defaults.items():
        if value is not None:
            out = out.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    return out


def normal_name(name: Column) -> Column:
    """Lower case without "the ", hyphens, "university of" and "university"; null gives the empty string."""
    out = strip(F.lower(F.coalesce(name.cast("string"), F.lit(""))))
    for part, by in (("the ", ""), ("-", " "), ("university of", ""), ("university", "")):
        out = F.replace(out, F.lit(part), F.lit(by))
    return strip(out)


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """C16."""
    return df.select(F.col(column).alias("name")).distinct()
