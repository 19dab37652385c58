"""Filters that narrow a search before it ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import tokenize

#: Longer lists are joined instead of written into the plan.
LISTED = 10


def in_list(rows: DataFrame, column: str, values: list | DataFrame | None) -> DataFrame:
    """Rows whose column is one of the values. None or an empty list means no filter; a table is one, also an empty one.

    A short list becomes a predicate that reaches the files' statistics, a longer one or a table (its
    first column) a semi-join.
    """
    if isinstance(values, DataFrame):
        wanted = values
    elif not values:
        return rows
    elif len(values) <= LISTED:
        return rows.where(F.col(column).isin(list(values)))
    else:
        wanted = rows.sparkSession.createDataFrame([(v,) for v in values], f"v {rows.schema[column].dataType.simpleString()}")
    return rows.join(wanted.select(F.col(wanted.columns[0]).alias(column)).distinct(), column, "left_semi")


def within(column: Column, low: float | int | None = None, high: float | int | None = None) -> Column:
    """Whether the value lies between the bounds, ends included; a bound that is None is open."""
    ok = column.isNotNull()
    ok = ok if low is None else ok & (column >= low)
    return ok if high is None else ok & (column <= high)


def has_any(lists: Column, values: list[str]) -> Column:
    """Whether an array holds any of the values; without values every row does."""
    return F.coalesce(F.arrays_overlap(lists, F.array(*map(F.lit, values))), F.lit(False)) if values else F.lit(True)


def has_words(text: Column, words: str) -> Column:
    """Whether all words of ``words`` are among the words of the text, in any case and order."""
    return F.forall(tokenize(F.lit(words)), lambda w: F.array_contains(tokenize(text), w))


def by_meta(rows: DataFrame, objects: list[str] | None = None, author: str | None = None, published: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Rows by what is known of their video: objects in the picture (any of them), author, and dates dd/mm/yyyy from and to; what is None doesn't filter."""
    if objects:
        rows = rows.where(has_any(F.col("objects"), objects))
    if author is not None:
        rows = rows.where(F.lower(F.trim("author")) == author.strip().lower())
    for bound, keep in zip(published, (lambda day, at: day >= at, lambda day, at: day <= at)):
        if bound is not None:
            rows = rows.where(keep(F.try_to_date("publish_date", "dd/MM/yyyy"), F.to_date(F.lit(bound), "dd/MM/yyyy")))
    return rows
