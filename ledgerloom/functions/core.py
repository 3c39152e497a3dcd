"""Small Column helpers shared by every job."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as it is, worked out once per row. Spark moves a filter on a column below the
    step that makes the column and so makes it twice; it does not where the column holds
    something it may not repeat."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def constant(value, ddl: str) -> Column:
    """A small fixed table as one literal; the optimizer folds the parse away."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def any_of(text: Column, phrases: Iterable[str], before: str = "", after: str = "") -> Column:
    """Whether any of the phrases occurs, between the given regex contexts."""
    return text.rlike(before + "(?:" + "|".join(re.escape(p) for p in phrases) + ")" + after)


def money_sum(amount: ColumnLike, when: Column | None = None) -> Column:
    """Sum of 2-decimal amounts, exact and independent of row order: cents are
    added as integers, so a partial aggregate per task and any merge order give
    the same digits. Missing amounts count as zero, an empty group as 0.0."""
    cents = F.round(c(amount) * 100).cast("bigint")
    if when is not None:
        cents = F.when(when, cents)
    return F.coalesce(F.sum(cents), F.lit(0)) / F.lit(100.0)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def month_key(day: ColumnLike) -> Column:
    return F.date_format(c(day), "yyyy-MM")


def money_label(amount: ColumnLike) -> Column:
    """``PKR 1,234``"""
    return F.concat(F.lit("PKR "), F.format_number(c(amount), 0))


def present(text: ColumnLike) -> Column:
    """Text with something in it; an empty string counts as missing."""
    return F.when(c(text) != "", c(text))


#: What counts as white space at the ends of a printed value.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2002\u2003\u2009\u202f\u3000"


def strip_chars(text: ColumnLike, chars: str) -> Column:
    """Strip any of the given characters from both ends."""
    return F.btrim(c(text), F.lit(chars))


def strip(text: ColumnLike) -> Column:
    return strip_chars(text, WHITESPACE)


def collapse_spaces(text: ColumnLike) -> Column:
    return strip(F.regexp_replace(c(text), r"\s+", " "))


def first_match(text: ColumnLike, rules: Sequence[tuple[str, object]], flags: str = "(?i)") -> Column:
    """Value of the first pattern found in ``text``; null when none is."""
    return F.coalesce(*[F.when(c(text).rlike(flags + pattern), F.lit(value)) for pattern, value in rules])


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
