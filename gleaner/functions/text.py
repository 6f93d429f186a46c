"""Column helpers for text, each with one meaning everywhere in the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (trim() knows spaces only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank(c: Column | str) -> Column:
    """Whether nothing but white space is there; stops at the first other character."""
    return ~col(c).rlike(r"(?U)\S")


def words(c: Column | str) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def window_tokens(c: Column | str) -> Column:
    """Words and single line breaks, in order."""
    return F.regexp_extract_all(col(c), F.lit(r"(?U)(\S+|\n)"), F.lit(1))


def camel_tokens(c: Column | str) -> Column:
    """Lower-case words, cut also between an acronym and a word and between lower and upper case."""
    cut = F.regexp_replace(col(c), r"[A-Z](?:(?<=[a-z0-9].)|(?<=[A-Z].)(?=[a-z]))", " $0")  # begins with a capital, so most places are passed at once
    return words(F.lower(cut))


def lower_words(c: Column | str) -> Column:
    return words(F.lower(col(c)))


def listed(values: Column, order: Column) -> Column:
    """Aggregate: values in an order, as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda s: s.v)
