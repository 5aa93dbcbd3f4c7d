"""Typed access to the JSON ``usage_metadata`` document.

One ``from_json`` per row parses the document into a struct of strings
(``META_SCHEMA``); Catalyst prunes that schema to the fields a query actually
touches.  Numbers are typed with ``try_cast`` so malformed values become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import META_SCHEMA

META_COL = "_meta"


def parsed() -> Column:
    """The parsed metadata struct; a NULL document gives a NULL struct."""
    return F.from_json(F.col("usage_metadata"), META_SCHEMA)


def with_meta(df):
    """Add the parsed metadata struct as column ``_meta``."""
    return df.withColumn(META_COL, parsed())


def field(name: str) -> Column:
    return F.col(f"{META_COL}.{name}")


def int_field(name: str) -> Column:
    return field(name).try_cast("int")


def long_field(name: str) -> Column:
    return field(name).try_cast("bigint")


def double_field(name: str) -> Column:
    return field(name).try_cast("double")


def field_of(name: str) -> Column:
    """One metadata field straight from the document (no struct column kept)."""
    return parsed().getField(name)
