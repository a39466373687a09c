"""Identifier and path conventions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_id(column: Column | str) -> Column:
    """An id in the id convention: runs of other characters become one `_`, none at the ends, lower case."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.trim(F.regexp_replace(column, "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def make_id(*parts: Column | str) -> Column:
    """The id made of several parts: empty parts are left out."""
    columns = [F.nullif(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return normal_id(F.concat_ws("_", *columns))


def normal_path(column: Column | str) -> Column:
    """A path with `/` as its only separator."""
    return F.replace(F.col(column) if isinstance(column, str) else column, F.lit("\\"), F.lit("/"))


def base_name(path: Column | str) -> Column:
    """The last part of a path."""
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def micros(column: Column | str) -> Column:
    """A timestamp, with or without zone, as microseconds."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))
