"""Expressions on routes of a backend and addresses that a frontend calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leading host taken from the environment, and a segment that is a placeholder.
ENV_PREFIX, PLACEHOLDER = r"^\$\{[^}]*\}", r"^\$\{.*\}$"


def segments(path: Column) -> Column:
    return F.filter(F.split(F.substring_index(path, "?", 1), "/", -1), lambda x: x != "")


def call_segments(url: Column) -> Column:
    return segments(F.regexp_replace(url, ENV_PREFIX, ""))


def matches(route: Column, call: Column) -> Column:
    """Whether segments of a route and of a call agree; parameters and placeholders agree with anything."""
    same = F.zip_with(route, call, lambda r, c: F.startswith(r, F.lit(":")) | c.rlike(PLACEHOLDER) | (r == c))
    return (F.size(route) == F.size(call)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def starred_route(route: Column) -> Column:
    return F.array_join(F.transform(segments(route), lambda x: F.when(F.startswith(x, F.lit(":")), F.lit("*")).otherwise(x)), "/")


def starred_call(url: Column) -> Column:
    return F.array_join(F.transform(call_segments(url), lambda x: F.when(x.rlike(PLACEHOLDER), F.lit("*")).otherwise(x)), "/")


def parameters(route: Column) -> Column:
    """Names of a route's parameters, all of type string and required."""
    return F.transform(F.regexp_extract_all(route, F.lit(":([A-Za-z0-9_]+)"), 1), lambda x: F.struct(x.alias("name"), F.lit("string").alias("type"), F.lit(True).alias("required")))
