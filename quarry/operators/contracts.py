"""Operators on endpoints of a backend and calls of a frontend.

Endpoints: seq, route, method, path, line; calls: seq, url, method, path, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routes import PLACEHOLDER, call_segments, segments, starred_call, starred_route

#: Methods with a body, types that say nothing, and bounds of a near miss.
BODY_METHODS, ANY_TYPES, NEAREST, SHORTEST = ["POST", "PUT", "PATCH"], ["any", "unknown"], 2, 3


def _endpoints(endpoints: DataFrame) -> DataFrame:
    return endpoints.select(*[F.col(c).alias(f"endpoint_{c}") for c in ("seq", "route", "method", "path", "line")], segments(F.col("route")).alias("s")).withColumn("route_open", F.transform("s", lambda x: F.startswith(x, F.lit(":"))))


def _calls(calls: DataFrame) -> DataFrame:
    return calls.select(*[F.col(c).alias(f"call_{c}") for c in ("seq", "url", "method", "path", "line")], call_segments(F.col("url")).alias("s")).withColumn("call_open", F.transform("s", lambda x: x.rlike(PLACEHOLDER)))


#: What a route and a call that agree share: which of their segments are open, and those that neither leaves open.
_MET = ["route_open", "call_open", "fixed"]


def _keyed(rows: DataFrame, own: str, others: DataFrame, other: str) -> DataFrame:
    """rows once for each arrangement of open segments that occurs among others, with the segments that both fix.

    Arrangements are few, as they don't depend on what segments say; the join that follows is by those segments.
    """
    size = lambda c: F.size(c).alias("n")
    arranged = others.select(size(other), other).distinct()
    either = F.zip_with(own, other, lambda a, b: a | b)
    return rows.withColumn("n", F.size(own)).join(arranged, "n").withColumn("fixed", F.zip_with("s", either, lambda x, free: F.when(~free, x))).drop("n", "s")


def _both(endpoints: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    e, c = _endpoints(endpoints), _calls(calls)
    plain = lambda rows: rows.withColumn("fixed", F.transform("fixed", lambda x: F.coalesce(x, F.lit(""))))
    return plain(_keyed(e, "route_open", c, "call_open")), plain(_keyed(c, "call_open", e, "route_open"))


def route_matches(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """All pairs of an endpoint and a call whose routes agree, with whether their methods do.

    The join's key is what both fix, so only pairs that agree meet.
    """
    e, c = _both(endpoints, calls)
    return e.join(c, _MET).drop(*_MET).withColumn("same_method", F.col("endpoint_method") == F.col("call_method"))


def unconsumed(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    e, c = _both(endpoints, calls)
    return _endpoints(endpoints).drop("s", "route_open").join(e.join(c, _MET, "left_semi").select("endpoint_seq").distinct(), "endpoint_seq", "left_anti")


def missing(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    e, c = _both(endpoints, calls)
    return _calls(calls).drop("s", "call_open").join(c.join(e, _MET, "left_semi").select("call_seq").distinct(), "call_seq", "left_anti")


def _pieces(size: Column) -> list[tuple[Column, Column]]:
    """Begin, from 0, and length of the pieces of a text: one more than edits, so that one piece at least is left whole."""
    n = NEAREST + 1
    ends = [F.floor(size * i / n).cast("int") for i in range(n + 1)]
    return [(ends[i], ends[i + 1] - ends[i]) for i in range(n)]


def near_misses(endpoints: DataFrame, missing_calls: DataFrame) -> DataFrame:
    """The route nearest to each missing call, at most two edits away, the first endpoint of equal ones.

    Of three pieces of a route two edits leave one whole, moved by two places at most: the join's key is the route's
    length, a piece's number and the piece. Equal routes and equal calls are compared once. Input: rows of missing().
    """
    text = lambda c, at, size: F.substring(c, at + 1, size)
    ends = endpoints.select("seq", "route", "method", starred_route(F.col("route")).alias("r")).where(F.length("r") >= SHORTEST)
    routes = ends.groupBy("r").agg(F.min("seq").alias("endpoint_seq"), F.min_by(F.struct(F.col("route").alias("near_route"), F.col("method").alias("near_method")), "seq").alias("near"))
    whole = [F.struct(F.length("r").alias("size"), F.lit(i).alias("i"), text("r", at, size).alias("piece")) for i, (at, size) in enumerate(_pieces(F.length("r")))]
    indexed = routes.withColumn("k", F.explode(F.array(*whole)))

    wanted = missing_calls.withColumn("c", starred_call(F.col("call_url"))).where(F.length("c") >= SHORTEST)
    texts = wanted.select("c").distinct().withColumn("size", F.explode(F.sequence(F.greatest(F.length("c") - NEAREST, F.lit(SHORTEST)), F.length("c") + NEAREST)))
    moved = [F.when((at + by >= 0) & (at + by + size <= F.length("c")), F.struct("size", F.lit(i).alias("i"), text("c", at + by, size).alias("piece"))) for i, (at, size) in enumerate(_pieces(F.col("size"))) for by in range(-NEAREST, NEAREST + 1)]
    probes = texts.select("c", F.explode(F.array_distinct(F.array_compact(F.array(*moved)))).alias("k"))

    met = probes.join(indexed, "k").withColumn("distance", F.levenshtein("c", "r", NEAREST)).where(F.col("distance").between(1, NEAREST))
    best = met.groupBy("c").agg(F.min_by(F.struct("near.*", "distance"), F.struct("distance", "endpoint_seq")).alias("b"))
    return wanted.join(best, "c").select("call_seq", "call_url", "call_method", "b.near_route", "b.near_method", "b.distance")


def missing_fields(pairs: DataFrame) -> DataFrame:
    """One row per required field that a call doesn't send. Input: pairs with endpoint_method, required, sent (a map)."""
    body = pairs.where(F.col("endpoint_method").isin(BODY_METHODS) & F.col("required").isNotNull() & F.col("sent").isNotNull())
    return body.withColumn("field", F.explode(F.array_except("required", F.map_keys("sent"))))


def type_mismatches(pairs: DataFrame) -> DataFrame:
    """Pairs in which a shared field has two known types that differ. Input: endpoint_method, expected, sent (maps)."""
    known = lambda t: ~t.isin(ANY_TYPES)
    differing = F.map_filter("expected", lambda k, v: F.map_contains_key(F.col("sent"), k) & known(v) & known(F.col("sent")[k]) & (v != F.col("sent")[k]))
    fields = F.array_sort(F.map_keys(differing))
    return pairs.where(F.col("endpoint_method").isin(BODY_METHODS)).withColumn("fields", fields).where(F.size("fields") > 0)
