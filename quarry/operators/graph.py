"""Operators on imports: resolution, edges, related and orphan files, importers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder, is_test, resolved

#: Endings that are tried for an import, in order.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def names_of(path: Column) -> Column:
    """``x``, a row for each name by which a file may be imported: stem, path, and the rank of the ending it leaves out."""
    left_out = [F.when(F.endswith(path, F.lit(e)), F.struct(F.left(path, F.length(path) - len(e)).alias("stem"), path.alias("path"), F.lit(rank).alias("rank"))) for rank, e in enumerate(ENDINGS)]
    return F.explode(F.array_compact(F.array(*left_out))).alias("x")


def first_match(imports: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Of each import (..., stem), the known path (path) that is its stem with the first ending there is, as target.

    Files give up their endings, so imports go through the shuffle once and not once for every ending.
    """
    names = known.select(names_of(F.col("path"))).select("x.*")
    return imports.join(names.withColumnRenamed("path", "known"), "stem").groupBy(*by).agg(F.min_by("known", "rank").alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, seq, source, target of relative imports whose target is a file. Input: path, seq, source; path."""
    stem = resolved(F.concat_ws("/", folder(F.col("path")), "source"))
    return first_match(imports.where(F.startswith("source", F.lit("."))).withColumn("stem", stem), files, ["path", "seq", "source"])


def import_graph(files: DataFrame, edges: DataFrame) -> DataFrame:
    """path, targets: each file with its targets in order of seq, repeats kept; no targets, an empty list."""
    lists = edges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "target"))).alias("x")).select("path", F.transform("x", lambda e: e["target"]).alias("targets"))
    return files.select("path").join(lists, "path", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def related(edges: DataFrame) -> DataFrame:
    """path, related, relation: what a file imports, repeats kept, and which other files import it."""
    out = edges.select("path", F.col("target").alias("related"), F.lit("imports").alias("relation"))
    back = edges.where("path <> target").select(F.col("target").alias("path"), F.col("path").alias("related"), F.lit("imported-by").alias("relation")).distinct()
    return out.unionByName(back)


def orphans(files: DataFrame, edges: DataFrame, tests: Column | None = None) -> DataFrame:
    """Files that nothing imports, test files aside."""
    test = is_test(F.col("path")) if tests is None else tests
    return files.where(~test).join(edges.select(F.col("target").alias("path")), "path", "left_anti")


def importers(imports: DataFrame, symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """symbol_id, path, line of files that import a symbol: by its name, or by default where it is the default export.

    Input: imports with target, specifiers, is_default; symbols with id, name, path; exports with path, name, is_default.
    """
    defaults = exports.where("is_default").select(F.col("path").alias("symbol_path"), F.col("name").alias("symbol_name"), F.lit(True).alias("is_default_export")).distinct()
    own = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), F.col("path").alias("symbol_path")).join(defaults, ["symbol_path", "symbol_name"], "left")
    met = imports.join(own, F.col("target") == F.col("symbol_path")).where("path <> symbol_path")
    named = F.array_contains("specifiers", F.col("symbol_name")) & ~F.col("is_default")
    return met.where(named | (F.col("is_default") & F.coalesce("is_default_export", F.lit(False)))).select("symbol_id", "path", "line", "seq")


def callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, callee_id: each called name's symbol, one of the same file first, else the first by seq. Input: symbol_id,
    path, called; id, name, path, seq.

    Symbols reduce to the first of each name in each file and the first of each name at all, so a call meets two of them
    however many share the name.
    """
    first = F.min_by("id", "seq")
    near = symbols.groupBy(F.col("name").alias("called"), "path").agg(first.alias("near"))
    far = symbols.groupBy(F.col("name").alias("called")).agg(first.alias("far"))
    named = calls.select("symbol_id", "path", "called").distinct().join(far, "called").join(near, ["called", "path"], "left")
    return named.select("symbol_id", "called", F.coalesce("near", "far").alias("callee_id"))


def export_graph(files: DataFrame, exports: DataFrame) -> DataFrame:
    """path, names: each file with the names it exports, in order; none, an empty list."""
    lists = exports.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("x")).select("path", F.transform("x", lambda e: e["name"]).alias("names"))
    return files.select("path").join(lists, "path", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def dependents(found: DataFrame) -> DataFrame:
    """symbol_id, path: the distinct files that import a symbol. Input: rows of importers()."""
    return found.select("symbol_id", "path").distinct()


def symbol_at(symbols: DataFrame, name: str, path: str | None = None, line: int | None = None) -> DataFrame:
    """The first symbol of a name, in a file and at a line where these are given: a row or none. Order: path and seq."""
    rows = symbols.where(F.col("name") == name)
    for column, value in (("path", path), ("line", line)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy("path", "seq").limit(1)


class SymbolNotFound(LookupError):
    """No symbol has the id; it may have been renamed, moved, or not indexed."""


def symbol_by_id(symbols: DataFrame, wanted: str) -> DataFrame:
    rows = symbols.where(F.col("id") == wanted)
    if rows.isEmpty():
        raise SymbolNotFound(f"no symbol {wanted!r}: it may have been renamed or moved, or its file isn't indexed")
    return rows
