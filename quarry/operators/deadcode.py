"""Dead code: imports, variables, parameters and functions that nothing refers to, files that nothing imports.

Occurrences (path, token, offset, line, kind, is_dynamic, is_test) are joined with names by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings import confidence, suggested_action
from . import graph


def _judged(names: DataFrame, met: DataFrame, keys: list[str], use: Column, test: Column) -> DataFrame:
    """names with the confidence that they are unused, by the occurrences ``use`` that met them; used ones go."""
    code = use & (F.col("kind") == "code") & ~F.col("is_dynamic")
    counts = met.groupBy(*keys).agg(
        F.count_if(code & ~test).alias("real"), F.count_if(code & test).alias("test"), F.count_if(use & (F.col("kind") == "comment")).alias("comment"),
        F.count_if(use & ((F.col("kind") == "string") | ((F.col("kind") == "code") & F.col("is_dynamic")))).alias("dynamic"),
    )
    rows = names.join(counts, keys, "left")
    n = [F.coalesce(c, F.lit(0)) for c in ("real", "test", "comment", "dynamic")]
    return rows.withColumn("confidence", confidence(*n)).where("confidence IS NOT NULL").drop("real", "test", "comment", "dynamic")


def _finding(rows: DataFrame, kind: str, text: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("type"), "confidence", "path", "line", text.alias("description"), suggested_action(F.col("confidence")).alias("suggested_action"))


def unused_imports(imports: DataFrame, occurrences: DataFrame) -> DataFrame:
    names = imports.select("path", "seq", "source", "line", F.explode("specifiers").alias("name")).where("name <> ''")
    o = occurrences.select("path", F.col("token").alias("name"), F.col("line").alias("at"), "kind", "is_dynamic")
    met = names.join(o, ["path", "name"]).where("at <> line")
    rows = _judged(names, met, ["path", "seq", "name"], F.lit(True), F.lit(False))
    return _finding(rows, "unused-import", F.format_string('El import "%s" de "%s" no se utiliza en este archivo.', "name", "source"))


def unused_variables(variables: DataFrame, occurrences: DataFrame) -> DataFrame:
    o = occurrences.select("path", F.col("token").alias("name"), F.col("line").alias("at"), "kind", "is_dynamic")
    met = variables.join(o, ["path", "name"]).where("at <> line")
    rows = _judged(variables, met, ["path", "seq", "name"], F.lit(True), F.lit(False))
    return _finding(rows, "unused-variable", F.format_string('La variable "%s" no se utiliza en este archivo.', "name"))


def unused_parameters(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The first occurrence within a function is the declaration; a parameter without any is left out."""
    names = symbols.select("path", "id", F.col("name").alias("owner"), "line", "end_line", F.posexplode("parameters").alias("k", "p")).withColumn("name", F.col("p.name")).drop("p").where(F.col("name").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"))
    o = occurrences.select("path", F.col("token").alias("name"), F.col("line").alias("at"), "offset", "kind", "is_dynamic")
    met = names.join(o, ["path", "name"]).where("at BETWEEN line AND end_line")
    first = Window.partitionBy("id", "k").orderBy("offset")
    ranked = met.withColumn("rank", F.row_number().over(first))
    found = names.join(ranked.select("id", "k").distinct(), ["id", "k"], "left_semi")
    rows = _judged(found, ranked, ["id", "k"], F.col("rank") > 1, F.lit(False))
    return _finding(rows, "unused-parameter", F.format_string('El parámetro "%s" de "%s" no se utiliza en el cuerpo de la función.', "name", "owner"))


def unused_functions(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences reduce to counts per name before the join; those on a declaration's own line are taken off."""
    names = symbols.where("type = 'function'").select("id", "path", "line", "name")
    code = (F.col("kind") == "code") & ~F.col("is_dynamic")
    sums = {"real": code & ~F.col("is_test"), "test": code & F.col("is_test"), "comment": F.col("kind") == "comment", "dynamic": (F.col("kind") == "string") | ((F.col("kind") == "code") & F.col("is_dynamic"))}
    every = occurrences.groupBy(F.col("token").alias("name")).agg(*[F.count_if(c).alias(k) for k, c in sums.items()])
    own = occurrences.groupBy(F.col("token").alias("name"), "path", "line").agg(*[F.count_if(c).alias(f"own_{k}") for k, c in sums.items()])
    rows = names.join(every, "name", "left").join(own, ["name", "path", "line"], "left")
    n = [F.coalesce(k, F.lit(0)) - F.coalesce(f"own_{k}", F.lit(0)) for k in sums]
    judged = rows.withColumn("confidence", confidence(*n)).where("confidence IS NOT NULL")
    return _finding(judged, "unused-function", F.format_string('La función "%s" no se invoca en ningún lugar del repositorio.', "name"))


def orphan_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    rows = graph.orphans(files.select("path"), edges).withColumn("confidence", F.lit("alto")).withColumn("line", F.lit(1))
    text = F.format_string('El archivo "%s" no es importado ni referenciado por ningún otro archivo del repositorio.', "path")
    return _finding(rows, "orphan-file", text).withColumn("suggested_action", F.lit("revisar-manualmente"))


def report(files: DataFrame, parsed: DataFrame, symbols: DataFrame, imports: DataFrame, variables: DataFrame, occurrences: DataFrame, edges: DataFrame) -> DataFrame:
    """All findings. Files that can't be parsed give none and count as no use; they are still files that may be orphans."""
    good = parsed.where("error IS NULL").select("path")
    o = occurrences.join(good, "path", "left_semi")
    parts = [unused_imports(imports, o), unused_variables(variables, o), unused_parameters(symbols, o), unused_functions(symbols, o), orphan_files(files, edges)]
    return reduce(DataFrame.unionByName, parts)
