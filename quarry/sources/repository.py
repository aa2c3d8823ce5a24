"""A repository's files as tables: scan, manifests, environment names, and seeds on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as px
from ..functions.text import lines
from . import tree

MANIFEST = "name string, description string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>"
SEED = "id string, type string, source_module string, location struct<path: string, line: int, column: int>, description string, suggested_action string, state string, created_at timestamp, updated_at timestamp"


def wanted(path: Column, gitignore: str = "", exclusions: list[str] | None = None) -> Column:
    """Whether a relative path is indexed: its ending, no dependency folder, not ignored, not sensitive."""
    rules = px.parse_gitignore(gitignore)
    return px.indexable(path) & ~px.in_dependencies(path) & ~px.ignored(path, rules) & ~px.under_ignored_folder(path, rules) & ~px.sensitive(path, exclusions)


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small text file's content, hidden or not, from any store that Spark reaches; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scan(spark: SparkSession, root: str, gitignore: str | None = None, exclusions: list[str] | None = None) -> DataFrame:
    """path (relative), content, modification_time, error of the files that are indexed, in no order.

    Paths are filtered before files are opened; a file that can't be read has an error and no content. The root's .gitignore
    is read unless one is given.
    """
    base = root.rstrip("/")
    if gitignore is None:
        gitignore = read_small(spark, f"{base}/.gitignore") or ""
    return tree.scan(spark, base, lambda path: wanted(path, gitignore, exclusions))


def manifest(text: DataFrame, column: str = "content") -> DataFrame:
    """The fields of a package.json; nulls where it is no JSON object."""
    return text.select(F.from_json(column, MANIFEST).alias("m")).select("m.*")


def env_names(files: DataFrame) -> DataFrame:
    """name: environment variables that sources read, distinct and sorted."""
    found = F.explode(F.regexp_extract_all("content", F.lit(r"(?:process\.env|import\.meta\.env)\.([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name")
    return files.select(found).distinct().orderBy("name")


def env_file_names(files: DataFrame) -> DataFrame:
    """name, at: names that .env.example assigns, or else .env.sample, in the order of the file, repeats kept."""
    order = F.when(F.col("path") == ".env.example", 0).when(F.col("path") == ".env.sample", 1)
    name = F.regexp_extract("line", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    rows = files.withColumn("order", order).where("order IS NOT NULL").select("order", F.posexplode(lines(F.col("content"))).alias("at", "line")).withColumn("name", name).where("name <> ''")
    return rows.where(F.col("order") == rows.agg(F.min("order")).scalar()).select("name", "at").orderBy("at")


def write_seeds(seeds: DataFrame, path: str, consent: bool = False) -> bool:
    """Write all seeds as JSON, if there is consent; tells whether it did."""
    if consent:
        seeds.write.mode("overwrite").json(path)
    return consent


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """The seeds written at a path; none if there is nothing or nothing legible."""
    try:
        rows = spark.read.schema(SEED).option("mode", "PERMISSIVE").json(path)
        rows.isEmpty()
    except Exception as error:  # a missing folder is an empty store
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SEED)
    return rows.where("id IS NOT NULL")


def apply_edit(lines_of: list[str], line: int, action: str, confirm: Callable[[str], bool]) -> list[str] | None:
    """The lines after a confirmed fix: a line deleted or commented out; None if rejected or the line isn't there."""
    if not 1 <= line <= len(lines_of) or action not in ("eliminar", "comentar") or not confirm(lines_of[line - 1]):
        return None
    text = lines_of[line - 1]
    body = text.lstrip()
    return [*lines_of[: line - 1], *([text[: len(text) - len(body)] + "// " + body] if action == "comentar" else []), *lines_of[line:]]
