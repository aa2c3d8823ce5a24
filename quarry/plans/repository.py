"""A repository as a set of tables, and the reports over them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, snippet
from ..operators import contracts, deadcode, duplicates, graph, search
from ..operators import lines as line_ops
from ..operators import review as review_ops
from ..parse import tables


@dataclass
class Repository:
    """Tables of one repository; ``files`` has path and content. The parse stage runs once until close().

    Files with an error, where there is such a column, are told of in ``parsed`` and are no ``files``.
    """

    files: DataFrame
    parsed: DataFrame

    @classmethod
    def of(cls, files: DataFrame) -> Repository:
        read = files.where("error IS NULL").drop("error") if "error" in files.columns else files
        return cls(read, tables.units(files).persist())

    def close(self) -> None:
        self.parsed.unpersist()

    @property
    def symbols(self) -> DataFrame:
        return tables.symbols(self.parsed)

    def part(self, name: str) -> DataFrame:
        return tables.unfold(self.parsed, name)

    @property
    def edges(self) -> DataFrame:
        return graph.resolve_imports(self.part("imports"), self.files)

    @property
    def occurrences(self) -> DataFrame:
        return tables.occurrences(self.files)


def dead_code(repo: Repository) -> DataFrame:
    return deadcode.report(repo.files, repo.parsed, repo.symbols, repo.part("imports"), repo.part("variables"), repo.occurrences, repo.edges)


def code_warnings(repo: Repository) -> DataFrame:
    """Runs of comment lines, and duplicate blocks: type, path, start_line, end_line, other_path, other_start_line."""
    good = repo.files.join(repo.parsed.where("error IS NULL").select("path"), "path", "left_semi")
    flagged = line_ops.commented(good)
    runs = line_ops.runs(flagged).select(F.lit("commented-code").alias("type"), "path", "start_line", "end_line")
    pairs = duplicates.duplicate_blocks(line_ops.windows(flagged))
    names = {"a_path": "path", "a_start_line": "start_line", "a_end_line": "end_line", "b_path": "other_path", "b_start_line": "other_start_line"}
    blocks = pairs.select(F.lit("duplicate-code").alias("type"), *[F.col(c).alias(n) for c, n in names.items()])
    return runs.unionByName(blocks, allowMissingColumns=True)


def unanalyzable(repo: Repository) -> DataFrame:
    return repo.parsed.where("error IS NOT NULL").select("path", F.col("error").alias("reason"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of files in one order: by path and place."""
    return rows.withColumn("seq", F.struct("path", "seq"))


def contract(repo: Repository) -> dict[str, DataFrame]:
    """Endpoints that nothing calls, calls without an endpoint, discrepancies and type conflicts between the two."""
    ends, calls = _ordered(repo.part("endpoints")), _ordered(repo.part("calls"))
    gone = contracts.missing(ends, calls)
    pairs = contracts.route_matches(ends, calls)
    as_map = lambda c: F.map_from_entries(F.array_distinct(F.transform(c, lambda p: F.struct(p["name"], p["type"]))))
    schemas = (
        pairs.where("same_method").join(ends.select(F.col("seq").alias("endpoint_seq"), "body"), "endpoint_seq").join(calls.select(F.col("seq").alias("call_seq"), F.col("sent").alias("data")), "call_seq")
        .where("body IS NOT NULL AND data IS NOT NULL").withColumn("required", F.col("body.required")).withColumn("expected", as_map(F.col("body.properties"))).withColumn("sent", as_map(F.col("data.properties")))
    )
    mismatch = pairs.where("NOT same_method").select(F.lit("method-mismatch").alias("category"), F.col("call_path").alias("path"), F.col("call_line").alias("line"), F.format_string("%s %s", "endpoint_method", "endpoint_route").alias("detail"))
    missing_field = contracts.missing_fields(schemas).select(F.lit("missing-field").alias("category"), F.col("call_path").alias("path"), F.col("call_line").alias("line"), F.col("field").alias("detail"))
    near = contracts.near_misses(ends, gone).join(gone.select("call_seq", "call_path", "call_line"), "call_seq").select(F.lit("route-mismatch").alias("category"), F.col("call_path").alias("path"), F.col("call_line").alias("line"), F.format_string("%s %s", "near_method", "near_route").alias("detail"))
    return {
        "unconsumed": contracts.unconsumed(ends, calls).select(F.col("endpoint_route").alias("route"), F.col("endpoint_method").alias("method"), F.col("endpoint_path").alias("path"), F.col("endpoint_line").alias("line")),
        "missing": gone.select(F.col("call_url").alias("url"), F.col("call_method").alias("method"), F.col("call_path").alias("path"), F.col("call_line").alias("line")),
        "discrepancies": mismatch.unionByName(missing_field).unionByName(near),
        "type_conflicts": contracts.type_mismatches(schemas).select(F.format_string("%s %s", "endpoint_method", "endpoint_route").alias("endpoint"), "fields", F.col("call_path").alias("path"), F.col("call_line").alias("line")),
    }


def importers(repo: Repository) -> DataFrame:
    """symbol_id, path, line: files that import each symbol."""
    met = repo.part("imports").join(repo.edges.select("path", "seq", "target"), ["path", "seq"])
    return graph.importers(met, repo.symbols, repo.part("exports")).select("symbol_id", "path", "line")


def callees(repo: Repository) -> DataFrame:
    """symbol_id, callee_id: first-level calls of each symbol that resolve."""
    s = repo.symbols
    called = s.select(F.col("id").alias("symbol_id"), "path", F.explode("calls").alias("called"))
    return graph.callees(called, s.withColumn("seq", F.struct("path", "seq"))).select("symbol_id", "callee_id")


def usages(repo: Repository) -> DataFrame:
    """symbol_id, path, line, context: lines that hold a symbol's name, but for its own and those that import it."""
    s = repo.symbols.select(F.col("id").alias("symbol_id"), "name", F.col("path").alias("own_path"), F.col("line").alias("own_line")).where(F.col("name").rlike(r"^[A-Za-z0-9_]+$"))
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), 1)))
    rows = repo.files.select("path", F.posexplode(lines(F.col("content"))).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text", words.alias("name"))
    met = s.join(rows, "name").where("NOT (path = own_path AND line = own_line)")
    return met.join(importers(repo), ["symbol_id", "path", "line"], "left_anti").select("symbol_id", "path", "line", F.trim("text").alias("context"))


def _results(repo: Repository, hits: DataFrame) -> DataFrame:
    rel = graph.related(repo.edges).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("related", "relation"))).alias("related"))
    rows = hits.join(repo.files.select("path", "content"), "path")
    return rows.withColumn("snippet", snippet(F.col("content"), F.col("line"))).drop("content").join(rel, "path", "left")


def search_results(repo: Repository, query: str, model: search.Model | None = None) -> DataFrame:
    """path, name, type, line, snippet, explanation, related: what a model picks among the best names, or else all names
    that contain the query."""
    best = [r.asDict() for r in search.ranked(repo.symbols.withColumn("seq", F.struct("path", "seq")), query).select("id", "path", "name", "type", "line").collect()] if model else []
    if best:
        ids = repo.files.sparkSession.createDataFrame([(i, r["id"], r["path"], r["name"], r["type"], r["line"]) for i, r in enumerate(best)], "at int, id string, path string, name string, type string, line int")
        found = search.semantic(_results(repo, ids), query, model)
        if found is not None:
            met = found.join(ids.drop("at"), ["name", "path"])
            return _results(repo, met).select("path", "name", "type", "line", "snippet", "explanation", "related", F.col("at").alias("seq")).orderBy("seq")
    hits = search.exact(repo.symbols, query).select("path", "name", "type", "line", "seq")
    return _results(repo, hits).select("path", "name", "type", "line", "snippet", F.lit("").alias("explanation"), "related", "seq").orderBy("path", "seq")


def index_result(repo: Repository) -> DataFrame:
    """One row: files in all, files processed, and files that could not be read or parsed."""
    bad = F.col("error").isNotNull()
    return repo.parsed.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(~bad).alias("files_processed"), F.count_if(bad).alias("errors"))


def build_index(files: DataFrame) -> tuple[Repository, DataFrame]:
    """A repository whose parse stage has run, and one row: counts as index_result() and milliseconds taken. Which files had
    errors is told by unanalyzable()."""
    began = time.monotonic()
    repo = Repository.of(files)
    counts = index_result(repo).first().asDict()
    took = int((time.monotonic() - began) * 1000)
    return repo, files.sparkSession.createDataFrame([(*counts.values(), took)], "total_files long, files_processed long, errors long, duration_ms long")


def broken_imports(repo: Repository, staged: DataFrame, listing: DataFrame) -> DataFrame:
    """path, line, source of relative imports in staged files that no listed file answers."""
    modules = repo.part("modules").join(staged, "path", "left_semi")
    found = graph.resolve_imports(modules, listing).select("path", "seq")
    return modules.join(found, ["path", "seq"], "left_anti").select("path", "line", "source")


def review(repo: Repository, staged: DataFrame, untracked: DataFrame, listing: DataFrame, project: DataFrame | None = None) -> DataFrame:
    """Findings of a review before a commit: check, severity, path, line, description.

    ``project`` is what skipped() and tool_findings() take; without it the linter, tests and compiler have no say.
    """
    held = review_ops.secrets(repo.files.join(staged, "path", "left_semi")).select(F.lit("secrets").alias("check"), F.lit("error").alias("severity"), "path", "line", F.lit("Posible secreto detectado.").alias("description"))
    broken = broken_imports(repo, staged, listing).select(F.lit("broken-imports").alias("check"), F.lit("error").alias("severity"), "path", "line", F.format_string('El import "%s" no se puede resolver.', "source").alias("description"))
    forgotten = untracked.select(F.lit("forgotten-files").alias("check"), F.lit("recomendación").alias("severity"), "path", F.lit(1).alias("line"), F.lit("El archivo no está incluido en el commit.").alias("description"))
    unused = dead_code(repo).join(staged, "path", "left_semi").select(F.lit("unused-code").alias("check"), F.when(F.col("confidence") == "alto", "advertencia").otherwise("recomendación").alias("severity"), "path", "line", "description")
    found = broken.unionByName(forgotten).unionByName(unused).unionByName(held)
    return found if project is None else found.unionByName(review_ops.tool_findings(project))
