"""Registered queries of the library; their SQL twins stand in sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import events as ex
from ..functions import findings as fx
from ..functions import paths as px
from ..functions import routes as rx
from ..functions import text as tx
from ..operators import areas, contracts, deadline, diffs, duplicates, graph, lines, manifest, order, references, search, seeds, shapes
from ..parse import brackets
from ..parse import functions as table_functions
from ..sources import repository, tree
from ..sources.tables import Workspace, delete, shared_folder
from ..streaming import heartbeat, views
from . import inputs
from .sql import SQL

GITIGNORE = "# built files\ndist/\n*.generated.ts\n/src/src1/en\n!keep.ts\nsrc/*/de/9?.js\n"


def unused_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.unused_names(inputs.declared(spark, sf_dir), inputs.files(spark, sf_dir))


def word_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.usage_links_of(inputs.declared(spark, sf_dir), inputs.files(spark, sf_dir), Workspace(spark, "references"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", tx.redact(F.col("content")).alias("redacted")).withColumn("changed", F.contains("redacted", F.lit(tx.REDACTED)))


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.numbered(inputs.files(spark, sf_dir)).where(tx.has_secret(F.col("text"))).select("path", "line")


def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.paths(spark, sf_dir).select("doc_id", "path", px.sensitive(F.col("path")).alias("excluded"))


def gitignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = px.parse_gitignore(GITIGNORE)
    path = F.col("path")
    return inputs.paths(spark, sf_dir).select("doc_id", "path", (px.ignored(path, rules) | px.under_ignored_folder(path, rules)).alias("ignored"))


def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return inputs.paths(spark, sf_dir).where(px.indexable(path) & ~px.in_dependencies(path) & ~px.sensitive(path)).select("doc_id", "path", px.is_test(path).alias("is_test"))


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files and read again by a scan; the first and the last file go between listing and reading."""
    root, work = shared_folder(spark, "tree"), Workspace(spark, "scan")
    tree.write(inputs.paths(spark, sf_dir, F.col("text").alias("content")), root)
    found = work.settle(tree.listing(spark, root).where(repository.wanted(F.col("path"), GITIGNORE)))
    for path in set(found.agg(F.min("path"), F.max("path")).first()) - {None}:
        delete(spark, f"{root}/{path}")
    text = F.col("content")
    read = work.settle(tree.contents(found, root).select("path", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.col("error").isNotNull().alias("failed")))
    tree.remove(inputs.paths(spark, sf_dir), root)
    return read


def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(inputs.symbols(spark, sf_dir), " Red ")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(inputs.symbols(spark, sf_dir), "Red o a e i red")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggestions(inputs.symbols(spark, sf_dir), "blue re green")


def commented_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.numbered(inputs.files(spark, sf_dir))
    return lines.runs(rows.select("path", "line", (F.length("text") % 3 > 0).alias("flag")))


def dup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.similar_windows(lines.windows(lines.numbered(inputs.files(spark, sf_dir))))


def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_blocks(lines.windows(lines.numbered(inputs.files(spark, sf_dir))))


def bracket_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as brackets: capitals open, full stops close, semicolons and colons are a pair of another kind."""
    content = F.translate(F.regexp_replace("content", r"[A-Z\u00C0-\u00DE]", "("), ".;:", ")[]")
    return brackets.bracket_errors(inputs.files(spark, sf_dir).select("path", content.alias("content")))


def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and characters of each class in each document, by a table function in SQL; commas and semicolons are quotes."""
    table_functions.register(spark)
    files = inputs.files(spark, sf_dir).select("path", F.translate("content", ",;", "'`").alias("content"))
    counts = "SELECT CAST(path AS LONG) AS path, kind, count(*) AS n_runs, sum(length) AS n_chars"
    return spark.sql(counts + " FROM char_classes(TABLE(SELECT path, content FROM {files})) GROUP BY path, kind", files=files)


def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of a base name with the file of best ending, among files whose endings depend on their number."""
    e = inputs.edges(spark, sf_dir)
    known = e.select("target").distinct().select(F.concat("target", F.element_at(F.array(*map(F.lit, graph.ENDINGS)), (F.col("target").cast("int") % 9 + 1).cast("int"))).alias("path"))
    known = known.unionByName(e.select("target").distinct().where("cast(target AS int) % 4 = 0").select(F.concat("target", F.lit(".jsx")).alias("path"))).distinct()
    return graph.first_match(e.select(F.col("path").alias("src"), "seq", F.col("target").alias("source"), F.col("target").alias("stem")), known, ["src", "seq", "source"])


def index_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, orphans and word counts after four batches of changes, each applied to what the batches before left."""
    index = views.Views(spark, shared_folder(spark, "index"), inputs.line_imports)
    for n, batch in enumerate(inputs.changes(spark, sf_dir)):
        index.update(batch, n)
    none = F.lit(None)
    row = lambda kind, a, b, n, m: [F.lit(kind).alias("kind"), F.col(a).alias("a"), b.cast("string").alias("b"), n.cast("long").alias("n"), m.cast("long").alias("m")]
    edges = index.current_edges().select(*row("edge", "path", F.col("target"), F.col("seq"), none))
    alone = index.current_orphans().select(*row("orphan", "path", none, none, none))
    return edges.unionByName(alone).unionByName(index.current_totals().select(*row("word", "token", none, F.col("n_real"), F.col("n_test"))))


def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = inputs.edges(spark, sf_dir)
    every = edges.select("path").union(edges.select("target")).distinct()
    got = graph.import_graph(every, edges)
    return got.select("path", F.array_join("targets", ",").alias("targets"), F.size("targets").alias("n_targets"))


def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(inputs.edges(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"))
    used = inputs.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("target"))
    return graph.orphans(parts, used).withColumn("confidence", F.lit("alto")).withColumn("suggested_action", F.lit("revisar-manualmente"))


def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.route_matches(inputs.endpoints(spark, sf_dir), inputs.calls(spark, sf_dir)).select("endpoint_seq", "call_seq", "same_method")


def unconsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.unconsumed(inputs.endpoints(spark, sf_dir), inputs.calls(spark, sf_dir)).select("endpoint_seq", "endpoint_route", "endpoint_method")


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.missing(inputs.endpoints(spark, sf_dir), inputs.calls(spark, sf_dir)).select("call_seq", "call_url", "call_method")


def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends, calls = inputs.endpoints(spark, sf_dir), inputs.calls(spark, sf_dir)
    return contracts.near_misses(ends, contracts.missing(ends, calls)).select("call_seq", "near_route", "near_method", "distance")


def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.endpoints(spark, sf_dir).select("seq", F.explode(rx.parameters(F.col("route"))).alias("p")).select("seq", "p.*")


def heartbeat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who send no event for six hours, from a stream of events that comes in three batches."""
    signs = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("sender"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = signs.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    third = F.floor((F.unix_millis("ts") - first) * 3 / (last - first + 1))
    return heartbeat.silences_of([signs.where(third == i) for i in range(3)], 21_600_000, "1 hour")


def checks_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks over documents, run side by side with ten minutes' time: status and number of findings of each."""
    files = inputs.files(spark, sf_dir)
    by_path = lambda rows, line: rows.select(F.col("path").cast("long").alias("path"), line.cast("int").alias("line"))
    checks = {
        "secrets": lambda: by_path(lines.numbered(files).where(tx.has_secret(F.col("text"))), F.col("line")),
        "comments": lambda: by_path(commented_runs(spark, sf_dir), F.col("start_line")),
        "sensitive-paths": lambda: by_path(sensitive_paths(spark, sf_dir).where("excluded").withColumn("path", F.col("doc_id")), F.lit(1)),
    }
    got = deadline.within(spark, checks, "path long, line int", 600)
    counts = got.findings.groupBy("check").agg(F.count(F.lit(1)).alias("n_findings"), F.sum("line").alias("sum_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return got.statuses.join(counts, "check", "left").select("ord", "check", "status", "reason", zero("n_findings"), zero("sum_lines"))


def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the properties of events by type, and of turns of conversations, as objects with a list of lines, by role."""
    events = inputs.table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), F.col("props").alias("json"))
    text = F.coalesce("text", F.lit(""))
    each = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(x).alias("n"), F.when(F.length(x) > 80, x).alias("long")))
    turns = inputs.table(spark, sf_dir, "conversations").select(F.col("role").alias("grp"), F.to_json(F.struct("turn", text.alias("text"), each.alias("lines"))).alias("json"))
    return shapes.shapes(events.unionByName(turns), "grp", "json")


def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's diff to the one before it in its source, and both texts rebuilt from the script."""
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.coalesce("text", F.lit("")).alias("text"))
    work = Workspace(spark, "diffs")
    pairs = work.settle(order.predecessors(docs, "source", "id", work).where("before IS NOT NULL").select("id", "before"))
    texts = docs.select("id", "text")
    both = work.settle(pairs.join(texts.withColumnRenamed("text", "new"), "id").join(texts.select(F.col("id").alias("before"), F.col("text").alias("old")), "before"))
    script = diffs.scripts(both)

    def side(ops: str) -> list:
        own = F.array_sort(F.collect_list(F.when(F.col("op").isin(*ops), F.struct("ord", "text"))))
        return [F.size(own).alias("n"), F.sha2(F.array_join(F.transform(own, lambda x: x["text"]), "\n").cast("binary"), 256).alias("text")]

    (n_old, old), (n_new, new) = side(" -"), side(" +")
    rebuilt = script.groupBy("id").agg(n_old.alias("old_lines"), old.alias("old_sha256"), n_new.alias("new_lines"), new.alias("new_sha256"))
    # each id has its pair: a left join gives the same rows, and puts no filter below the shuffle that scripts() reads twice
    return rebuilt.join(pairs, "id", "left").select(F.col("id").alias("path"), F.col("before").alias("other"), "old_lines", "new_lines", "old_sha256", "new_sha256")


def _contract_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the event types of every fifth event as what is sent, of others as what is expected; types by value."""
    e = inputs.table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("value") >= 50, "string").when(F.col("value") >= 20, "number").otherwise("any"))
    by = lambda rows, name: rows.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("event_type", "kind")))).alias(name))
    one = e.groupBy("user_id", "event_type", (F.col("event_id") % 5 == 0).cast("int").alias("odd")).agg(F.max("kind").alias("kind"))
    pairs = by(one.where("odd = 0"), "expected").join(by(one.where("odd = 1"), "sent"), "user_id")
    return pairs.withColumn("endpoint_method", F.when(F.col("user_id") % 3 == 0, "GET").otherwise("POST")).withColumn("required", F.map_keys(F.map_filter("expected", lambda k, v: v != "any")))


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.missing_fields(_contract_pairs(spark, sf_dir)).select("user_id", "field")


def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.type_mismatches(_contract_pairs(spark, sf_dir)).select("user_id", F.array_join("fields", ",").alias("fields"))


def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeds.union(*inputs.findings(spark, sf_dir))
    return rows.select("seq", "type", "source_module", "path", "line", "description", "suggested_action", "confidence", fx.diagnostic_severity(F.col("description"), F.col("confidence")).alias("severity"))


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeds.create(seeds.union(*inputs.findings(spark, sf_dir)), ["seq", "type", "description"])
    return rows.select("id", "seq", "type", "source_module", F.col("location.path").alias("path"), F.col("location.line").alias("line"), "state")


def seed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.transitions(inputs.requests(spark, sf_dir))


def seed_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeds.create(seeds.union(*inputs.findings(spark, sf_dir)), ["seq", "type", "description"])
    return seeds.basket(rows, most=8).drop("tooltip")


def carrying_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether seeds are pending after each event: views add one, purchases and errors take one away."""
    e = inputs.table(spark, sf_dir, "events").withColumn("delta", F.expr("CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 WHEN 'error' THEN -1 ELSE 0 END"))
    return seeds.carrying(e.select(F.col("event_id").alias("seq"), "delta"))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeds.diagnostics(seeds.union(*inputs.findings(spark, sf_dir)), F.col("seq"))
    text = F.transform("diagnostics", lambda d: F.concat_ws(":", d["seq"].cast("string"), d["severity"], d["line"].cast("string")))
    return rows.select("path", F.array_join(text, " ").alias("diagnostics"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", tx.snippet(F.col("content"), (F.col("path") % 4).cast("int"), 3).alias("snippet"))


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reports

    return reports.folder_tree(inputs.paths(spark, sf_dir).select("path"))


def readme_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft of a README line by line: documents as files, pages as endpoints, nations as dependencies."""
    nations = inputs.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"))
    packages = nations.union(spark.createDataFrame([("react",), ("axios",), ("express",)], "name string"))
    entry = F.struct(F.col("name").alias("k"), F.lit("1").alias("v"))
    text = lambda x: F.lit(x).cast("string")
    one = packages.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("dependencies"), F.format_string("%d paquetes.", F.count(F.lit(1))).alias("description"))
    one = one.select(text("tienda").alias("name"), "description", F.create_map(text("dev"), text("vite"), text("start"), text("node .")).alias("scripts"), "dependencies", F.lit(None).cast("map<string,string>").alias("devDependencies"))
    env = inputs.table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.upper("source").alias("name")).distinct()
    found = manifest.readme_lines(one, inputs.paths(spark, sf_dir).select("path"), inputs.endpoints(spark, sf_dir), env)
    return found.withColumn("key", F.array_join("key", "/")).withColumn("omitted", F.col("omitted_reason").isNotNull()).drop("omitted_reason")


def points_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as points of quantity and price, in areas that parts make of their size and price."""
    points = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    y0 = F.col("p_retailprice") * (F.col("p_partkey") % 40 + 1)
    edges = [F.col("p_size").cast("double").alias("x0"), y0.alias("y0"), (F.col("p_size") + F.col("p_partkey") % 4).cast("double").alias("x1"), (y0 + F.col("p_size") * 20).alias("y1")]
    found = areas.counted_in(points, inputs.table(spark, sf_dir, "part").select("p_partkey", *edges), "p_partkey")
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n_areas").alias("n_areas"), F.min("first_area").alias("first_area"))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    return e.select("event_id", fx.clamped_progress(F.col("value"), F.col("event_id") % 100).alias("progress"), fx.clamped_amount(F.col("value") - 20).alias("amount"), fx.backoff(F.col("event_id") % 8).alias("wait_ms"))


def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reports

    e = inputs.table(spark, sf_dir, "events")
    return reports.debounced(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), 3_600_000_000)


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as texts that come over the wire, some of them invalid."""
    e = inputs.table(spark, sf_dir, "events")
    json = F.expr("""CASE event_type WHEN 'view' THEN concat('{"type":"indexing","progress":', cast(event_id % 130 AS string), '}')
        WHEN 'click' THEN concat('{"type":"seed","amount":', cast(event_id % 1200 AS string), '}')
        WHEN 'error' THEN concat('{"type":"error","message":"', CASE WHEN event_id % 4 = 0 THEN '' ELSE cast(user_id AS string) END, '"}')
        WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN '{"type":"idle","x":1}' ELSE '{"type":"hide"}' END ELSE '{"type":"signup"}' END""")
    return e.select("event_id", json.alias("json"))


def event_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wire(spark, sf_dir).select("event_id", ex.valid_event(F.col("json")).alias("valid"))


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get_json_object("json", "$.type")
    return _wire(spark, sf_dir).select("event_id", ex.visual_state(kind).alias("state"), ex.bubble(F.col("json")).alias("bubble"))


def finding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and message of the events that findings become; linter findings stand for secrets."""
    rows = seeds.union(*inputs.findings(spark, sf_dir))
    kind = F.when(F.col("type") == "precommit:linter", "precommit:secret").otherwise(F.col("type"))
    made = rows.select("seq", ex.of_finding(kind, F.col("path"), F.col("description")).alias("json"))
    return made.select("seq", F.get_json_object("json", "$.type").alias("kind"), F.get_json_object("json", "$.message").alias("message"))


def tech_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for each customer's packages: four of a list, by key."""
    names = ["react", "express", "left-pad", "vite", "vue", "typescript", "koa"]
    picked = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(F.array(*map(F.lit, names)), ((F.col("c_custkey") * (i + 1)) % len(names) + 1).cast("int")))
    rows = inputs.table(spark, sf_dir, "customer").select("c_custkey", F.array_distinct(picked).alias("deps"))
    return rows.select("c_custkey", manifest.summary(F.col("deps")).alias("summary"), F.array_join(manifest.stack(F.col("deps"), manifest.BACKEND_STACK, F.lit(None).cast("string")), ",").alias("backend"))


_QUERIES = (
    event_validate, event_states, finding_events, tech_stack,
    unused_names, word_refs, redact_documents, secret_lines, sensitive_paths, gitignore_filter, indexable_files, scanned_files, search_exact, search_topk, suggestions,
    bracket_errors, char_classes, commented_runs, dup_windows, duplicate_blocks, import_resolution, index_maintained, heartbeat_gaps, checks_within, json_shapes, line_diffs, import_graph, related_files, orphans, route_match, unconsumed, missing, near_miss, route_params,
    schema_diff, type_mismatch, findings_union, seed_rows, seed_states, seed_basket, carrying_flag, diagnostics, snippets, folder_tree, readme_lines, points_in_areas, progress_events, debounced,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL
