"""Engine-shaped inputs made from the test tables by expressions that both engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files; those of odd sources play test files."""
    docs = table(spark, sf_dir, "documents")
    odd = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 1
    return docs.select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"), odd.alias("is_test"))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first identifier of each document's first line."""
    first = F.regexp_extract(F.regexp_extract("content", r"\A([^\r\n]*)", 1), r"([A-Za-z0-9_$]+)", 1)
    return files(spark, sf_dir).select("path", first.alias("name"), F.lit(1).alias("line")).where("name <> ''")


def paths(spark: SparkSession, sf_dir: str, *also: Column) -> DataFrame:
    """Made-up paths of documents, some with sensitive names, in dependency folders or with other endings, and other columns."""
    docs = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, [".ts", ".tsx", ".js", ".jsx", ".spec.ts", ".md", ".pem", ".generated.ts"])), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("my-secret-"), "doc_id")).when(F.col("doc_id") % 13 == 0, F.concat(F.lit(".env."), "doc_id")).otherwise(F.col("doc_id").cast("string"))
    top = F.when(F.col("doc_id") % 7 == 0, "node_modules").when(F.col("doc_id") % 5 == 0, "dist").when(F.col("doc_id") % 17 == 0, ".ssh").otherwise(F.col("source"))
    return docs.select("doc_id", F.concat_ws("/", F.lit("src"), top, "lang", F.concat(name, ending)).alias("path"), *also)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between numbered files: orders import parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").cast("string").alias("target"))


def _url(col: str = "url"):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"[?#].*$", ""), r"^[a-z]+://[^/]*", ""), r"\.html$", ""), r"/$", "")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages as endpoints; the last segment of some is a parameter."""
    path = F.when(F.col("page_id") % 40 == 0, F.regexp_replace(_url(), r"/[^/]*$", "/:id")).otherwise(_url())
    method = F.element_at(F.array(*map(F.lit, ["GET", "POST", "PUT", "DELETE", "PATCH"])), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("seq"), path.alias("route"), method.alias("method"), F.lit("back.ts").alias("path"), (F.col("page_id") + 1).alias("line"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd pages as calls, some with a host from the environment."""
    method = F.element_at(F.array(*map(F.lit, ["GET", "POST", "PUT"])), (F.col("page_id") % 3 + 1).cast("int"))
    url = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("${API}"), _url(), F.lit("?q=1"))).otherwise(_url())
    return table(spark, sf_dir, "pages").where("page_id % 2 = 1").select(F.col("page_id").alias("seq"), url.alias("url"), method.alias("method"), F.lit("front.ts").alias("path"), (F.col("page_id") + 1).alias("line"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as requests to change the state of one seed."""
    states = {"signup": "En revisión", "error": "Ignorada", "click": "Pendiente", "view": "En revisión", "purchase": "Resuelta"}
    to = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seed_id"), F.col("event_id").alias("seq"), to[F.col("event_type")].alias("new_state"))


def findings(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Events as findings of three modules, which have different columns."""
    e = table(spark, sf_dir, "events")
    seq, text = F.col("event_id").alias("seq"), F.concat(F.lit("user "), "user_id")
    path = F.concat(F.lit("src/f"), F.floor(F.col("event_id") / 25).cast("string"), F.lit(".ts")).alias("path")
    dead = e.where("event_type = 'view'").select(seq, F.lit("dead-code:unused-import").alias("type"), F.lit("dead-code-detector").alias("source_module"), path, (F.col("event_id") % 90 + 1).cast("int").alias("line"), text.alias("description"), F.lit("eliminar").alias("suggested_action"), F.when(F.col("event_id") % 3 == 0, "alto").otherwise("medio").alias("confidence"))
    word = F.element_at(F.array(*map(F.lit, ["error", "advertencia", "recomendación"])), (F.col("event_id") % 3 + 1).cast("int"))
    checks = e.where("event_type IN ('error', 'purchase')").select(seq, F.when(F.col("event_type") == "error", "precommit:linter").otherwise("tip:multiple").alias("type"), F.lit("pre-commit-reviewer").alias("source_module"), path, F.lit(None).cast("int").alias("line"), F.concat(F.lit("["), word, F.lit("] "), text).alias("description"))
    other = e.where("event_type = 'click'").select(seq, F.lit("fb-comparator:missing-endpoint").alias("type"), F.lit("frontend-backend-comparator").alias("source_module"), F.lit(None).cast("string").alias("path"), F.col("event_id").cast("int").alias("line"), text.alias("description"))
    return [dead, checks, other]


def changes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Four batches of changes to documents as files: all come; a fifth goes; some change and some come back; some go again."""
    k = F.col("doc_id")
    ending = F.element_at(F.array(*map(F.lit, [".ts", ".tsx", ".js", "/index.jsx", ".spec.ts"])), (k % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(k, F.concat(F.lit("src/d"), k.cast("string"), ending).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def batch(n: int, **kinds: tuple) -> DataFrame:
        parts = [docs.where(which).select((k + n * 2**40).alias("seq"), "path", F.lit(kind).alias("change_type"), content.cast("string").alias("content")) for kind, (which, content) in kinds.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    none, text = F.lit(None), F.col("text")
    return [
        batch(0, create=(F.lit(True), text)),
        batch(1, delete=(k % 5 == 0, none)),
        batch(2, modify=(k % 7 == 1, F.concat(text, F.lit("\nchanged"))), create=((k % 10 == 0) & (k % 7 != 1), text)),
        batch(3, delete=(k % 11 == 2, none), create=((k % 15 == 5) & (k % 11 != 2), F.lit("only line"))),
    ]


def line_imports(files: DataFrame) -> DataFrame:
    """path, seq, stem: each line of a file imports the file whose number lies as far off as the line is long."""
    number = F.regexp_extract("path", r"^src/d(\d+)", 1).cast("long")
    by_line = files.select("path", number.alias("k"), F.posexplode(lines(F.col("content"))).alias("at", "text"))
    return by_line.select("path", F.col("at").cast("long").alias("seq"), F.concat(F.lit("src/d"), (F.col("k") + F.length("text") % 97 - 48).cast("string")).alias("stem"))
