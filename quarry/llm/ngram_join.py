"""Near duplicates by an exact join on word n-grams, with their components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsim
from .common import located, place_in_files, scratch, settle
from .components import components, merged


def kind(words: int = 5, threshold: int = 80) -> setsim.Kind:
    return setsim.Kind(lines=False, words=words, threshold=threshold, fold=True, short=True, bitmap=512)


class _Components(setsim.Links):
    """Labels are those of components; a node is open where most of its group's nodes have another label."""

    labels: DataFrame | None = None

    def absorb(self, pairs: DataFrame, nodes: DataFrame) -> None:
        self.labels = components(pairs) if self.labels is None else merged(self.labels, pairs)

    def labelled(self, nodes: DataFrame) -> DataFrame:
        return nodes.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def opened(self, rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("signature", "label").agg(F.count(F.lit(1)).alias("members"))
        main = sizes.groupBy("signature").agg(F.max_by("label", F.struct("members", "label")).alias("main"))
        return rows.join(main, "signature").withColumn("open", F.col("label") != F.col("main")).drop("main")


def _linked(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """doc_id, file, row, n_shingles, class_id and label (of the component, null for texts without words) of located docs."""
    scanned, nodes, how = setsim.scanned_nodes(docs, kind(words, threshold))
    found = _Components()
    setsim.link(docs, scanned, how, nodes, found)
    rows = scanned.where("node IS NOT NULL").select("doc_id", "file", "row", F.col("n").cast("long").alias("n_shingles"), F.col("node").alias("class_id"))
    some = rows.join(found.labels, F.col("class_id") == F.col("node"), "left")
    return some.select("doc_id", "file", "row", "n_shingles", "class_id", F.when(F.col("n_shingles") > 0, F.coalesce("label", "class_id")).alias("label"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links lead to), class_id.

    A document's set has its distinct shingles of so many words, A-Z in lower case; a shorter text is one shingle as a
    whole; null, empty and blank texts have none and link with nothing. Documents link if 100 * intersection >= threshold *
    union; equal sets (one class) always do. A null id is a component's id only where there is no other. Repeated rows
    are documents each. A very long text is hashed in pieces and has as many shingles as it has; nothing is cut off. No
    rows: no rows. Extra columns are ignored.
    """
    with scratch(docs.sparkSession, "near-duplicates"):
        rows = settle(_linked(located(docs), words, threshold).drop("file", "row"), "linked")
        some = rows.where("label IS NOT NULL")
        least = some.groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("component_id"))
        linked = some.join(least, F.col("label") == F.col("of")).select("doc_id", "n_shingles", "component_id", "class_id")
        alone = rows.where("label IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "class_id")
        return settle(linked.unionByName(alone), "near-duplicates", keep=True)


def one_of_each(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each component of near_duplicates(), with all columns: the one with the smallest id.

    Null ids come last, and of equal ids the row that lies first in its files stays; rows that share an id but not a
    component are judged each. Rows without words or text all stay. No rows: no rows. Extra columns, whatever their
    names, are kept.
    """
    docs = located(docs)
    with scratch(docs.sparkSession, "one-of-each"):
        rows = settle(_linked(docs, words, threshold).where("label IS NOT NULL").select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row").alias("place")), "linked")
        first = rows.groupBy(F.col("label").alias("of")).agg(F.min("place").alias("first"))
        later = rows.join(first, F.col("label") == F.col("of")).where("place <> first")
        gone = settle(later.select(F.col("place.file").alias("gone_file"), F.col("place.row").alias("gone_row")), "gone", keep=True)
    rows = place_in_files(docs, whole=F.struct("*"))
    return rows.join(gone, (F.col("file") == F.col("gone_file")) & (F.col("row") == F.col("gone_row")), "left_anti").select("whole.*")
