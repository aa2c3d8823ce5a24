"""Line deduplication by an exact set-similarity join of lines.

A line's tokens are its 5-word shingles, ordered by rarity; a line with fewer words is one token as a whole. Prefix,
positional and length filters find the pairs of lines that can be similar, which are verified by their Jaccard
similarity; of two similar lines the later one is removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setsim
from .common import located, place_in_files, scratch, settle


def kind(words: int = 5, threshold: int = 80, short: bool = True) -> setsim.Kind:
    return setsim.Kind(lines=True, words=words, threshold=threshold, fold=False, short=short, bitmap=128)


def _documents(scanned: DataFrame) -> DataFrame:
    return scanned.where("node IS NULL AND shingle IS NULL").select("doc_id", "file", "row", F.col("n").cast("long").alias("n_lines"))


def _place(scanned: DataFrame) -> Column:
    """The order of lines, by document id, null last, place in the files and line number: one number where ids don't
    repeat and leave room for it."""
    ids = _documents(scanned)
    one = ids.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("n_lines").alias("lines"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if not one.nulls and one.least is not None and -(1 << 38) < one.least and one.most < 1 << 38 and one.lines < 1 << 24 and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return F.col("doc_id") * (1 << 24) + F.col("line")
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row", "line")


def _later(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Nodes of the pairs whose first line comes after the other's."""
    one, two = (first.select(F.col("node").alias(s), F.col("place").alias(f"place_{s}")) for s in "ab")
    ranked = pairs.join(one, "a").join(two, "b")
    later = F.when(F.col("place_a") < F.col("place_b"), F.col("b")).when(F.col("place_b") < F.col("place_a"), F.col("a"))
    return ranked.select(later.alias("node")).where("node IS NOT NULL").distinct()


class _Removals(setsim.Links):
    """Nodes that come after a similar one are gone; the others of a group are open."""

    one_way = True
    later: DataFrame | None = None

    def absorb(self, pairs: DataFrame, nodes: DataFrame) -> None:
        new = settle(_later(pairs, nodes), "later")
        self.later = new if self.later is None else self.later.unionByName(new.join(self.later, "node", "left_anti"))

    def labelled(self, nodes: DataFrame) -> DataFrame:
        return nodes.join(self.later.withColumn("gone", F.lit(True)), "node", "left").withColumn("label", F.col("node"))

    def opened(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("open", F.col("gone").isNull())


def _removed(docs: DataFrame, words: int, threshold: int, short: bool) -> tuple[DataFrame, DataFrame]:
    """Within scratch(), of located docs: documents (doc_id, file, row, n_lines), and the lines to be removed by document
    (file, row, removed)."""
    scanned, nodes, how = setsim.scanned_nodes(docs, kind(words, threshold, short), _place)
    found = _Removals()
    setsim.link(docs, scanned, how, nodes, found)
    told = nodes.select(F.col("node").alias("of"), F.col("place").alias("first"), "copies").join(found.later.select(F.col("node").alias("of"), F.lit(True).alias("near")), "of", "left").where("near OR copies > 1")
    lines = scanned.where("node IS NOT NULL").select("file", "row", "line", "node", _place(scanned).alias("place"))
    marked = lines.join(told, F.col("node") == F.col("of")).where("near OR place > first")
    gone = marked.groupBy(F.col("file").alias("of_file"), F.col("row").alias("of_row")).agg(F.array_sort(F.collect_list("line")).alias("removed"))
    return _documents(scanned), gone


def _same_row() -> Column:
    return (F.col("file") == F.col("of_file")) & (F.col("row") == F.col("of_row"))


def deduplicate(docs: DataFrame, words: int = 5, threshold: int = 80, short: bool = True) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (their numbers from 0, in order).

    Lines end at a line feed. A line is removed if the corpus has an earlier line, by document id (null last), place in the
    files and line number, whose 5-word shingles are equal or have a Jaccard similarity of the threshold or more, whether
    that one stays or not. With ``short``, a line with fewer words is one token as a whole, and goes if an earlier one has
    the same words; without it such lines stay. Lines without words always stay. Null text has no lines. Repeated rows, and
    rows that share an id, are documents each. A very long text or line is compared as a whole. No rows: no rows. Extra
    columns are ignored.
    """
    with scratch(docs.sparkSession, "lines"):
        documents, gone = _removed(located(docs), words, threshold, short)
        removed = F.coalesce("removed", F.array().cast("array<int>"))
        return settle(documents.join(gone, _same_row(), "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed")), "line-dedup", keep=True)


def _rewrite(text_at: int, chars_at: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without the lines that the last column lists."""

    def kept(text: str, gone: list[int]) -> str:
        drop = set(gone)
        return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, gone = batch.columns[:-1], batch.columns[-1]
            texts = [t.as_py() if not g.is_valid or not t.is_valid else kept(t.as_py(), g.as_py()) for t, g in zip(columns[text_at], gone, strict=True)]
            if chars_at is not None:
                columns[chars_at] = pa.array([old.as_py() if not g.is_valid or t is None else len(t) for old, t, g in zip(columns[chars_at], texts, gone, strict=True)], columns[chars_at].type)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def without_removed_lines(docs: DataFrame, words: int = 5, threshold: int = 80, short: bool = True) -> DataFrame:
    """The documents with removed lines taken out of their texts, all rows and columns; n_chars follows where there is one.

    Which lines go is said at deduplicate(). A null text stays null; one all of whose lines go becomes empty. No rows: no
    rows. Extra columns, whatever their names, are kept.
    """
    docs, names = located(docs), docs.columns
    with scratch(docs.sparkSession, "lines"):
        gone = settle(_removed(docs, words, threshold, short)[1], "removed", keep=True)
    rows = place_in_files(docs, whole=F.struct("*")).join(gone, _same_row(), "left")
    joined = rows.select("whole.*", F.col("removed").alias(f"removed_{uuid.uuid4().hex}"))
    return joined.mapInArrow(_rewrite(names.index("text"), names.index("n_chars") if "n_chars" in names else None), docs.schema)
