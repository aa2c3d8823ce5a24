"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents stand in the order of that key; the key space is cut
into equal slices (keys are uniform, so slices hold near equal numbers of rows whatever the ids are), slices are sorted
each in a task of their own, and running sums of slice totals turn positions within a slice into positions within the
source. A source is then cut at its budget to the word, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import located, place_in_files, settle, word_count

#: Hexadecimal digits of the hash that make a key; 15 of them fit a positive long.
KEY_DIGITS = 15


def random_key(doc_id: Column, place: Column, seed: str) -> Column:
    """The key of an id; rows without one have a key each, by their place."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat_ws(":", F.lit("null"), place))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """One row per source: source, weight, n_docs, source_size, target.

    ``sizes`` has source and size. Sources take the weights in turn in code point order, null last. A target is the
    weight's part of ``share`` times all sizes, at most ``cap`` times the source's size; what a cap leaves over goes to
    the others by weight. That is water-filling: with sources in the order of size / weight, a source is capped if the
    level reached by filling everything before it to the cap lies above its own cap.
    """
    every = Window.partitionBy()
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = F.array(*[F.lit(int(x)) for x in weights])
    most = F.lit(float(cap)) * F.col("source_size")
    rows = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("rank", F.row_number().over(by_source))
        .withColumn("weight", F.element_at(w, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("filled", F.coalesce(F.sum(most).over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(rest))
        .withColumn("capped", (F.col("budget") - F.col("filled")) * F.col("weight") >= most * F.col("open_weight"))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), most)).over(every), F.lit(0.0)))
        .withColumn("sharing", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.lit(1)))
    )
    target = F.when(F.col("capped"), most).otherwise(F.col("left") * F.col("weight") / F.col("sharing"))
    return rows.select("source", "weight", "n_docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (5, 2, 1), seed: str = "mix", rows_per_slice: int = 4096) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and its place, file and row.

    ``taken`` counts the words of this document in the mix, repeats included; the words of a source add up to its
    target, rounded down. Null or empty text: size and taken 0; a very long text is counted as a whole. Null source: a
    source of its own. Rows with a null id have keys of their own; equal ids share a key and are ordered by size and place,
    so a rerun over the same files gives the same rows. Repeated rows are documents each. No rows: no rows. Extra columns
    are ignored.
    """
    sizes = settle(place_in_files(located(docs), "doc_id", source=F.col("source"), size=word_count(F.col("text"))), "mix-sizes")
    targets = settle(source_targets(sizes, share, cap, weights), "mix-targets").withColumnRenamed("source", "of")
    slices = F.ceil(F.col("n_docs") / rows_per_slice)
    keyed = (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("key", random_key(F.col("doc_id"), F.concat_ws(":", "file", "row"), seed))
        .withColumn("slice", F.least(F.floor(F.col("key") / F.lit(16.0**KEY_DIGITS) * slices), slices - 1))
        .select("doc_id", "source", "size", "source_size", "target", "key", "slice", "file", "row")
    )
    ahead = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        keyed.groupBy(F.col("source").alias("of"), F.col("slice").alias("at"))
        .agg(F.sum("size").alias("slice_size"))
        .select("of", "at", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("slice_start"))
    )
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "file", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("inner_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(totals, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
        .withColumn("start", F.col("slice_start") + F.col("inner_start"))
    )
    whole = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    left = whole - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "file", "row")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: each row as often as it was taken, to the nearest whole document, with docs' columns.

    A row whose taken words come to less than half its size is left out; so is a row without words (null, empty or blank
    text). Texts stay whole, however long. Every row is told by its place, so rows with a null or the same id, and wholly
    equal rows, are mixed each for itself; a source's words come to its target but for one document at its cut. Null
    source: a source of its own. No rows: no rows. Columns may have any names.
    """
    docs = located(docs)
    taken = mix(docs, **how).where("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    times = taken.select(F.col("file").alias("of_file"), F.col("row").alias("of_row"), copies.alias("copies")).where("copies > 0")
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(F.struct("*").alias("document"), F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"))
    placed = rows.join(times, (F.col("file") == F.col("of_file")) & (F.col("row") == F.col("of_row")))
    return placed.select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")).select("document.*")
