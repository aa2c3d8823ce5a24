"""Quality rules of documents and verdicts on hosts.

Word and line measures of every whole text give base failures. Failures are added up by host (the source of a
document), failure rates are drawn towards the mean of all hosts by a beta prior that is fitted to the hosts by moments,
and a host whose drawn-in rate exceeds a limit loses all its documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import settle

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    span = 1
    while span < window:  # ranks of runs of 1, 2, 4, 8 words: equal ranks are equal runs
        step = min(span, window - span)
        pairs = codes[: len(codes) - step] * np.int64(len(words) + 1) + codes[step:]
        codes = np.unique(pairs, return_inverse=True)[1]
        span += step
    again = np.bincount(codes)[codes] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(again)] += again
    edges[window : window + len(again)] -= again
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text in UTF-8."""
    words = text.split()
    solid = text.translate(None, _SPACES)
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), len(solid.translate(None, _CONTINUATION)), len(solid) - len(solid.translate(None, SYMBOLS)), dup, repeated_words(words)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _failed(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [measures(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
        columns = zip(*got, strict=True) if got else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "source", *_MEASURES])


def document_measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, the five measures and base_failed, one row per document; null text has no words."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(_measure, ", ".join(["doc_id long", "source string", *[f"{m} long" for m in _MEASURES]]))
    return rows.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))


def host_verdicts(measured: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row per host: source, n_docs, n_failed, rate, host_rejected.

    The prior's mean is the failure rate of all documents; its strength follows from how much more the hosts' rates vary
    than chance alone would make them, between 1 and 10,000 documents. Hosts reduce to one row each before anything is
    compared, so a host with a third of all rows is as cheap as any.
    """
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = settle(hosts, "host-rates")
    whole = hosts.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_failed").alias("all_failed"), F.count(F.lit(1)).alias("n_hosts"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"))
    mean = F.col("all_failed") / F.col("all_docs")
    chance = mean * (1 - mean)
    spread = F.col("squares") / F.col("all_docs") - mean * mean - chance * F.col("n_hosts") / F.col("all_docs")
    strength = F.when(spread * 10001 > chance, F.greatest(F.lit(1.0), chance / spread - 1)).otherwise(F.lit(10000.0))
    prior = whole.select(F.struct(mean.alias("mean"), strength.alias("strength")).alias("prior")).scalar()
    rate = (F.col("n_failed") + prior["mean"] * prior["strength"]) / (F.col("n_docs") + prior["strength"])
    return hosts.select("source", "n_docs", "n_failed", rate.alias("rate")).withColumn("host_rejected", F.col("rate") > limit)


def apply_rules(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row per document: doc_id, source, the measures, base_failed, kept.

    ``kept`` is false if the document fails itself or its host is rejected. Null text: no words, so it fails. Null
    source: a host of its own. A very long text is measured as a whole. No rows: no rows. Repeated rows are judged each.
    Extra columns are ignored.
    """
    measured = settle(document_measures(docs), "measures")
    hosts = settle(host_verdicts(measured, limit), "hosts").select(F.col("source").alias("host"), "host_rejected")
    return measured.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).drop("host", "host_rejected")


def _judge(text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows, each with whether its text fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measures(t or b"") for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            failed = pa.array([bool(_failed(m[0], m[4])) for m in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, failed], names=[*batch.schema.names, f"failed_{len(batch.schema)}"])

    return run


def passing_documents(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents that pass apply_rules(), with all their columns.

    Each row is judged by its own text and host, so rows that share an id, or have none, stay or go each. A null text goes.
    No rows: no rows. Extra columns, whatever their names, are kept. Texts are measured once, and written with their
    verdicts; only the few rejected hosts are joined to them.
    """
    flag = f"failed_{uuid.uuid4().hex}"
    judged = docs.mapInArrow(_judge(docs.columns.index("text")), StructType([*docs.schema.fields, StructField(flag, BooleanType())]))
    rows = settle(judged.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), F.col(flag).alias("base_failed")), "judged", keep=True)
    rejected = settle(host_verdicts(rows, limit).where("host_rejected").select(F.col("source").alias("host")), "rejected")
    return rows.where("NOT base_failed").join(rejected, F.col("source").eqNullSafe(F.col("host")), "left_anti").select("row.*")
