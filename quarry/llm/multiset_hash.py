"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs: its lines, cut further after the end of a sentence. Every paragraph is hashed to a wide
vector of numbers, and a text's fingerprint is the sum of its paragraphs' vectors. So order doesn't matter, a paragraph is
put in or taken out by adding or subtracting its vector, and fingerprints of parts add up to that of the whole.

A vector has one number that counts paragraphs; SEALS numbers, uniform and summed modulo 2**32, which tell whether two
multisets are equal; and tallies, 0 or 1 in each paragraph's vector and summed modulo 2**31, two of them in each of PACKED
numbers. A tally's distance from half the count behaves like a sum of random signs, so the product of two texts' distances,
averaged over the tallies, estimates how many paragraphs they have in common. A text of 2**31 bytes has fewer than 2**30
paragraphs: no sum overflows and no tally wraps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import located, partitions

#: Numbers of a vector after the count, and the width of a tally in its pack.
SEALS, PACKED, WIDTH = 8, 64, 31
WORD32, TALLY = 2**32, 2**WIDTH - 1
#: What lies between two paragraphs.
BETWEEN = r"\n|(?<=[.!?])\x20+"
#: Ranges of documents for each shuffle partition.
RANGES = 4


def paragraphs(text: Column) -> Column:
    """The pieces of a text between line ends and sentence ends; some may be empty, which count for nothing."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN, -1)


def _numbers(digest: Column) -> list[Column]:
    """The numbers of a paragraph's vector, from its digest."""
    bits = [F.xxhash64(F.lit(f"tallies {i}"), digest) for i in range(PACKED // 32)]
    seals = [F.xxhash64(F.lit(f"seal {i}"), digest).bitwiseAND(WORD32 - 1) for i in range(SEALS)]
    pack = [F.shiftrightunsigned(b, i).bitwiseAND(1) + F.shiftleft(F.shiftrightunsigned(b, i + 32).bitwiseAND(1), WIDTH) for b in bits for i in range(32)]
    return [F.lit(1).cast("long"), *seals, *pack]


def sums(digest: Column, times: Column) -> Column:
    """An aggregate: the vector of paragraphs by their digests, each taken ``times`` times, which may be negative."""
    return F.array(*[F.coalesce(F.sum(n * times), F.lit(0).cast("long")) for n in _numbers(digest)])


def _reduced(vector: Column) -> Column:
    return F.transform(vector, lambda x, i: F.when((i > 0) & (i <= SEALS), F.pmod(x, F.lit(WORD32))).otherwise(x))


def plus(a: Column, b: Column) -> Column:
    """The vector of two multisets together, or of one with a change."""
    return _reduced(F.zip_with(a, b, lambda x, y: x + y))


def minus(a: Column, b: Column) -> Column:
    """The vector of a multiset without a part of it."""
    return _reduced(F.zip_with(a, b, lambda x, y: x - y))


def as_text(vector: Column) -> Column:
    """A fingerprint: the count, the seals and the packed tallies in hexadecimal. Equal if and only if vectors are."""
    return F.array_join(F.transform(vector, lambda x, i: F.lpad(F.lower(F.hex(x)), F.when(i <= SEALS, 8).otherwise(16), F.lit("0"))), "")


def from_text(fingerprint: Column) -> Column:
    """The vector of a fingerprint."""
    places = [(1 + 8 * i, 8) for i in range(SEALS + 1)] + [(1 + 8 * (SEALS + 1) + 16 * i, 16) for i in range(PACKED)]
    return F.array(*[F.conv(F.substring(fingerprint, at, n), 16, 10).cast("long") for at, n in places])


def likeness(a: Column, b: Column) -> Column:
    """How much of two texts is in common, 0 to 1: an estimate of twice the common paragraphs by the paragraphs of both.

    Equal vectors give 1, an empty and another text 0. With 2 * PACKED tallies the estimate's standard deviation is about
    a tenth of what is missing to 1.
    """
    def signs(x: Column, n: Column) -> Column:
        low, high = x.bitwiseAND(TALLY), F.shiftright(x, WIDTH)
        return F.struct((low * 2 - n).cast("double").alias("l"), (high * 2 - n).cast("double").alias("h"))

    def tallies(v: Column) -> Column:
        return F.transform(F.slice(v, SEALS + 2, PACKED), lambda x: signs(x, v[0]))

    def add(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.struct((s["both"] + x["l"] * y["l"] + x["h"] * y["h"]).alias("both"), (s["all"] + x["l"] * x["l"] + x["h"] * x["h"] + y["l"] * y["l"] + y["h"] * y["h"]).alias("all"))

    pairs = F.zip_with(tallies(a), tallies(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    zero = F.struct(F.lit(0.0).alias("both"), F.lit(0.0).alias("all"))
    part = F.aggregate(pairs, zero, add, lambda s: F.when(s["all"] > 0, 2 * s["both"] / s["all"]).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint. Null text counts as empty: no paragraphs, all numbers zero."""
    docs = located(docs)
    meta = docs.metadataColumn("_metadata")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pieces = docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"), F.explode(paragraphs(text)).alias("piece"))
    vector = sums(F.sha2(F.col("piece").cast("binary"), 256), (F.col("piece") != "").cast("long"))
    return pieces.groupBy("file", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), _reduced(vector).alias("v")).select("doc_id", "n_chars", as_text("v").alias("fingerprint"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key of their order, two longs: ids, null after all others; of equal ids a hash of the place."""
    meta = docs.metadataColumn("_metadata")
    place = F.xxhash64(meta["file_path"], meta["row_index"])
    doc_id = F.col("doc_id").cast("long")
    tie = F.shiftrightunsigned(place, 2) + F.when(doc_id.isNull(), F.lit(2**62)).otherwise(F.lit(0))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("id"), tie.alias("tie"))


def _ranges(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The first key of each of a number of ranges of about equal counts, that number being set by the configuration."""
    n = partitions(keyed.sparkSession) * RANGES
    dealt = keyed.select("id", "tie").repartitionByRange(n, "id", "tie").withColumn("part", F.spark_partition_id())
    firsts = sorted(r["first"] for r in dealt.groupBy("part").agg(F.min(F.struct("id", "tie")).alias("first")).collect())
    return np.array([f[0] for f in firsts], dtype=np.int64), np.array([f[1] for f in firsts], dtype=np.int64)


def _with_next(keyed: DataFrame) -> DataFrame:
    """Documents in ranges, each with the text that follows in the order of keys; after the last comes the first.

    The ranges' first keys are known, so a row finds its range by bisection and goes there in one shuffle. The first row of
    a range goes to the range before, too, as its end.
    """
    ids, ties = _ranges(keyed)
    at_id, at_tie = F.lit(ids), F.lit(ties)
    last = len(ids) - 1

    def bisect(range_: Column, _: Column) -> Column:
        middle = F.shiftright(range_["low"] + range_["high"] + 1, 1)
        mid_id, mid_tie = F.element_at(at_id, middle + 1), F.element_at(at_tie, middle + 1)
        above = (F.col("id") > mid_id) | (F.col("id") == mid_id) & (F.col("tie") >= mid_tie)
        return F.struct(F.when(above, middle).otherwise(range_["low"]).alias("low"), F.when(above, range_["high"]).otherwise(F.greatest(middle - 1, range_["low"])).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, last.bit_length())))
    part = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(last).alias("high")), bisect, lambda r: r["low"])
    placed = keyed.withColumn("part", part)
    is_first = (F.col("id") == F.element_at(at_id, F.col("part") + 1)) & (F.col("tie") == F.element_at(at_tie, F.col("part") + 1))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("end"))
    before = F.struct(F.when(F.col("part") > 0, F.col("part") - 1).otherwise(F.lit(last)).alias("part"), F.lit(True).alias("end"))
    places = F.when(is_first, F.array(own, before)).otherwise(F.array(own))
    dealt = placed.withColumn("place", F.explode(places)).select("doc_id", "text", "id", "tie", "place.part", "place.end")
    return dealt.withColumn("next", F.lead("text").over(_order()))


def _order() -> Window:
    return Window.partitionBy("part").orderBy("end", "id", "tie")


def edited(docs: DataFrame, share: int = 4) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    In the edited text the last floor(n_chars / share) code points are replaced by the first as many, or all, of the next
    document. Its fingerprint is the text's, with the paragraphs that the edit removes taken out and those that it brings
    put in. Null text counts as empty, with a fingerprint of zeros. Null ids come last; the order of equal ids, null ids
    too, is that of a hash of their places. A single document is followed by itself. Repeated rows are documents each, very
    long texts are hashed and cut as a whole, no rows give no rows, extra columns are ignored.
    """
    docs = located(docs)
    keyed = _keyed(docs)
    if docs.isEmpty():
        empty = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        return docs.sparkSession.createDataFrame([], empty)
    n = F.char_length("text")
    cut = F.floor(n / share).cast("int")
    keys = ["part", "end", "id", "tie", "doc_id"]
    texts = _with_next(keyed).select(*keys, n.cast("long").alias("n_chars"), "text", F.substring("text", F.lit(1), n - cut).alias("kept"), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut).alias("head"))
    whole = F.concat("kept", "head")
    split = texts.select(*keys, "n_chars", F.sha2(whole.cast("binary"), 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("old"), paragraphs(whole).alias("new"), (F.size(paragraphs(F.col("kept"))) - 1).alias("same"))
    # 0 stays, -1 goes, 1 comes; the last paragraph of what is kept may go on in another way
    old = F.transform("old", lambda p, i: F.struct(p.alias("piece"), F.when(i < F.col("same"), 0).otherwise(-1).alias("change")))
    new = F.transform(F.slice("new", F.col("same") + 1, F.greatest(F.size("new") - F.col("same"), F.lit(0))), lambda p: F.struct(p.alias("piece"), F.lit(1).alias("change")))
    pieces = split.select(*keys, "n_chars", "edited_sha256", F.explode(F.concat(old, new)).alias("p")).select(*keys, "n_chars", "edited_sha256", "p.piece", "p.change")
    digest = F.sha2(F.col("piece").cast("binary"), 256)
    counts = F.when(F.col("piece") == "", 0)
    had, change = counts.otherwise(F.when(F.col("change") <= 0, 1).otherwise(0)).cast("long"), counts.otherwise(F.col("change")).cast("long")
    found = pieces.withColumn("digest", digest).groupBy(*keys, "n_chars", "edited_sha256").agg(sums(F.col("digest"), had).alias("had"), sums(F.col("digest"), change).alias("change"))
    vectors = found.select(*keys, "n_chars", "edited_sha256", _reduced(F.col("had")).alias("v"), plus(F.col("had"), F.col("change")).alias("e"))
    beside = vectors.withColumn("after", F.lead("v").over(_order())).where("NOT end")
    return beside.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("after")).alias("near_next"),
    )
