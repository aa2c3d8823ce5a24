import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, multiset_hash as m


def numbers(piece):
    digest = hashlib.sha256(piece.encode()).hexdigest()
    h = lambda label: xxhash.xxh64_intdigest(digest, seed=xxhash.xxh64_intdigest(label, seed=42))
    tallies = [h(f"tallies {i}") for i in range(m.PACKED // 32)]
    return [1, *(h(f"seal {i}") % 2**32 for i in range(m.SEALS)), *((b >> i & 1) + ((b >> i + 32 & 1) << m.WIDTH) for b in tallies for i in range(32))]


def vector(text):
    pieces = [p for p in re.split(m.BETWEEN, text or "") if p]
    v = [sum(c) for c in zip(*map(numbers, pieces), strict=True)] or [0] * (1 + m.SEALS + m.PACKED)
    return [x % 2**32 if 0 < i <= m.SEALS else x for i, x in enumerate(v)]


def written_out(v):
    return "".join(f"{x:0{8 if i <= m.SEALS else 16}x}" for i, x in enumerate(v))


def alike(a, b):
    if a == b:
        return 1.0
    def signs(v):
        return [2 * t - v[0] for x in v[1 + m.SEALS :] for t in (x % 2**m.WIDTH, x >> m.WIDTH)]
    x, y = signs(a), signs(b)
    every = sum(p * p + q * q for p, q in zip(x, y, strict=True))
    return min(1.0, max(0.0, 2 * sum(p * q for p, q in zip(x, y, strict=True)) / every))


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edit = text[: len(text) - cut] + after[:cut]
        v, e = vector(text), vector(edit)
        out.append((i, len(text), hashlib.sha256(edit.encode()).hexdigest(), written_out(v), written_out(e), alike(v, e), alike(v, vector(after))))
    return out


def got(df):
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return [tuple(r[c] for c in columns) for r in df.collect()]


def same(a, b):
    a, b = sorted(a, key=repr), sorted(b, key=repr)
    assert [r[:5] for r in a] == [r[:5] for r in b]
    assert all(x[5:] == pytest.approx(y[5:], abs=1e-9) for x, y in zip(a, b, strict=True))


def test_all_documents_by_brute_force(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    same(got(m.edited(documents)), expected(rows))
    plain = {r.doc_id: r.fingerprint for r in m.fingerprints(documents).collect()}
    assert plain == {i: written_out(vector(t)) for i, t in rows}


def test_odd_documents_by_brute_force(spark, odd):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    same(got(m.edited(odd)), expected(rows))


@pytest.mark.parametrize("ids", [[5], [5, 2], list(range(40, 0, -1))])
@pytest.mark.parametrize("parts", [1, 5])
def test_few_documents(spark, ids, parts):
    texts = [f"Line {i}.  And more!\n\nlast of {i % 3}" for i in ids]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(parts)
    same(got(m.edited(docs)), expected(sorted(zip(ids, texts, strict=True))))


def test_no_documents(spark, none):
    assert got(m.edited(none)) == []


def test_repeated_and_null_ids_are_documents_each(spark):
    docs = spark.createDataFrame([(1, "a\nb")] * 3 + [(None, "c")] * 30 + [(None, None)] * 30, "doc_id long, text string")
    rows = m.edited(docs).collect()
    assert Counter(r.doc_id for r in rows) == {1: 3, None: 60}
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert all(r.fingerprint == "0" * len(r.fingerprint) for r in rows if r.n_chars == 0)


def test_order_does_not_matter_and_parts_come_and_go(spark):
    a, b = "one\ntwo\nthree\ntwo", "two\nthree\ntwo\none"
    rows = spark.createDataFrame([("a", a), ("b", b), ("part", "two\nfour"), ("rest", "three\none\ntwo"), ("more", "four\n" + a)], "name string, text string")
    pieces = rows.select("name", F.explode(m.paragraphs(F.col("text"))).alias("p"))
    v = {r.name: r.v for r in pieces.groupBy("name").agg(m.sums(F.sha2(F.col("p").cast("binary"), 256), F.lit(1)).alias("v")).collect()}
    one = spark.createDataFrame([v], ", ".join(f"{k} array<long>" for k in v))
    out = one.select(
        (m.plus(F.col("a"), F.lit([0] * 73)) == m.plus(F.col("b"), F.lit([0] * 73))).alias("order"),
        (m.minus(m.plus(F.col("rest"), F.col("part")), m.minus(F.col("more"), F.col("a"))) == m.plus(F.col("a"), F.lit([0] * 73))).alias("moves"),
        (m.from_text(m.as_text(m.plus(F.col("a"), F.lit([0] * 73)))) == m.plus(F.col("a"), F.lit([0] * 73))).alias("text"),
    ).first()
    assert out.order and out.moves and out.text


def test_likeness_is_about_the_common_part(spark):
    base = [f"sentence number {i} of this text" for i in range(200)]
    docs = [("\n".join(base), "\n".join(base[:k] + [f"other {i}" for i in range(200 - k)]), k / 200) for k in (0, 50, 100, 150, 190, 200)]
    for a, b, share in docs:
        assert alike(vector(a), vector(b)) == pytest.approx(share, abs=0.2)


def test_ranges_find_every_row(spark, tmp_path):
    ids = [i * i % 97 for i in range(300)]
    spark.createDataFrame([(i, f"{i}") for i in ids], "doc_id long, text string").repartition(6).write.parquet(f"file://{tmp_path}/d")
    rows = m._with_next(m._keyed(common.located(spark.read.parquet(f"file://{tmp_path}/d")))).where("NOT end").collect()
    order = sorted(rows, key=lambda r: (r.id, r.tie))
    assert [r.next for r in order] == [r.text for r in order[1:]] + [order[0].text]
    assert all(a.part <= b.part for a, b in zip(order, order[1:], strict=False)) and len({r.part for r in order}) > 1
