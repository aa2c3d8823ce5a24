"""Registered queries of the corpus operators, with their parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, common, exact_dedup, html_extract, line_dedup, merkle, mixing, multiset_hash, ngram_join, quality_rules, sharding, sort_means,
    token_counts, token_output,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark, "tokens")
    return token_output.token_files(_documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json")).drop("file")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir)).drop("row_number")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_documents(spark, sf_dir)).drop("source")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_documents(spark, sf_dir), words=4, threshold=85).drop("class_id")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), clusters=40, rounds=5, seed=2)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited(_documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mix_sources, op2_token_files, op3_byte_bpe, op4_line_dedup, op5_token_counts, op6_shard, op7_html_text, op8_quality_rules,
        op9_exact_dedup, op10_ngram_join, op11_sort_means, op12_fingerprints, op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
x AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM w),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM x),
c AS (SELECT *, (budget - filled) * weight >= 2.0::DOUBLE * source_size * open_weight AS capped FROM f),
t AS (SELECT source, source_size, CAST(CASE WHEN capped THEN 2.0::DOUBLE * source_size
    ELSE (budget - coalesce(sum(CASE WHEN capped THEN 2.0::DOUBLE * source_size END) OVER (), 0)) * weight / coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 1) END AS DOUBLE) AS target FROM c),
k AS (SELECT d.*, t.source_size, t.target, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS key
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(floor(target) AS BIGINT) AS whole FROM k)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
    CAST(whole // source_size * size + greatest(0, least(size, whole % source_size - start)) AS BIGINT) END AS taken FROM p
"""

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
b AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 7]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM v WHERE n > 1) GROUP BY doc_id),
m AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM b LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f GROUP BY source),
a AS (SELECT sum(n)::DOUBLE AS n, sum(k) / sum(n)::DOUBLE AS mean, count(*) AS hosts, sum(k * k / n::DOUBLE) AS squares FROM h),
q AS (SELECT mean, mean * (1 - mean) AS chance, squares / n - mean * mean - mean * (1 - mean) * hosts / n AS spread FROM a),
s AS (SELECT mean, CASE WHEN spread * 10001 > chance THEN greatest(1.0, chance / spread - 1) ELSE 10000.0 END AS strength FROM q),
o AS (SELECT h.source, (k + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM d
"""


def _network(source: str) -> str:
    """A query that passes ``x`` of each row once through the network of sharding.once(); b is taken from the row."""
    query = f"SELECT * EXCLUDE x, x // b AS l, x % b AS r FROM ({source})"
    for i, (k1, k2, k3) in enumerate(sharding.round_keys("shard")):
        half = "r" if i % 2 == 0 else "l"
        turned = "REPLACE ((l + y) % a AS l)" if i % 2 == 0 else "REPLACE ((r + y) % b AS r)"
        prime = sharding.PRIME
        query = f"SELECT *, ({half} * {k1} + {k2}) % {prime} AS y FROM ({query})"
        query = f"SELECT * REPLACE ((y * y + {k3}) % {prime} AS y) FROM ({query})"
        query = f"SELECT * REPLACE ((y * y + {k2}) % {prime} AS y) FROM ({query})"
        query = f"SELECT * EXCLUDE y {turned} FROM ({query})"
    return f"SELECT * EXCLUDE (l, r), l * b + r AS x FROM ({query})"


#: CRC-32 byte by byte, from the table of its polynomial.
_CRC_TABLE = """e AS (SELECT i, 0 AS k, i::BIGINT AS x FROM range(256) q(i)
    UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM e WHERE k < 8),
t AS (SELECT list(x ORDER BY i) AS t FROM e WHERE k = 8)"""


def _crc(text: str) -> str:
    found = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda c: ('0x' || c)::BIGINT)"
    return f"xor(list_reduce({found}, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT"


#: The network goes on until each number is below n.
OP6_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
s AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, t),
c AS (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS root FROM documents),
f AS (SELECT n, a, (n + a - 1) // a AS b FROM c, range(2001) q(i), LATERAL (SELECT root - i AS a) WHERE a >= 1 ORDER BY a * ((n + a - 1) // a), a DESC LIMIT 1),
o AS (SELECT s.*, n, a, b, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x FROM s, f),
w AS ({_network("SELECT * FROM o")} UNION ALL {_network("SELECT * FROM w WHERE x >= n")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 40 AS INT) AS shard, CAST(x // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM w WHERE x < n
"""


#: All pairs that share a shingle, and what links reach from each document.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
y AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, e) AS s FROM g WHERE e IS NOT NULL OR i = 1),
n AS (SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 85 * (u.n + v.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN r ON a = doc_id GROUP BY doc_id, n
"""


def _centroid_rounds(rounds: int) -> str:
    """Every distance of each round: vectors a{r} with their nearest centroids c{r}, and the means of those."""
    found = []
    for r in range(rounds + 1):
        found.append(f"""s{r} AS MATERIALIZED (SELECT vec_id, c, CAST(sum((x.v - k.v) * (x.v - k.v)) AS BIGINT) AS distance FROM x JOIN c{r} k USING (d) GROUP BY vec_id, c),
a{r} AS MATERIALIZED (SELECT * FROM s{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)""")
        if r < rounds:
            found.append(f"""m{r} AS (SELECT c, d, sum(v) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY c, d),
c{r + 1} AS MATERIALIZED (SELECT c, d, CAST(coalesce((s - ((s % n) + n) % n) // n, v) AS BIGINT) AS v FROM c{r} LEFT JOIN m{r} USING (c, d))""")
    return ",\n".join(found)


OP11_SQL = f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS d, unnest(v) AS v FROM k),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM k),
c0 AS MATERIALIZED (SELECT c, d, v FROM f JOIN x USING (vec_id) WHERE c < 40),
{_centroid_rounds(5)},
h AS (SELECT c, sha256(string_agg(v, ',' ORDER BY d)) AS centroid_sha256 FROM c5 GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a5 JOIN h USING (c)
"""


def _levels(first: str, name: str, levels: int) -> str:
    """Nodes {name}{l} of each level over ``first``, which has g, i, n and d, and their runs {name}r{l}."""
    found = [f"{name}0 AS (SELECT g, i, n, d FROM {first})"]
    for at in range(levels):
        found.append(f"{name}r{at} AS MATERIALIZED (SELECT g, i // 16 AS j, n, list(d ORDER BY i) AS run FROM {name}{at} GROUP BY g, j, n)")
        found.append(f"{name}{at + 1} AS (SELECT g, j AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(list_aggregate(run, 'string_agg', '')) END AS d FROM {name}r{at})")
    return ",\n".join(found)


def _climb(source: str, name: str, levels: int, group: str, place: str) -> str:
    """``source`` with the siblings of each level added to its proof, and its folded digest."""
    for at in range(levels):
        joined = f"SELECT q.*, n AS many, list_aggregate(run[:k], 'string_agg', '') AS l, list_aggregate(run[k + 2:], 'string_agg', '') AS r FROM (SELECT *, {place} // {16**at} % 16 AS k FROM ({source})) q JOIN {name}r{at} w ON w.g = {group} AND w.j = {place} // {16 ** (at + 1)}"
        step = "SELECT * REPLACE (CASE WHEN many = 1 THEN folded ELSE sha256(coalesce(l, '') || folded || coalesce(r, '')) END AS folded, proof || coalesce(l, '') || coalesce(r, '') AS proof)"
        source = f"SELECT * EXCLUDE (k, many, l, r) FROM ({step} FROM ({joined}))"
    return source


def _part(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_part, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Six levels hold sources of 16 million rows, and as many sources.
OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
b AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS d, {_crc("doc_id::VARCHAR")} % 5 = 0 AS touched, {_leaf(_LOWERED)} AS low FROM documents, t),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM b),
{_levels("a", "x", 6)},
o AS MATERIALIZED (SELECT '' AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d FROM x6),
{_levels("o", "y", 6)},
l AS (SELECT doc_id, a.g, a.i, a.d AS leaf, o.d AS subroot, y6.d AS root, o.i AS rank, CASE WHEN touched THEN low ELSE a.d END AS folded, '' AS proof FROM a JOIN o ON a.g = o.source, y6)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM ({_climb(_climb("SELECT * FROM l", "x", 6, "q.g", "i"), "y", 6, "''", "rank")})
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL, "op6_shard": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op10_ngram_join": OP10_SQL,
        "op11_sort_means": OP11_SQL, "op13_merkle_manifest": OP13_SQL,
    }
