"""Merkle manifest of a dataset, with the authentication path of every row.

Leaves are numbered within their source by a range partitioning. Nodes are made bottom up, three levels at a time: an
aligned block of 4,096 nodes goes to one place and comes out as one node. Paths are made top down by fractal traversal: a
task walks through the nodes of a block in order and holds, for each level, the existing subtree, which is the run of
siblings that the path passes, and the desired one, which grows by one node of the level below for each path emitted and is
complete when it is needed. So a walk holds a few hundred digests whatever the size of the data. The path above the block's
own node, made the same way from the blocks above, is appended to each path as it is emitted; paths of rows are hashed and
folded at once and never written.
"""

from __future__ import annotations

import hashlib
import string
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settle
from .sharding import numbered

#: Nodes of a run, and levels of a block.
ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _h(inputs: Column) -> Column:
    return F.sha2(inputs.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: each value is `-` if null, else its length in UTF-8, a colon and the value."""
    def part(v: Column) -> Column:
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return _h(F.concat(*map(part, values)))


# ---- numbers and nodes


def _leaves(docs: DataFrame) -> DataFrame:
    """One row per document: grp, idx (its number in the source), n (leaves of the source), doc_id, digest, forged.

    ``forged`` is the digest of the row with A-Z lower-cased in its text, where 5 divides the checksum of its id.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    marked = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null before all others
    rows = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*columns, text).alias("digest"), F.when(marked, leaf_digest(*columns, lowered)).alias("forged"))
    order = ["grp", "doc_id", "digest"]
    dealt = settle(rows.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "leaves")
    # at most a row for each source and one more for each range
    counts = dealt.groupBy(F.col("grp").alias("of"), F.col("part").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("of").orderBy("at")
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("of", "at", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("of")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)) - 1
    placed = dealt.withColumn("inside", inside).join(offsets, (F.col("grp") == F.col("of")) & (F.col("part") == F.col("at")))
    return placed.select("grp", (F.col("ahead") + F.col("inside")).alias("idx"), "n", "doc_id", "digest", "forged")


def _run(n: Column) -> Column:
    """An aggregate: the digests of a run of sixteen at most, in order, and the node over them where ``n`` isn't one."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
    return F.struct(kids.alias("kids"), F.when(n == 1, kids[0]).otherwise(_h(F.array_join(kids, ""))).alias("digest"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """The nodes over blocks, as nodes: grp, idx, n, digest, with the block's height and the nodes below its top.

    ``n`` counts the nodes of grp. A group of sixteen nodes or fewer has one level, one of a single node none. All three
    levels are made where the block is: one shuffle.
    """
    n1, n2 = F.ceil(F.col("n") / ARITY), F.ceil(F.col("n") / ARITY**2)
    dealt = nodes.select("grp", "n", "idx", "digest", F.floor(F.col("idx") / BLOCK).alias("block")).repartition("grp", "block")
    one = dealt.groupBy("grp", "block", "n", F.floor(F.col("idx") / ARITY).alias("i")).agg(_run(F.col("n")).alias("r")).select("grp", "block", "n", F.col("i").alias("idx"), "r.digest")
    two = one.groupBy("grp", "block", "n", F.floor(F.col("idx") / ARITY).alias("i")).agg(_run(n1).alias("r")).select("grp", "block", "n", F.col("i").alias("idx"), "r.digest", "r.kids")
    first = F.min_by("kids", "idx")  # where there are two levels, there is one run of the second
    three = two.groupBy("grp", "block", "n").agg(_run(n2).alias("r"), first.alias("kids"))
    height = (F.col("n") > 1).cast("int") + (F.col("n") > ARITY).cast("int") + (F.col("n") > ARITY**2).cast("int")
    top = F.when(F.col("n") > ARITY**2, F.col("r.kids")).when(F.col("n") > ARITY, F.col("kids"))
    return three.select("grp", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), "r.digest", height.alias("height"), top.alias("top"))


def _tower(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables of nodes, each over the blocks of the one before, until every group has one node; settled."""
    tables = [nodes]
    while len(tables) == 1 or most > 1:
        tables.append(settle(_blocks(tables[-1]), "nodes"))
        most = -(-most // BLOCK)
    return tables


# ---- traversal


def paths(digests: Iterator[str], height: int, top: list[str] | None) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each node of a block in order, from below: what is left and right of it at each level.

    ``top`` are the nodes just below the block's own, if there are more levels than one. Each level keeps the existing
    subtree (its first sixteen nodes) and what has come of the desired one (the rest).
    """
    if height == 0:
        for _ in digests:
            yield []
        return
    levels: list[deque[str]] = [deque() for _ in range(height)]
    tops = iter(top or ())
    if top:
        levels[-1].extend(top)
    open_runs: list[list[str]] = [[] for _ in range(height - 1)]  # of a level, what the next node above will be made from
    ended = False

    def close(k: int) -> None:
        node = sha256("".join(open_runs[k]))
        open_runs[k] = []
        if k + 1 == height - 1:
            if node != next(tops, None):
                raise ValueError("nodes differ from those made bottom up")
            return
        levels[k + 1].append(node)
        open_runs[k + 1].append(node)
        if len(open_runs[k + 1]) == ARITY:
            close(k + 1)

    def take() -> None:
        """One more node from below, for the desired subtrees; at the end, what is open is closed."""
        nonlocal ended
        if ended:
            return
        if (one := next(digests, None)) is not None:
            levels[0].append(one)
            if height > 1:
                open_runs[0].append(one)
                if len(open_runs[0]) == ARITY:
                    close(0)
            return
        ended = True
        for k in range(height - 1):
            if open_runs[k]:
                close(k)

    ahead = ARITY ** max(1, height - 1)
    for _ in range(ahead):
        take()
    sides: list[tuple[str, str]] = [("", "")] * height
    i = 0
    while levels[0]:
        for k in range(height):
            below = ARITY**k
            if i % below:
                break
            place = i // below % ARITY
            if place == 0 and i:
                for _ in range(ARITY):
                    levels[k].popleft()
                if not levels[0]:
                    return
            run = [levels[k][j] for j in range(min(ARITY, len(levels[k])))]
            if place >= len(run):
                return
            sides[k] = "".join(run[:place]), "".join(run[place + 1 :])
        take()
        yield list(sides)
        i += 1


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = sha256(left + digest + right)
    return digest


def _packed(path: list[tuple[str, str]]) -> str:
    return "/".join(f"{left}.{right}" for left, right in path)


def _unpacked(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split(".")) for level in path.split("/")] if path else []


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PATH = "grp string, idx long, path string"
_FIELDS = ("grp", "block", "idx", "doc_id", "digest", "forged", "height", "top", "above", "subroot", "root")


class _Block:
    """The nodes of one block from a stream of rows that starts with the block's own row."""

    def __init__(self, head: tuple, rows: Iterator[tuple]) -> None:
        self.head, self.rows, self.held, self.following = head, rows, deque(), None

    def digests(self) -> Iterator[str]:
        for row in self.rows:
            if row[:2] != self.head[:2]:
                self.following = row
                return
            self.held.append(row)
            yield row[4]

    def __iter__(self) -> Iterator[tuple[tuple, list]]:
        height, top = self.head[6:8]
        for path in paths(self.digests(), height, top):
            yield self.held.popleft(), path


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    head = next(rows, None)
    while head is not None:
        if head[2] != -1:
            raise ValueError("a block came without its own row")
        block = _Block(head, rows)
        yield block
        head = block.following


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _emit_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("path", pa.string())])

    def rows() -> Iterator[tuple]:
        for block in _blocks_of(batches):
            above = block.head[8]
            for row, path in block:
                yield row[0], row[2], "/".join(p for p in (_packed(path), above) if p)

    return _batches(rows(), schema)


def _emit_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = pa.string()
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", text), ("subroot", text), ("root", text), ("proof_sha256", text), ("folded_root", text), ("verified", pa.bool_())])

    def rows() -> Iterator[tuple]:
        for block in _blocks_of(batches):
            above, subroot, root = block.head[8:]
            upper, rest = _unpacked(above), above.replace("/", "").replace(".", "")
            known: dict[str, str] = {}  # the root over the block's untampered node
            for row, path in block:
                doc_id, leaf, forged = row[3:6]
                proof = sha256("".join(side for level in path for side in level) + rest)
                node = fold(forged or leaf, path)
                folded = known.get(node) or fold(node, upper)
                if forged is None or forged == leaf:
                    known[node] = folded
                yield doc_id, leaf, subroot, root, proof, folded, folded == root

    return _batches(rows(), schema)


def _walk(nodes: DataFrame, heads: DataFrame, emit, schema: str) -> DataFrame:
    """The traversal of all blocks of ``nodes``; ``heads`` has each block's row with the path above it."""
    def fill(df: DataFrame, **have: Column) -> DataFrame:
        types = dict(zip(_FIELDS, "string long long long string string int array<string> string string string".split(), strict=True))
        return df.select(*[have.get(f, F.lit(None)).cast(types[f]).alias(f) for f in _FIELDS])

    leaves = fill(nodes, block=F.floor(F.col("idx") / BLOCK), **{f: F.col(f) for f in ("grp", "idx", "doc_id", "digest", "forged") if f in nodes.columns})
    own = fill(heads, block=F.col("idx"), idx=F.lit(-1), **{f: F.col(f) for f in ("grp", "height", "top", "above", "subroot", "root") if f in heads.columns})
    return leaves.unionByName(own).repartition("grp", "block").sortWithinPartitions("grp", "block", "idx").mapInArrow(emit, schema)


def _down(tower: list[DataFrame], topmost: DataFrame) -> DataFrame:
    """From the paths of a tower's last nodes (grp, idx, above, and what else is to come along by grp) to the row of each
    block of its first nodes."""
    heads = topmost
    for nodes, below in zip(tower[:0:-1], tower[-2::-1], strict=True):
        placed = nodes.join(heads, ["grp", "idx"])
        if below is tower[0]:
            return placed
        more = [c for c in topmost.columns if c not in ("grp", "idx", "above")]
        found = settle(_walk(below, placed, _emit_paths, _PATH), "paths").withColumnRenamed("path", "above")
        heads = found.join(topmost.select("grp", *more), "grp") if more else found
    raise AssertionError("a tower has two tables or more")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text; leaves of a source ascend by doc_id (null first, equal
    ids by their digests; wholly equal rows are leaves each). Null source is a source, the first. Runs of sixteen nodes
    become one until one is left, in each source and then over the sources' subroots. ``folded_root`` is recomputed from
    the tampered leaf, where the row is one of those that tampering touches, and the original siblings. A null id is not
    tampered with; a text without A-Z, empty and null ones too, stays as it is, so it verifies. Very long texts are hashed
    as a whole. No rows: no rows. Extra columns are ignored. A source with most of the rows is split into blocks.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], _PROOF)
    leaves = settle(_leaves(docs), "numbered-leaves")
    sources = _tower(leaves, leaves.agg(F.max("n")).first()[0])
    subroots = sources[-1].select(F.col("grp").alias("source"), F.col("digest"))
    count = subroots.count()
    ranked = settle(numbered(subroots, ["source"]).select(F.lit("").alias("grp"), F.col("row_number").cast("long").alias("idx"), F.lit(count).cast("long").alias("n"), "digest", "source"), "subroots")
    all_ = _tower(ranked, count)
    root = all_[-1].first()["digest"]
    heads = _down(all_, spark.createDataFrame([("", 0, "")], "grp string, idx long, above string"))
    of_sources = settle(_walk(ranked, heads, _emit_paths, _PATH), "paths-of-sources")
    above = of_sources.join(ranked.select("idx", "source", F.col("digest").alias("subroot")), "idx")
    topmost = above.select(F.col("source").alias("grp"), F.lit(0).cast("long").alias("idx"), F.col("path").alias("above"), "subroot", F.lit(root).alias("root"))
    return _walk(leaves, _down(sources, settle(topmost, "tops")), _emit_proofs, _PROOF)
