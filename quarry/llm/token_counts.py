"""Token counts of documents by counting each distinct pre-token once.

Documents are gathered into blocks of a few megabytes. A block has its distinct pre-tokens, dealt into buckets by a
hash, and how often each of its documents has each of them. A bucket brings together the pre-tokens of all blocks; the
tokenizer's library counts the pieces of each distinct one once. The counts go back to the blocks and are added up by
document. Token ids are never kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle
from .tokenizers_io import word_encoder

#: Bytes of text and documents after which a block ends. A longer document is a block alone.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 20_000
_BLOCK = "block long, doc_ids array<long>, n_bytes array<long>, uses binary, parts array<struct<bucket: int, tokens: binary>>"
_ARROW = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("uses", pa.binary()),
    ("parts", pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary())]))),
])


def pack_uses(ends: np.ndarray, codes: np.ndarray, times: np.ndarray) -> bytes:
    """Documents' ends in the two lists, pre-token numbers and frequencies, by byte planes so that zeros compress."""
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (codes, times)]
    return np.array([len(ends), len(codes)], "<u4").tobytes() + zlib.compress(ends.astype("<u4").tobytes() + b"".join(planes), 1)


def unpack_uses(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = map(int, np.frombuffer(data, "<u4", 2))
    raw = np.frombuffer(zlib.decompress(data[8:]), np.uint8)
    ends = raw[: 4 * n].view("<u4")
    codes, times = (np.ascontiguousarray(x.reshape(4, m).T).view("<u4").ravel() for x in (raw[4 * n : 4 * (n + m)], raw[4 * (n + m) :]))
    return ends, codes, times


def _blocks(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(number: int, ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        index: dict[bytes, int] = {}
        code = index.setdefault
        codes = [np.fromiter([code(w, len(index)) for w in t.split()], np.int64) for t in texts]
        tokens = list(index)
        bucket = np.fromiter(map(zlib.crc32, tokens), np.int64, len(tokens)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        width = max(1, len(tokens))
        keys, times = np.unique(np.concatenate([place[c] + i * width for i, c in enumerate(codes)]), return_counts=True)
        ends = np.searchsorted(keys, (np.arange(len(texts)) + 1) * width)
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
        parts = [{"bucket": int(bucket[order[a]]), "tokens": zlib.compress(b"\n".join([tokens[i] for i in order[a:b].tolist()]))} for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        return pa.RecordBatch.from_pydict({"block": [number], "doc_ids": [ids], "n_bytes": [[len(t) for t in texts]], "uses": [pack_uses(ends, keys % width, times)], "parts": [parts]}, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or b"")
                held += len(texts[-1])
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield block(number, ids, texts)

    return run


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a bucket follow one another; its distinct pre-tokens are remembered until the next bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bucket, known = word_encoder(path).counts, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                if row["bucket"][0] != bucket:
                    bucket, known = row["bucket"][0], {}
                tokens = zlib.decompress(row["tokens"][0]).split(b"\n")
                new = [t for t in tokens if t not in known]
                known.update(zip(new, counts(new), strict=True))
                n = np.fromiter(map(known.__getitem__, tokens), "<u4", len(tokens))
                yield pa.RecordBatch.from_pydict({"block": row["block"], "bucket": row["bucket"], "counts": [zlib.compress(n.tobytes(), 1)]}, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())]))

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, sizes, uses, found = (batch.column(c)[i] for c in range(4))
            ends, codes, times = unpack_uses(uses.as_py())
            n = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(zlib.decompress(x["counts"]), "<u4") for x in found.as_py() or []]]).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(n[codes] * times)))
            bounds = np.concatenate(([0], ends))
            yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(np.diff(sums[bounds]).astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a vocabulary of the tokenizers library whose pre-tokens never span an ASCII space; a pre-token here is a
    maximal run without one. Null text counts as empty: no tokens. Repeated rows are counted each. No rows: no rows. Extra
    columns are ignored. A pre-token that all blocks have costs one row per block, so no key is hot by documents.
    """
    if not path.endswith(".json"):
        raise ValueError("a .json vocabulary of the tokenizers library is expected")
    n = partitions(docs.sparkSession)
    blocks = settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(2 * n), _BLOCK), "blocks")
    dealt = blocks.select("block", F.explode("parts").alias("part")).select("block", "part.bucket", "part.tokens").repartition(n, "bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(_pieces(path), "block long, bucket int, counts binary")
    found = counted.groupBy(F.col("block").alias("of")).agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("found"))
    sums = blocks.join(found, F.col("block") == F.col("of"), "left").select("doc_ids", "n_bytes", "uses", "found")
    return sums.mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
