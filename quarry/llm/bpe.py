"""Byte-level BPE by ranks: encoding and decoding.

A pre-token that is in the vocabulary as a whole is resolved by one probe of a minimal perfect hash. Others start as a
linked list of their bytes; a heap gives the adjacent pair of lowest rank, leftmost first, until no pair has a rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens a worker remembers, the longest remembered one in bytes, and remembered pairs of ids.
MEMO_TOKENS, MEMO_BYTES, MEMO_PAIRS = 600_000, 64, 300_000


class PerfectHash:
    """Slots 0 to n - 1 for n byte strings, one each. A bucket keeps the seed that sends its keys to free slots."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        groups: dict[int, list[bytes]] = {}
        for key in keys:
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        self.seed = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        free = None
        for bucket, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(group) == 1:  # what is left takes the free slots as they come, as negative numbers
                free = free or iter([i for i, k in enumerate(self.keys) if k is None])
                slot = next(free)
                self.seed[bucket], self.keys[slot] = -slot - 1, group[0]
                continue
            seed = 1
            while True:
                slots = {xxhash.xxh3_64_intdigest(k, seed) % self.n for k in group}
                if len(slots) == len(group) and all(self.keys[s] is None for s in slots):
                    break
                seed += 1
            self.seed[bucket] = seed
            for k in group:
                self.keys[xxhash.xxh3_64_intdigest(k, seed) % self.n] = k

    def slot(self, key: bytes) -> int:
        """The slot of a key, -1 if it is none of the keys."""
        if not self.n:
            return -1
        seed = self.seed[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return slot if self.keys[slot] == key else -1


def narrow(pattern: str) -> str:
    """The pattern for texts without characters above U+00FF: classes are spelled out, as the standard library needs it."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        found = regex.match(r"\\[pP]\{\w+\}|\\[sS]", pattern[i:])
        if not found:
            step = 2 if pattern[i] == "\\" else 1
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i : i + step])
            i += step
            continue
        name, negated = found[0], found[0] in ("\\S",) or found[0].startswith("\\P")
        if inside and negated:
            raise ValueError("a negated class within brackets")
        members = "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)) and not negated or negated and not regex.match(name, chr(c)))
        out.append(members if inside else f"[{'^' * negated}{members}]")
        i += len(name)
    return "".join(out)


class ByteBPE:
    """Encoder and decoder for a rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.hash = PerfectHash(list(ranks))
        self.rank_at = [ranks[k] for k in self.hash.keys]
        self.bytes_of = {r: k for k, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.wide, self.narrow = regex.compile(pattern).findall, re.compile(narrow(pattern)).findall
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        size = max(self.bytes_of) + 1
        self.length = np.array([len(self.bytes_of.get(r, b"")) for r in range(size)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(r, b"") for r in range(size)), np.uint8)

    def rank(self, piece: bytes) -> int:
        """The rank of a vocabulary entry, -1 for other strings."""
        if len(piece) > self.longest:
            return -1
        slot = self.hash.slot(piece)
        return self.rank_at[slot] if slot >= 0 else -1

    def pair(self, key: int) -> int:
        """The rank of two entries joined; key is left << 32 | right."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        rank = self.pairs[key] = self.rank(self.bytes_of[key >> 32] + self.bytes_of[key & 0xFFFFFFFF])
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging from its bytes. The heap holds rank * length + place of the left part."""
        n, known, learn = len(piece), self.pairs.get, self.pair
        ids = list(map(self.single.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            key = ids[i] << 32 | ids[i + 1]
            rank = known(key)
            if rank is None:
                rank = learn(key)
            if rank >= 0:
                heap.append(rank * n + i)
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            key = ids[i] << 32 | ids[j]
            now = known(key)
            if (learn(key) if now is None else now) != rank:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                key = rank << 32 | ids[k]
                now = known(key)
                if now is None:
                    now = learn(key)
                if now >= 0:
                    heapq.heappush(heap, now * n + i)
            h = before[i]
            if h >= 0:
                key = ids[h] << 32 | rank
                now = known(key)
                if now is None:
                    now = learn(key)
                if now >= 0:
                    heapq.heappush(heap, now * n + h)
        return [x for x in ids if x >= 0]

    def lookup(self, token: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        piece = token.encode()
        whole = self.rank(piece)
        ids = whole.to_bytes(4, "little") if whole >= 0 else np.array(self.merge(piece), "<u4").tobytes()
        if len(piece) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_TOKENS:
                self.memo.clear()
            self.memo[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, lookup = self.memo.get, self.lookup
        tokens = (self.narrow if max(text, default="") <= "\xff" else self.wide)(text)
        return b"".join([known(t) or lookup(t) for t in tokens])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, one id's after another."""
        which = np.frombuffer(ids, "<u4")
        sizes = self.length[which]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.flat[np.repeat(self.start[which] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """This worker's coder for a rank file."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
    return _coders[path, pattern]


def _encode(path: str, pattern: str, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts, n, sha, back, kept = batch.column(1), [], [], [], []
            for text in texts:
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<i4"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {}))

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) if asked for.

    Special strings in a text are ordinary text. Null text counts as empty: no ids. Repeated rows are coded each. No rows:
    no rows. Extra columns are ignored. Decoding the ids gives the text's bytes back.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(path, pattern, keep_ids), schema)
