"""Exact similarity join of sets of word shingles.

A record is a whole text or a line. Its tokens are its distinct k-word shingles, as 48-bit hashes; records with equal
sets are one node. Two nodes are similar if 100 * intersection >= threshold * union. The steps, each over all records:

1. ``scan``: every record's node, size and parity bitmap, and the frequencies of all shingles.
2. ``frequent``: the frequent shingles with the power of two that their frequency reaches. Their number has a fixed
   bound (the lower limit of frequency rises until they fit), so they can be sent to all workers.
3. ``signatures``: shingles stand in one order of rarity for all nodes: rare ones by hash, then frequent ones by
   frequency. A node's prefix is just long enough that two similar nodes must share what it is indexed by. Rarer shingles
   are indexed alone. Those of a frequent class are indexed in combinations of two, very frequent ones of three, for
   which the prefix is extended; the number of classes goes with the size of the set (``schemes``).
4. ``candidates``: nodes under one rare shingle (few, by its frequency) pair up in the task that gathers them, with
   length and positional filters; a group that is large nevertheless joins the frequent ones. Frequent signatures stay
   rows: small groups pair up by a join that Spark can split; in large groups every node meets pivots, and only nodes
   that these leave open meet the others of a like size.
5. ``verified``: pairs that pass the bitmap bound are verified on the sets themselves.

A node is numbered by 64 bits of a 128-bit hash of its set. The other 64 are compared among all records of a number, and
sets that share a number are renumbered, so that sets are told apart by 128 bits. A set of one shingle is hashed by its
words. Two differing shingles of a pair of n-shingle sets coincide in 48 bits with a probability of about n * n / 2**48.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, place_in_files, settle, settle_buckets

BITS = 48
_MASK = np.uint64((1 << BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Frequency from which a shingle may count as frequent, and the bound on how many do.
LEAST_FREQUENT, MOST_FREQUENT = 8, 4_000_000
#: Levels (powers of two of the frequency) from which shingles are indexed in combinations of two and of three.
PAIRED_LEVEL, TRIPLE_LEVEL = 6, 12
LAST = 63
#: Slots in which a task remembers nodes, so that local copies are emitted once; shingles that are sorted at once.
SEEN, SORTED = 1 << 17, 1_000_000
#: Nodes under a signature up to which all of them pair up; nodes of a small and of a wide part of a larger group, which
#: have a pivot each.
LARGE, PART, WIDE = 64, 64, 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Kind:
    """What is compared: lines or whole texts, words per shingle, the threshold in percent, and whether A-Z are folded.

    ``short`` says that a text with fewer words is one token as a whole; otherwise it has none. ``clash`` has the numbers
    that differing sets share, and ``bits`` how many bits of a hash make a number (fewer in tests).
    """

    lines: bool
    words: int
    threshold: int
    fold: bool
    short: bool
    bitmap: int
    clash: frozenset[int] = frozenset()
    bits: int = 64

    @property
    def smallest(self) -> int:
        """The smallest set that can be similar to a different one."""
        return -(-self.threshold // (100 - self.threshold))


#: Bytes of a text that are hashed at once; a longer text is cut at spaces.
_PIECE = 1 << 20
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _solid(data: np.ndarray) -> np.ndarray:
    """Which bytes are none of the six ASCII spaces."""
    return (data - np.uint8(9) > 4) & (data != 32)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, min(2 * n, _PIECE))
        _powers = tuple(np.full(size, base, np.uint64) for base in (_BASE, _INVERSE))
        for x in _powers:
            x[0] = 1
            np.cumprod(x, out=x)
    return _powers


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where words start, and 64-bit hashes of the words, of texts that lie between bounds in one array of bytes."""
    found, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data):  # back to the last space, or on to the next one
            space = np.flatnonzero(~_solid(data[at:end]))
            while not len(space) and end < len(data):
                begin, end = end, min(end + _PIECE, len(data))
                space = np.flatnonzero(~_solid(data[begin:end])) + (begin - at)
            end = at + int(space[-1]) + 1 if len(space) else end
        inner = bounds[np.searchsorted(bounds, at, side="right") : np.searchsorted(bounds, end)] - at
        starts, h = _words(data[at:end], inner)
        found.append((starts + at, h))
        at = end
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _words(data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is a polynomial of its bytes in the base, from differences of running sums to which spaces add none."""
    solid = _solid(data)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[inner] |= solid[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    power, inverse = _power(len(data))
    sums = ((data + np.uint8(1)) * solid).astype(np.uint64)  # UTF-8 has no byte 255
    sums *= power[: len(data)]
    np.cumsum(sums, out=sums)
    before = sums[np.maximum(starts, 1) - 1]
    if starts[0] == 0:
        before[0] = 0
    return starts, _mixed((np.append(before[1:], sums[-1]) - before) * inverse[starts])


def token_sets(h: np.ndarray, counts: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and tokens of records of so many words with these hashes, a record's tokens sorted and distinct.

    At most 65,536 records.
    """
    k, total = kind.words, len(h)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = []
    if total >= k:
        n = total - k + 1
        s = h[:n].copy()
        for j in range(1, k):
            s ^= s >> np.uint64(29)
            s *= _MIX
            s += h[j : j + n]
        s ^= s >> np.uint64(32)
        s *= _MIX
        whole = owner[:n] == owner[k - 1 :]
        keys.append((owner[:n][whole] << np.uint64(BITS)) | (s[whole] >> np.uint64(64 - BITS)))
    if kind.short:
        few = np.flatnonzero((counts > 0) & (counts < k)).tolist()
        at = np.concatenate(([0], np.cumsum(counts))).tolist()
        keys.append(np.array([(i << BITS) | (xxhash.xxh3_64_intdigest(h[at[i] : at[i + 1]].tobytes() + b"short") >> (64 - BITS)) for i in few], np.uint64))
    key = np.concatenate([np.empty(0, np.uint64), *keys])
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    bounds = np.searchsorted(key >> np.uint64(BITS), np.arange(len(counts) + 1, dtype=np.uint64))
    return bounds, key & _MASK


#: Bytes of text and records that are handled at once; a longer text is handled alone, by so many records.
_TEXT, _RECORDS = 600_000, 20_000


def _records(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[tuple]:
    """Parts of the input: the batch, each record's row in it, line numbers, nodes, their checks, bounds and tokens."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + _TEXT, side="right")) - 1)
            for owner, *part in _parts(data[at[i] : at[j]], at[i : j + 1] - at[i], kind):
                yield batch, owner + i, *part
            i = j


def _parts(data: np.ndarray, bounds: np.ndarray, kind: Kind) -> Iterator[tuple]:
    texts = len(bounds) - 1
    if kind.fold:
        data = _LOWER[data]
    starts, h = words_of(data, bounds)
    if kind.lines:  # a record begins at a text's start and after each line feed
        breaks = np.flatnonzero(data == 10) + 1
        of_break = np.searchsorted(bounds, breaks - 1, side="right") - 1
        begin = np.concatenate((bounds[:-1], breaks))
        owner = np.concatenate((np.arange(texts), of_break))
        order = np.lexsort((begin, owner))
        begin, owner = begin[order], owner[order]
        number = np.arange(len(owner)) - np.repeat(np.searchsorted(owner, np.arange(texts)), np.bincount(owner, minlength=texts))
        # an empty last line begins where the next text does; words there are the next text's
        end = np.append(begin[1:], len(data))
        counts = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
        keep = counts >= (1 if kind.short else kind.words)
    else:
        owner, number = np.arange(texts), np.zeros(texts, np.int64)
        counts = np.diff(np.searchsorted(starts, bounds))
        keep = np.ones(texts, bool)
    h = h[np.repeat(keep, counts)]
    counts, owner, number = counts[keep], owner[keep], number[keep]
    ends = np.cumsum(counts)
    for a in range(0, len(counts), _RECORDS):
        b = min(a + _RECORDS, len(counts))
        own = h[ends[a] - counts[a] : ends[b - 1]]
        cuts, tokens = token_sets(own, counts[a:b], kind)
        yield owner[a:b], number[a:b], *numbers(own, counts[a:b], cuts, tokens, kind), cuts, tokens


def _digest(data) -> bytes:
    return xxhash.xxh3_128_digest(data)


def numbers(h: np.ndarray, counts: np.ndarray, cuts: np.ndarray, tokens: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a hash of each set. A set of one shingle, however often it comes, is hashed by its words."""
    sides, first = (cuts * 8).tolist(), np.cumsum(counts) - counts
    raw, words = memoryview(tokens.view(np.uint8)), memoryview(np.ascontiguousarray(h).view(np.uint8))
    by_words = zip(sides[:-1], sides[1:], (first * 8).tolist(), ((first + np.minimum(counts, kind.words)) * 8).tolist(), strict=True)
    both = np.frombuffer(b"".join([_digest(words[a:b]) if y - x == 8 else _digest(raw[x:y]) for x, y, a, b in by_words]), "<i8").reshape(-1, 2)
    node, check = both[:, 0].copy(), both[:, 1].copy()
    if kind.bits < 64:
        node &= (1 << kind.bits) - 1
    if kind.clash:
        same = np.isin(node, np.fromiter(kind.clash, np.int64, len(kind.clash)))
        node[same] = check[same]
    return node, check


class Seen:
    """Tells nodes that a task meets for the first time, as far as it remembers."""

    def __init__(self) -> None:
        self.slots = ~np.arange(SEEN, dtype=np.int64)  # no number that belongs to the slot

    def first(self, nodes: np.ndarray) -> np.ndarray:
        at = np.unique(nodes, return_index=True)[1]
        slot = nodes[at] & (SEEN - 1)
        out = np.zeros(len(nodes), bool)
        out[at] = self.slots[slot] != nodes[at]
        self.slots[slot] = nodes[at]
        return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 48-bit numbers by their steps, of four bytes where these suffice."""
    steps = np.diff(values, prepend=np.uint64(0))
    if len(steps) and int(steps[1:].max(initial=0)) < 1 << 32:
        return b"\x04" + int(values[0]).to_bytes(8, "little") + steps[1:].astype("<u4").tobytes()
    return b"\x08" + steps.astype("<u8").tobytes()


def packed(*columns: np.ndarray) -> bytes:
    """Columns of small numbers, of two bytes each where these suffice, compressed."""
    wide = "<u4" if max(int(c.max(initial=0)) for c in columns) > 0xFFFF else "<u2"
    return wide[-1].encode() + pa.compress(b"".join([c.astype(wide).tobytes() for c in columns]), codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int, length: int) -> list[np.ndarray]:
    width = int(data[:1])
    raw = pa.decompress(data[1:], width * columns * length, codec="zstd", asbytes=True)
    return [np.frombuffer(raw, f"<u{width}", length, i * width * length).astype(np.int64) for i in range(columns)]


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[0] == 8:
        return np.cumsum(np.frombuffer(data, "<u8", offset=1), dtype=np.uint64)
    steps = np.frombuffer(data, "<u4", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1, 1), steps)), dtype=np.uint64)


_RECORD = "doc_id long, file long, row long, line int, node long, check long, n int, bits array<long>"
_SCAN, _SCANNED = f"{_RECORD}, bucket int, shingles binary, times binary", f"{_RECORD}, shingle long, df long"
_FIELDS = [("doc_id", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int32()), ("bits", pa.list_(pa.int64()))]
_SCAN_ARROW = pa.schema([*_FIELDS, ("bucket", pa.int32()), ("shingles", pa.binary()), ("times", pa.binary())])
_SCANNED_ARROW = pa.schema([*_FIELDS, ("shingle", pa.int64()), ("df", pa.int64())])


def _rows(schema: pa.Schema, length: int, **columns) -> pa.RecordBatch:
    """A batch of so many rows with these columns, the others null."""
    arrays = []
    for field in schema:
        got = columns.get(field.name)
        arrays.append(pa.nulls(length, field.type) if got is None else got if isinstance(got, pa.Array) else pa.array(got, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def bitmaps(bounds: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    """For each record, bits that tell whether an odd number of its tokens falls on them, as 64-bit integers."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    odd = np.bincount(owner * bits + ((tokens >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view("<i8")


def _scan(kind: Kind, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(held), return_counts=True)
        bucket = ((tokens * np.uint64(buckets)) >> np.uint64(BITS)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
        parts = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return _rows(_SCAN_ARROW, len(parts), bucket=[i for i, _, _ in parts], shingles=[pack_sorted(tokens[a:b]) for _, a, b in parts], times=[packed(times[a:b]) for _, a, b in parts])

    def documents(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each text, without a node: ``n`` is the number of its lines."""
        texts = batch.column("text")
        return _rows(_SCAN_ARROW, batch.num_rows, **{c: batch.column(c) for c in ("doc_id", "file", "row")}, n=pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, last = Seen(), [], None
        for batch, owner, at, nodes, checks, bounds, tokens in _records(batches, kind):
            sizes = np.diff(bounds)
            use = seen.first(nodes) & (sizes >= kind.smallest)
            bits = bitmaps(bounds, tokens, kind.bitmap)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, bits.shape[1]), pa.int32()), pa.array(bits.ravel()))
            lists = pc.if_else(pa.array(use), lists, pa.nulls(len(use), lists.type))
            of = pa.array(owner)
            yield _rows(_SCAN_ARROW, len(use), **{c: batch.column(c).take(of) for c in ("doc_id", "file", "row")}, line=at.astype(np.int32), node=nodes, check=checks, n=sizes.astype(np.int32), bits=lists)
            held.append(tokens[np.repeat(use, sizes)])
            if sum(map(len, held)) > SORTED:
                yield counted(held)
                held = []
        if held and any(map(len, held)):
            yield counted(held)

    def with_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known.append(batch)
                yield batch

        for out in run(noted()):
            yield from map(documents, known)
            known.clear()
            yield out
        yield from map(documents, known)

    return with_documents if kind.lines else run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as they are, and the frequencies of a bucket's shingles; rows of a bucket follow one another."""
    bucket, tokens, times = None, [], []

    def done() -> pa.RecordBatch:
        t, n = np.concatenate(tokens), np.concatenate(times)
        order = np.argsort(t)
        t, n = t[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        total = np.add.reduceat(n, first)
        often = total >= LEAST_FREQUENT
        return _rows(_SCANNED_ARROW, int(often.sum()), shingle=t[first][often].astype(np.int64), df=total[often])

    for batch in batches:
        record = pc.is_null(batch.column("bucket"))
        if pc.any(record).as_py():
            records = batch.filter(record)
            yield _rows(_SCANNED_ARROW, records.num_rows, **{name: records.column(name) for name, _ in _FIELDS})
            batch = batch.filter(pc.invert(record))
        for b, steps, n in zip(*(batch.column(c) for c in ("bucket", "shingles", "times")), strict=True):
            b = b.as_py()
            if b != bucket and tokens:
                yield done()
                tokens, times = [], []
            bucket = b
            tokens.append(unpack_sorted(steps.as_py()))
            times += unpacked(n.as_py(), 1, len(tokens[-1]))
    if tokens:
        yield done()


def scan(docs: DataFrame, kind: Kind) -> DataFrame:
    """Rows of records (doc_id, file, row, line, node, check, n, and bits where the node is new to its task), rows of
    frequent shingles (shingle, df) and, where records are lines, rows of documents (n: their lines).

    ``file`` and ``row`` say where a document lies, so that rows with equal or null ids stay apart. Records pass through
    the shuffle that counts shingles, so that these are never written but for it.
    """
    n = partitions(docs.sparkSession)
    rows = place_in_files(docs, "doc_id", "text").mapInArrow(_scan(kind, 2 * n), _SCAN)
    dealt = rows.withColumn("to", F.coalesce("bucket", F.spark_partition_id())).repartition(n, "to").drop("to").sortWithinPartitions("bucket")
    return settle(dealt.mapInArrow(_frequencies, _SCANNED), "records")


def frequent(scanned: DataFrame, most: int = MOST_FREQUENT):
    """A broadcast of the frequent shingles, sorted, and their levels; at most ``most`` of them."""
    spark = scanned.sparkSession
    counts = scanned.where("shingle IS NOT NULL").select("shingle", "df")
    level = F.floor(F.log2("df")).cast("int")
    sizes = {r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}  # one row per power of two
    low, held = 64, 0
    for at in sorted(sizes, reverse=True):
        if held + sizes[at] > most:
            break
        low, held = at, held + sizes[at]
    table = counts.where(level >= low).select("shingle", level.alias("level")).toArrow()
    tokens, levels = (table.column(i).to_numpy().astype(t) for i, t in ((0, np.uint64), (1, np.uint8)))
    order = np.argsort(tokens)
    return spark.sparkContext.broadcast((tokens[order], np.minimum(levels[order], LAST)))


def needed(n, threshold: int):
    """How many mismatches a prefix of a set of size n must rule out."""
    return n - -(-threshold * n // 100) + 1


def schemes(n: int, threshold: int) -> list[tuple[int, int]]:
    """The schemes (number, classes) that a set of size n is indexed by.

    Scheme j has the sets of 2**j shingles and more, up to the sizes that are similar to its largest. Frequent shingles
    are dealt into as many classes as leave a few in each; no classes: the sets are too small for combinations.
    """
    out = []
    for j in range((-(-threshold * n // 100)).bit_length() - 1, n.bit_length()):
        classes = max(1, int(needed(1 << j, threshold)) // 4)
        out.append((j, classes if int(needed(1 << j, threshold)) + 3 * classes <= 1 << j else 0))
    return out


def _combined(*parts: int) -> int:
    out = 0
    for x in parts:
        out = (out ^ x) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out >> 64 - BITS


def prefix_signatures(tokens: np.ndarray, levels: np.ndarray, need: int, threshold: int) -> list[tuple[int, int, int]]:
    """(signature, place, 1 if it may be frequent) of a set in which rare shingles are too few.

    The prefix ends where the removal of need - 1 shingles, whichever, leaves one that is indexed alone or enough of a
    class for a combination.
    """
    order = np.lexsort((tokens, levels))
    t, lev = tokens[order].tolist(), levels[order].tolist()
    out: dict[int, tuple[int, int]] = {}
    for scheme, classes in schemes(len(t), threshold):
        held: dict[tuple[int, int], list[int]] = {}
        covered = 0
        for i, x in enumerate(t):
            if covered >= need:
                break
            if lev[i] < PAIRED_LEVEL or not classes:
                out.setdefault(x, (i, int(lev[i] > 0)))
                covered += 1
                continue
            k = 2 if lev[i] < TRIPLE_LEVEL else 3
            others = held.setdefault((k, x % classes), [])
            covered += len(others) >= k - 1
            for group in [(y,) for y in others] if k == 2 else combinations(others, 2):
                out.setdefault(_combined(scheme, *sorted((x, *group))), (-1, 1))
            others.append(x)
    return [(s, i, f) for s, (i, f) in out.items()]


_SIGS = "bucket int, data binary, signature long, node long, n int"
_SIGS_ARROW = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), ("signature", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])


def _signatures(kind: Kind, often, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_levels = often.value
        seen, held, rows = Seen(), [], 0

        def rare() -> pa.RecordBatch:
            sig, node, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(sig)
            sig, node, n, at = sig[order], node[order], n[order], at[order]
            bucket = ((sig * np.uint64(buckets)) >> np.uint64(BITS)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            parts = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            data = []
            for _, a, b in parts:
                small = packed(n[a:b], at[a:b])
                data.append(b"".join([len(small).to_bytes(4, "little"), (b - a).to_bytes(4, "little"), node[a:b].astype("<i8").tobytes(), small, pack_sorted(sig[a:b])]))
            k = len(parts)
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in parts], pa.int32()), pa.array(data, pa.binary()), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int32())]], schema=_SIGS_ARROW)

        for _, _, _, nodes, _, bounds, tokens in _records(batches, kind):
            if rows > SORTED:
                yield rare()
                held, rows = [], 0
            sizes = np.diff(bounds)
            use = seen.first(nodes) & (sizes >= kind.smallest)
            need = needed(sizes, kind.threshold)
            owner = np.repeat(np.arange(len(nodes)), sizes)
            level = np.zeros(len(tokens), np.uint8)
            if len(known):
                place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                hit = known[place] == tokens
                level[hit] = known_levels[place[hit]]
            low = level == 0
            upto = np.concatenate(([0], np.cumsum(low)))
            have = upto[bounds[1:]] - upto[bounds[:-1]]
            rank = upto[:-1] - np.repeat(upto[bounds[:-1]], sizes)
            fast = use & (have >= need)
            pick = np.flatnonzero(low & np.repeat(fast, sizes) & (rank < np.repeat(need, sizes)))
            held.append((tokens[pick], nodes[owner[pick]], sizes[owner[pick]], rank[pick]))
            rows += len(pick)
            slow = use & ~fast
            if not slow.any():
                continue
            # their shingles by rarity, and which prefixes hold none that is indexed in combinations
            at = np.flatnonzero(np.repeat(slow, sizes))
            at = at[np.argsort(owner[at] * (LAST + 1) + level[at], kind="stable")]
            own = owner[at]
            place = np.arange(len(at)) - np.repeat(np.cumsum(sizes[slow]) - sizes[slow], sizes[slow])
            within = place < need[own]
            combined = np.zeros(len(nodes), bool)
            combined[own[within & (level[at] >= PAIRED_LEVEL)]] = True
            alone = np.flatnonzero(within & ~combined[own])
            own, place, may = own[alone], place[alone], level[at[alone]] > 0
            of = [(tokens[at[alone]], nodes[own], sizes[own], place, may)]
            more: list[tuple[int, int, int, int, int]] = []
            for i in np.flatnonzero(combined).tolist():
                first, last = bounds[i], bounds[i + 1]
                node, n = int(nodes[i]), int(sizes[i])
                more += [(s, node, n, p, f) for s, p, f in prefix_signatures(tokens[first:last], level[first:last], int(need[i]), kind.threshold)]
            if more:
                s, node, n, p, f = zip(*more, strict=True)
                of.append((np.array(s, np.uint64), np.array(node, np.int64), np.array(n, np.int64), np.array(p, np.int64), np.array(f, bool)))
            s, node, n, p, may = (np.concatenate(x) for x in zip(*of, strict=True))
            held.append((s[~may], node[~may], n[~may], p[~may]))
            rows += len(held[-1][0])
            if may.any():
                yield _rows(_SIGS_ARROW, int(may.sum()), signature=s[may].astype(np.int64), node=node[may], n=n[may].astype(np.int32))
        if rows:
            yield rare()

    return run


def signatures(docs: DataFrame, kind: Kind, often) -> DataFrame:
    """Rows of rare signatures by bucket (bucket, data), and of those that may be frequent (signature, node, n)."""
    return settle(docs.select("text").mapInArrow(_signatures(kind, often, 2 * partitions(docs.sparkSession)), _SIGS), "signatures")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("signature", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])


def _rare_pairs(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) under equal rare signatures; rows of a bucket follow one another, and a bucket is handled at once.
    Large groups come back as rows (signature, node, n)."""
    t = kind.threshold

    def done(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        sig, node, n, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((node, sig))
        sig, node, n, at = sig[order], node[order], n[order], at[order]
        once = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))  # copies from several tasks
        sig, node, n, at = sig[once], node[once], n[once], at[once]
        group = np.cumsum(np.concatenate(([0], sig[1:] != sig[:-1])))
        large = np.bincount(group)[group] > LARGE
        if large.any():
            yield _rows(_PAIRS, int(large.sum()), signature=sig[large].astype(np.int64), node=node[large], n=n[large].astype(np.int32))
            sig, node, n, at = sig[~large], node[~large], n[~large], at[~large]
        out = []
        left = np.arange(len(sig))
        step = 1
        while True:  # partners one, two, ... places on, while the signature is the same
            left = left[left + step < len(sig)]
            left = left[sig[left] == sig[left + step]]
            if not len(left):
                break
            a, b = left, left + step
            least = -(-t * (n[a] + n[b]) // (100 + t))  # the intersection that similar sets of these sizes have
            possible = np.minimum(at[a], at[b]) + np.minimum(n[a] - at[a], n[b] - at[b])
            near = (100 * np.minimum(n[a], n[b]) >= t * np.maximum(n[a], n[b])) & (possible >= least)
            out.append(np.stack((node[a][near], node[b][near])))
            step += 1
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)
        yield _rows(_PAIRS, pairs.shape[1], a=pairs[0], b=pairs[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column(0)[i].as_py()
                if x != bucket and parts:
                    yield from done(parts)
                    parts = []
                bucket, data = x, batch.column(1)[i].as_py()
                size, k = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
                node = np.frombuffer(data, "<i8", k, 8)
                parts.append((unpack_sorted(data[8 + 8 * k + size :]), node, *unpacked(data[8 + 8 * k : 8 + 8 * k + size], 2, k)))
        if parts:
            yield from done(parts)

    return run


def nodes_of(scanned: DataFrame, kind: Kind, place: Column | None = None) -> DataFrame:
    """One row per node: node, n, copies (records), home (a number of a document that has it), place, whether differing sets clash in it, and
    its bits as numbers b0, b1, ..., which are null for sets too small to have a similar one. ``place`` orders records,
    and a node's is its first one's."""
    bits = [F.max(F.col("bits")[i]).alias(f"b{i}") for i in range(kind.bitmap // 64)]  # equal in all rows of a node
    first = F.min(F.lit(0).cast("long") if place is None else place).alias("place")
    clash = (F.min("check") != F.max("check")).alias("clash")
    return settle(scanned.where("node IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min(F.xxhash64("file", "row")).alias("home"), first, clash, *bits), "nodes")


def scanned_nodes(docs: DataFrame, kind: Kind, place: Callable[[DataFrame], Column] | None = None) -> tuple[DataFrame, DataFrame, Kind]:
    """scan() and nodes_of(), without clashes: where differing sets share a number, all are scanned again with these sets
    renumbered. There are next to none below billions of sets, and few among more."""
    while True:
        scanned = scan(docs, kind)
        nodes = nodes_of(scanned, kind, place and place(scanned))
        clash = frozenset(r.node for r in nodes.where("clash").select("node").collect()) - kind.clash
        if not clash:
            return scanned, nodes.drop("clash"), kind
        kind = replace(kind, clash=kind.clash | clash)


def _bits(kind: Kind) -> list[str]:
    return [f"b{i}" for i in range(kind.bitmap // 64)]


def _close(kind: Kind) -> Column:
    """Whether nodes a and b can be similar by sizes and bitmaps, whose difference is at most that of the sets."""
    na, nb, t = F.col("n_a"), F.col("n_b"), kind.threshold
    least = F.ceil((na + nb) * t / F.lit(100 + t) - F.lit(1e-9))
    first, *more = [F.bit_count(F.col(f"b{i}_a").bitwiseXOR(F.col(f"b{i}_b"))) for i in range(kind.bitmap // 64)]
    return (100 * F.least(na, nb) >= t * F.greatest(na, nb)) & (sum(more, first) <= na + nb - 2 * least)


def _side(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in nodes.columns])


def plausible(pairs: DataFrame, nodes: DataFrame, kind: Kind) -> DataFrame:
    """The pairs (a, b) that pass the bounds of sizes and bitmaps."""
    rows = nodes.drop("place", "home", "copies")
    return pairs.join(_side(rows, "a"), "a").join(_side(rows, "b"), "b").where(_close(kind)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


_FILTER_BITS = 1 << 26


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(filter_places(batch.column(0).to_numpy(zero_copy_only=False)))], names=["bit"])


def filter_places(numbers: np.ndarray) -> np.ndarray:
    mixed = numbers.astype(np.int64).view(np.uint64) * _MIX
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(_FILTER_BITS)).astype(np.int64)


def number_filters(*columns: DataFrame):
    """A broadcast bitmap (8 MB, whatever the data) for each column of numbers, with a bit for each of them; other numbers
    pass by chance only."""
    spark = columns[0].sparkSession
    every = None
    for i, numbers in enumerate(columns):
        bits = numbers.mapInArrow(_filter_bits, "bit long").select(((F.col("bit") / 32768).cast("int") + i * 2048).alias("page"), (F.col("bit") % 32768).cast("int").alias("bit"))
        every = bits if every is None else every.unionByName(bits)

    def page(key, table):
        own = np.zeros(32768, np.uint8)
        own[table.column("bit").to_numpy()] = 1
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    whole = np.zeros((len(columns), _FILTER_BITS // 8), np.uint8)
    for row in every.distinct().groupBy("page").applyInArrow(page, "page int, data binary").collect():  # at most 2,048 pages each
        whole[row.page // 2048, row.page % 2048 * 4096 :][:4096] = np.frombuffer(row.data, np.uint8)
    return [spark.sparkContext.broadcast(x) for x in whole]


def passes(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = filter_places(numbers)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sets(kind: Kind, docs_wanted, nodes_wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = passes(docs_wanted.value, batch.column(0).to_numpy())
            if keep.any():
                yield batch.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, owner, _, nodes, _, bounds, tokens in _records(wanted(batches), kind):
            keep = np.flatnonzero(passes(nodes_wanted.value, nodes) & (np.diff(bounds) >= kind.smallest))
            keep = keep[np.sort(np.unique(np.stack((owner[keep], nodes[keep])), axis=1, return_index=True)[1])]  # once for each document
            data = [np.ascontiguousarray(tokens[bounds[i] : bounds[i + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), pa.array(nodes[keep]), pa.array(data, pa.binary())], names=["home", "node", "tokens"])

    return run


def sets_of(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """The token sets of the wanted nodes (node, home): node, tokens. Only documents that have one are read beyond their
    places, and each set comes from one of them. It is written in buckets by node, so that joins don't shuffle it."""
    filters = number_filters(wanted.select("home"), wanted.select("node"))
    rows = place_in_files(docs, "text").select(F.xxhash64("file", "row").alias("home"), "text").mapInArrow(_sets(kind, *filters), "home long, node long, tokens binary")
    of = wanted.select(F.col("node").alias("of"), F.col("home").alias("at"))
    # the key is the node alone, as that of the buckets is; two records of a document may have one node
    found = rows.join(of, (F.col("node") == F.col("of")) & (F.col("home").bitwiseXOR(F.col("at")) == 0), "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"))
    return settle_buckets(found, "sets", "node", partitions(docs.sparkSession))


def _verify(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), f"V{width}") for c in (2, 3))
                x, y = (np.pad(v.view(np.uint8).reshape(-1, width), ((0, 0), (0, 8 - width))).view("<u8").ravel() for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= kind.threshold * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, kind: Kind) -> DataFrame:
    """The similar ones of distinct pairs (a, b)."""
    one, two = (sets.select(F.col("node").alias(s), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    return settle(pairs.join(one, "a").join(two, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_verify(kind), "a long, b long"), "similar")


def _by_signature(nodes: DataFrame) -> DataFrame:
    """A row for each signature that a node of large groups has there, with the group's size."""
    rest = [c for c in nodes.columns if c != "shared"]
    return nodes.select(*rest, F.explode("shared").alias("at")).select("at.*", *rest)


def _by_node(rows: DataFrame) -> DataFrame:
    """A row for each node of rows (signature, node) with its ``signatures`` among them, in order."""
    return rows.groupBy("node").agg(F.array_sort(F.collect_list("signature")).alias("signatures"))


def _pivots(grouped: DataFrame) -> DataFrame:
    """Pairs of each row's node with the pivots of its parts of the group: the first nodes by place.

    Groups are dealt into small and into wide parts by hashes that differ with the signature, so a node meets different
    pivots under the signatures it shares, and no part grows with its group. The wide parts have the first node of a whole
    group, which its copies are most like, as a pivot, unless the group is yet larger.
    """
    met = []
    for size, by in ((PART, F.xxhash64("signature", "node")), (WIDE, F.col("node"))):  # places may be equal
        part = Window.partitionBy("signature", F.pmod(F.xxhash64(F.lit(size), "signature", "node"), F.ceil(F.col("size") / size)))  # few rows, however large the group
        met.append(F.min_by("node", F.struct("place", by.alias("by"))).over(part).alias(f"pivot{size}"))
    both = settle(grouped.select("node", *met).distinct(), "pivots")  # rows by signature are made once for both
    one, two = (both.select(F.col(f"pivot{size}").alias("a"), F.col("node").alias("b")).where("a <> b") for size in (PART, WIDE))
    return one.unionByName(two)


class Links:
    """What becomes of similar pairs, and which comparisons they make needless.

    ``one_way``: a node need meet earlier ones only.
    """

    one_way = False

    def absorb(self, pairs: DataFrame, nodes: DataFrame) -> None:
        """Take in verified pairs (a, b), a < b; each comes once. ``nodes`` has their rows of nodes_of()."""
        raise NotImplementedError

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """The nodes with ``label``; those of one label need no comparison with each other."""
        raise NotImplementedError

    def opened(self, rows: DataFrame) -> DataFrame:
        """Rows of labelled nodes by signature with ``open``, whether a node must yet meet those of other labels there."""
        raise NotImplementedError


def _bands(n: Column, kind: Kind) -> Column:
    """The size band of a set; sizes of similar sets lie in one band or two that adjoin."""
    return F.floor(F.log(n) / math.log(100 / kind.threshold * 1.01)).cast("int")


def link(docs: DataFrame, scanned: DataFrame, kind: Kind, nodes: DataFrame, links: Links) -> None:
    """Give all similar pairs of nodes to ``links``, but for those that it makes needless."""
    spark, t = docs.sparkSession, kind.threshold
    signed = signatures(docs, kind, frequent(scanned))
    dealt = signed.where("bucket IS NOT NULL").select("bucket", "data").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    rare = settle(dealt.mapInArrow(_rare_pairs(kind), "a long, b long, signature long, node long, n int"), "rare")
    often = signed.unionByName(rare, allowMissingColumns=True).where("signature IS NOT NULL").groupBy("signature", "node").agg(F.first("n").alias("n"))
    sizes = often.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    grouped = settle(often.join(sizes, "signature"), "grouped")
    x, y = (grouped.where(F.col("size") <= LARGE).select("signature", F.col("node").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
    near = 100 * F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b")
    met = rare.where("a IS NOT NULL").select("a", "b").unionByName(x.join(y, "signature").where((F.col("a") < F.col("b")) & near).select("a", "b"))
    # nodes of large groups, each with all its signatures there
    large = grouped.where(F.col("size") > LARGE).groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("signature", "size"))).alias("shared"))
    some = not grouped.where(F.col("size") > LARGE).isEmpty()
    if some:
        large = settle(large.join(nodes.select("node", "place", *_bits(kind)), "node"), "large")
        met = met.unionByName(_pivots(_by_signature(large.select("node", "place", "shared"))))
    raw = settle(_ordered(met), "candidates")
    named = raw.select(F.col("a").alias("node")).unionByName(raw.select(F.col("b").alias("node")))
    if some:
        named = named.unionByName(large.select("node"))
    info = settle(nodes.join(named.distinct(), "node", "left_semi"), "candidate-nodes")
    first = settle(plausible(raw, info, kind), "plausible")
    wanted = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node")))
    if some:
        wanted = wanted.unionByName(large.select("node"))
    wanted = settle(info.select("node", "home").join(wanted.distinct(), "node", "left_semi"), "wanted")
    sets = sets_of(docs, wanted, kind)
    links.absorb(verified(first, sets, kind), info)
    if not some:
        return
    large = settle(links.labelled(large), "labelled")
    opened = settle(_by_node(links.opened(_by_signature(large.drop("n", "place", *_bits(kind)))).where("open")), "open")
    if opened.isEmpty():
        return
    # nodes under signatures where some node is open; a pair meets under the first of these that it shares, by rows with
    # bitmaps, so that the join gives plausible pairs only. A node takes its bitmap once, before it becomes a row for each
    # of its signatures
    some_open = opened.select(F.explode("signatures").alias("signature")).distinct()
    group = settle(_by_node(_by_signature(large.select("node", "shared")).join(some_open, "signature", "left_semi")), "met")
    every = large.drop("shared").withColumn("band", _bands(F.col("n"), kind))
    own, group = (_side(rows.join(every, "node"), side).withColumn("signature", F.explode(f"signatures_{side}")) for rows, side in ((opened, "a"), (group, "b")))
    own = own.withColumn("band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col("band_a") + d)))
    group = group.withColumnRenamed("band_b", "band")
    apart = (F.col("label_a") != F.col("label_b")) & (F.col("place_b") < F.col("place_a") if links.one_way else F.lit(True))
    once = F.col("signature") == F.array_intersect("signatures_a", "signatures_b")[0]
    more = _ordered(own.join(group, ["signature", "band"]).where(apart & _close(kind) & once).select("a", "b"))
    fresh = settle(more.join(raw, ["a", "b"], "left_anti"), "plausible")
    if not fresh.isEmpty():
        links.absorb(verified(fresh, sets, kind), info)
