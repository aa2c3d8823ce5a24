"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block has 128 values. Its minimum is subtracted; the differences are packed at the width that holds at least 90 % of
them; what doesn't fit keeps its low bits in place and its high bits in the block's exception list.

A file is, in little-endian order::

    magic b"QPF1", n_docs u32, n_values u64, n_blocks u32, n_exceptions u32
    doc ids i64[n_docs], null flags of ids u8[n_docs], values per doc u32[n_docs]
    minimum u32[n_blocks], width u8[n_blocks], exceptions u8[n_blocks], block starts u32[n_blocks] (bytes into the packed area)
    exception positions u8[n_exceptions], exception high bits u32[n_exceptions], packed area
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK, PERCENTILE = 128, 0.9
HEAD = struct.Struct("<4sIQII")
_AT = int(np.ceil(BLOCK * PERCENTILE)) - 1
_CHUNK = 1024


def _squeeze(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of a block's values below 2**width as rows of bytes: eight values make as many bytes as the width."""
    v = values.astype(np.uint64).reshape(-1, 8)
    words = np.zeros((len(v), 4), np.uint64)
    for i in range(8):
        at, shift = divmod(i * width, 64)
        words[:, at] |= v[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= v[:, i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.astype("<u8", copy=False).view(np.uint8)[:, :width]).reshape(len(values), -1)


def _spread(packed: np.ndarray, width: int) -> np.ndarray:
    """The values of rows of bytes that _squeeze() made."""
    groups = packed.reshape(-1, width)
    raw = np.zeros((len(groups), 32), np.uint8)
    raw[:, :width] = groups
    words = raw.view("<u8")
    out = np.empty((len(groups), 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(8):
        at, shift = divmod(i * width, 64)
        x = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            x |= words[:, at + 1] << np.uint64(64 - shift)
        out[:, i] = x & mask
    return out.reshape(len(packed), BLOCK)


def pack(doc_ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    """A file's bytes; values are the documents' integers one after another."""
    n = -(-len(values) // BLOCK)
    grid = np.empty(n * BLOCK, np.uint32)
    grid[: len(values)] = values
    grid[len(values) :] = values[-1] if len(values) else 0
    grid = grid.reshape(n, BLOCK)
    low = grid.min(axis=1) if n else np.empty(0, np.uint32)
    grid -= low[:, None]
    width = np.empty(n, np.uint8)
    for i in range(0, n, _CHUNK):
        at = np.partition(grid[i : i + _CHUNK], _AT, axis=1)[:, _AT]  # the bit lengths' percentile is that of this value
        width[i : i + _CHUNK] = np.frexp(at.astype(np.float64))[1].astype(np.uint8)
    high = grid >> width[:, None] if n else grid
    row, col = np.nonzero(high)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(width.astype(np.int64) * (BLOCK // 8), out=starts[1:])
    area = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        every = np.nonzero(width == w)[0]
        for i in range(0, len(every), _CHUNK):
            rows = every[i : i + _CHUNK]
            packed = _squeeze(grid[rows] & np.uint32((1 << int(w)) - 1), int(w))
            area[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    counts = np.bincount(row, minlength=n).astype(np.uint8)
    return b"".join([
        HEAD.pack(b"QPF1", len(doc_ids), len(values), n, len(row)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u4").tobytes(),
        low.astype("<u4").tobytes(), width.tobytes(), counts.tobytes(), starts[:-1].astype("<u4").tobytes(),
        col.astype(np.uint8).tobytes(), high[row, col].astype("<u4").tobytes(), area.tobytes(),
    ])


class Packed:
    """Reads what pack() made; blocks can be read alone."""

    def __init__(self, data: bytes) -> None:
        magic, n_docs, self.n_values, n, n_exceptions = HEAD.unpack_from(data)
        if magic != b"QPF1":
            raise ValueError("not a file of packed integers")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        ids, nulls, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls, strict=True)]
        self.low, self.width, counts, self.starts = take("<u4", n), take("u1", n), take("u1", n), take("<u4", n)
        self.position, self.high = take("u1", n_exceptions), take("<u4", n_exceptions)
        self.first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.area = np.frombuffer(data, np.uint8, offset=at)

    def blocks(self, rows: np.ndarray) -> np.ndarray:
        """The values of these blocks, a row each."""
        out = np.zeros((len(rows), BLOCK), np.uint32)
        widths = self.width[rows]
        for w in map(int, np.unique(widths)):
            where = np.nonzero(widths == w)[0]
            for i in range(0, len(where) if w else 0, _CHUNK):
                part = where[i : i + _CHUNK]
                packed = self.area[self.starts[rows[part]].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
                out[part] = _spread(packed, w)
        n = self.first[rows + 1] - self.first[rows]
        row = np.repeat(np.arange(len(rows)), n)
        entry = np.repeat(self.first[rows], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out[row, self.position[entry]] |= self.high[entry] << widths[row]
        out += self.low[rows][:, None]
        return out

    def values(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Values from start to stop, from the blocks that hold them."""
        stop = self.n_values if stop is None else stop
        if stop <= start:
            return np.empty(0, np.uint32)
        first = start // BLOCK
        return self.blocks(np.arange(first, -(-stop // BLOCK))).reshape(-1)[start - first * BLOCK : stop - first * BLOCK]
