"""Whole Arrow text columns as byte arrays: words, hashes and byte n-grams without a Python loop per word.

A column is cut into chunks of whole texts of about `CHUNK` bytes, so that memory stays bounded by
the chunk or by the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
PAD = 8
U64 = np.uint64
#: Low `k` bytes of a lane.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Chunk:
    """Texts `first..first+n` of a batch: `data` has PAD zero bytes before and after; `at[i]:at[i+1]` is text i."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first, self.n = data, at, first, len(at) - 1

    def lanes(self) -> np.ndarray:
        """Element i: the eight bytes from i on, little-endian (a view)."""
        return np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))


def chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    """Null texts count as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        last = min(last, len(texts))
        own = np.zeros(int(at[last] - at[first]) + 2 * PAD, dtype=np.uint8)
        part = raw[at[first] : at[last]]
        own[PAD : len(own) - PAD] = LOWER[part] if lower else part
        yield Chunk(own, at[first : last + 1] - at[first] + PAD, first)
        first = last


def words(chunk: Chunk, is_gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and the index of each text's first word (n + 1 entries)."""
    inside = ~is_gap[chunk.data]
    inside[:PAD] = inside[len(inside) - PAD :] = False
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[chunk.at[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[chunk.at[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end - start, np.searchsorted(start, chunk.at)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def hash_spans(chunk: Chunk, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    lanes = chunk.lanes()
    h = mixed(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    h = mixed(h ^ (lanes[start] & LOW[np.minimum(length, 8)]))
    done = 8
    left = np.flatnonzero(length > done)
    while len(left):
        lane = lanes[start[left] + done] & LOW[np.minimum(length[left] - done, 8)]
        h[left] = mixed(h[left] ^ lane)
        done += 8
        left = left[length[left] > done]
    return h


def hash_windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words each, for every start at which n words follow in the chunk."""
    count = max(0, len(h) - n + 1)
    out = np.full(count, n, dtype=U64)
    for k in range(n):
        out = mixed(out * U64(0x9FB21C651E98DF25) + h[k : k + count])
    return out


def windows(chunk: Chunk, depth: int) -> np.ndarray:
    """For each byte of the chunk, it and the `depth` bytes before it; the byte itself is highest."""
    head, end = chunk.at[0], chunk.at[-1]
    keys = chunk.lanes()[head - depth : end - depth] & LOW[depth + 1]
    for j in range(depth):  # bytes of the text before do not count
        at = chunk.at[:-1][chunk.at[1:] - chunk.at[:-1] > j] - head + j
        keys[at] &= ~LOW[depth - j]
    return keys


def runs(chunk: Chunk, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, for maximal runs of bytes of one kind; kind 0 separates."""
    kind = kinds[chunk.data]
    kind[:PAD] = kind[len(kind) - PAD :] = 0
    cut = np.empty(len(kind), dtype=bool)
    cut[0], cut[1:] = True, kind[1:] != kind[:-1]
    cut[chunk.at] = True
    at = np.flatnonzero(cut)
    length = np.diff(np.r_[at, len(kind)])
    full = kind[at] > 0
    start = at[full]
    return start, length[full], np.searchsorted(start, chunk.at)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i; zero for empty ranges. Each range is summed on its own."""
    out = np.zeros(len(first) - 1, dtype=values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: first[-1]], first[full])
    return out


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
