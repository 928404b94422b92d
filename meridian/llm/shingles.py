"""Word shingles of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(7)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) in order, and where each text's words begin (n + 1 places)."""
    raw, offsets = _bytes_of(texts)
    dark = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a text begins or ends here
    begin = dark.copy()
    begin[1:] &= ~dark[:-1] | edge[1:-1]
    end = dark.copy()
    end[:-1] &= ~dark[1:] | edge[1:-1]
    first, size = np.flatnonzero(begin), None
    size = np.flatnonzero(end) + 1 - first
    h = np.zeros(len(first), np.uint64)
    live, k = np.arange(len(first)), 0
    while len(live):
        h[live] = h[live] * STEP + BYTE[LOWER[raw[first[live] + k]]]
        k += 1
        live = live[size[live] > k]
    return mix(h + size.astype(np.uint64)), np.searchsorted(first, offsets).astype(np.int64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and n + 1 bounds.

    A text of fewer words than width has its whole sequence as one shingle; one without words or a
    null has none.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = at[:-1][doc] + (np.arange(len(doc)) - bounds[:-1][doc])
    held = np.minimum(n[doc], width)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    s = held.astype(np.uint64)
    for k in range(width):
        s = s + np.where(k < held, padded[start + k] * PLACE[k], np.uint64(0))
    s = mix(s)
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        s[i:j].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int64)


def blocks(table: pa.RecordBatch, column: str, most_bytes: int):
    """Slices of a batch whose texts have about most_bytes together (one row at least), by Arrow's own lengths."""
    ends = np.cumsum(pc.binary_length(table.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(table):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most_bytes)))
        yield table.slice(begin, stop - begin)
        begin = stop


def parts(table: pa.RecordBatch, column: str, most_bytes: int = 4_000_000):
    """Slices of a batch whose texts have about most_bytes together (one row at least)."""
    sizes = np.cumsum(table.column(column).cast(pa.large_string()).fill_null("").to_pandas().str.len().to_numpy()) if len(table) else []
    begin = 0
    while begin < len(table):
        base = sizes[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(sizes, base + most_bytes)))
        yield table.slice(begin, stop - begin)
        begin = stop
