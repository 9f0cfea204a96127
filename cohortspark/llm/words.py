"""Words and word hashes of whole Arrow text columns, with numpy and without a loop over words.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in
UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` over characters. Hashes are
polynomials over random byte values modulo 2**64, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000  # text handled at once, which bounds a task's memory; a longer text is handled alone

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**64 - 1, 256, dtype=np.uint64), int(rng.integers(2**62, 2**63)) | 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**n and its inverses modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) <= n:
        size = max(n + 1, 1024)
        known = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
                      for b in (base, pow(base, -1, 2**64)))
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = known
    return known


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every span, equal for equal content."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of ``n`` texts that lie one after another in ``data``."""

    data: np.ndarray     # uint8, all texts
    bounds: np.ndarray   # n + 1 byte offsets of the texts
    starts: np.ndarray   # byte offset of each word
    ends: np.ndarray
    doc: np.ndarray      # index of the word's text
    first: np.ndarray    # n + 1 offsets into the words

    def hashes(self, seed: int = 1) -> np.ndarray:
        values, base = _byte_values(seed)
        return span_hashes(values[self.data], self.starts, self.ends, base)

    def windows(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``k`` words inside one text."""
        at = np.arange(max(0, len(hashes) - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        return at, span_hashes(hashes, at, at + k, 0x9E3779B97F4A7C15)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a NULL is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def split(texts: pa.Array) -> Words:
    data, bounds = buffers(texts)
    n = len(data)
    word = ~SEPARATOR[data]
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True                      # a text's first byte starts anew
    begin = word.copy()
    begin[1:] &= ~word[:-1] | opens[1:n]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | opens[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, bounds, starts, ends, doc, first)


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``CHUNK_BYTES`` of text, at least one row each."""
    if not batch.num_rows:
        return
    _, bounds = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's words (0 for a text without words)."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All spans one after another, and the offsets of each."""
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return data[index], offsets


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words (those of ``keep``), each followed by one space, and the offsets of each word."""
    starts, ends = (w.starts, w.ends) if keep is None else (w.starts[keep], w.ends[keep])
    out, offsets = gathered(np.append(w.data, np.uint8(0x20)), starts, ends + 1)
    out[offsets[1:] - 1] = 0x20
    return out, offsets


def binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow column of the given byte spans, which may overlap."""
    out, offsets = gathered(data, starts, ends)
    return pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
