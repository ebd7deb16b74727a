"""Filters of fixed size over sets of 64-bit hashes (Bloom 1970): no member is missed, others pass rarely.

A filter is made of chunks, one for each value of the hashes' leading bits, each built where its hashes meet. What reaches the driver
and is broadcast has at most MOST_BITS bits, at any scale; where it has too few bits for the set, more hashes pass, and the exact
join that follows has more to do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from procmill.llm.words import mix

#: Bits of a filter at most: 128 MB. Bits for a hash, and places that a hash sets.
MOST_BITS, BITS_EACH, PLACES = 1 << 30, 24, 4
_CHUNK_BITS = 6


def _places(h: np.ndarray, size: int):
    a, b = mix(h), mix(h + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for i in range(PLACES):
        yield (a + np.uint64(i) * b) & np.uint64(size - 1)


@dataclass
class Filter:
    """bits: one row of bytes for each chunk, each byte 8 bits."""

    bits: np.ndarray

    def might(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be a member."""
        size = self.bits.shape[1] * 8
        base = (h >> np.uint64(64 - _CHUNK_BITS)) * np.uint64(size)
        flat, out = self.bits.reshape(-1), np.ones(len(h), bool)
        for at in _places(h, size):
            at = at + base
            out &= (flat[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _build(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            h = b["h"].to_numpy().view(np.uint64)
            top = (h >> np.uint64(64 - _CHUNK_BITS)).astype(np.int64)
            for c in np.unique(top).tolist():
                bits = chunks.setdefault(c, np.zeros(size, bool))
                for at in _places(h[top == c], size):
                    bits[at.astype(np.int64)] = True
        for c, bits in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    return run


def filter_of(hashes: DataFrame, expected: int, most_bits: int = MOST_BITS) -> Filter:
    """The filter of a table of hashes (h bigint), sized for `expected` of them, most_bits at most."""
    want = min(max(expected * BITS_EACH, 1 << 16), most_bits)
    size = max(1 << ((want - 1).bit_length() - _CHUNK_BITS), 8)
    parts = hashes.repartition(F.shiftrightunsigned("h", 64 - _CHUNK_BITS)).mapInArrow(_build(size), "chunk int, bits binary").collect()
    out = np.zeros((1 << _CHUNK_BITS, size // 8), np.uint8)
    for r in parts:
        out[r["chunk"]] |= np.frombuffer(r["bits"], np.uint8)
    return Filter(out)
