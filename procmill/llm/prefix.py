"""Exact set-similarity joins by prefix filters.

All sets order their shingles by one global order, rare ones first. Two sets with similarity t share a shingle within their first
n - ceil(t n) + 1 places, so only those places are indexed and probed; length and position filters thin the candidates, and the
sets themselves decide. Any global order gives the exact result. Rarity only saves work, so it is taken from a counting sketch of
fixed size over all rows: its 4 MB are the only thing that is broadcast, at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SKETCH_BITS = 20
_CHUNK = 1 << 14


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        flat = b["shingles"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        total += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
    if total.any():
        parts = total.astype(np.int32).reshape(-1, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "counts"])


def _add(group: pa.Table) -> pa.Table:
    s = np.sum([np.frombuffer(x, np.int32).astype(np.int64) for x in group["counts"].to_pylist()], axis=0)
    return pa.table({"chunk": group["chunk"][:1], "counts": pa.array([np.minimum(s, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})


def rarity(rows: DataFrame) -> np.ndarray:
    """Counts of all rows' shingles by the leading bits of their hash: 2**20 numbers, whatever the size of the input."""
    kind = "chunk int, counts binary"
    got = rows.select("shingles").mapInArrow(_count, kind).groupBy("chunk").applyInArrow(_add, kind).collect()
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for r in got:
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], np.int32)
    return out


def _prefixes(shared, least: float, sides: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for b in batches:
            lists = b["shingles"]
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
            cols = [b[c].to_pylist() for c in sides]
            rows, tokens, places, sizes = [], [], [], []
            for i, c in enumerate(b["cls"].to_pylist()):
                key = (c, *(x[i] for x in cols))
                if key in seen:  # a copy in the same part adds nothing
                    continue
                seen.add(key)
                s = flat[ends[i] : ends[i + 1]]
                n = len(s)
                p = n - int(np.ceil(least * n - 1e-9)) + 1
                order = np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:p]
                rows.append(np.full(len(order), i, np.int32))
                tokens.append(s[order])
                places.append(np.arange(len(order), dtype=np.int32))
                sizes.append(np.full(len(order), n, np.int32))
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), b["cls"].take(take), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), *[b[c].take(take) for c in sides]],
                ["token", "cls", "n", "place", *sides],
            )

    return run


def prefixes(rows: DataFrame, least: float, counts: np.ndarray, sides: tuple[str, ...] = ()) -> DataFrame:
    """(token, cls, n, place, *sides), distinct: the first places of every class's set in the global order."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in sides)
    return rows.select("cls", "shingles", *sides).mapInArrow(_prefixes(shared, least, list(sides)), f"token bigint, cls {rows.schema['cls'].dataType.simpleString()}, n int, place int{kinds}")


def candidates(index: DataFrame, probe: DataFrame, least: float, once: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of an index and a probe class that pass the length and position filters. once: only a < b (self-join)."""
    i = index.select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    p = probe.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - F.lit(1e-6))
    return (
        i.join(p, "token")
        .where((F.col("na") >= F.lit(least) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(least) * F.col("na") - 1e-9))
        .where(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)
        .where(F.col("a") < F.col("b") if once else F.lit(True))
        .select("a", "b")
        .distinct()
    )
