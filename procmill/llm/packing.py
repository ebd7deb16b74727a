"""Filling containers of fixed capacity with items (problem 8).

Cost-balanced packing: an item of t tokens costs t + ATTENTION * t * t (the linear layers, and attention within the item). Items are
spread over blocks of about BLOCK items by a hash of their key; within a block they are assigned in descending order to the
container of lowest cost among those with room. An item longer than the capacity is split: its full pieces fill containers of their
own, the rest is an item like others. Only (key, size) pairs are moved, never texts.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from procmill.llm.encode import TOKENIZER, token_sizes
from procmill.session import materialize

#: Quadratic against linear cost of a token, for a hidden size of 4096: 1 / (6 * 4096).
ATTENTION = 1 / 24576
#: Items of a block on average; a block is packed by one task and wastes at most about one container.
BLOCK = 25_000
#: Share of containers above the least number possible up to which the balanced packing stands.
SLACK = 0.02

PACKED = "budget_name string, capacity_tokens int, doc_id bigint, piece_no int, n_tokens int, container_id string"


class _Open:
    """Open containers by room left: the cheapest with room for t is found in O(log capacity)."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.best: list[tuple] = [(math.inf,)] * (2 * self.base)
        self.heaps: dict[int, list] = {}

    def _fix(self, room: int) -> None:
        h = self.heaps.get(room)
        k, v = self.base + room, (h[0] if h else (math.inf,))
        while k and self.best[k] != v:
            self.best[k] = v
            k >>= 1
            if k:
                a, b = self.best[2 * k], self.best[2 * k + 1]
                v = a if a < b else b

    def put(self, room: int, cost: float, no: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, no, room))
        self._fix(room)

    def take(self, t: int) -> tuple | None:
        """The cheapest container with room for t tokens, taken out."""
        lo, hi, found = self.base + t, 2 * self.base, (math.inf,)
        while lo < hi:
            if lo & 1:
                found = min(found, self.best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                found = min(found, self.best[hi])
            lo, hi = lo >> 1, hi >> 1
        if found[0] == math.inf:
            return None
        heapq.heappop(self.heaps[found[2]])
        self._fix(found[2])
        return found


def pack(sizes: list[int], capacity: int, attention: float = ATTENTION, slack: float = SLACK) -> list[int]:
    """The container (0, 1, ...) of each item; no item may be longer than the capacity.

    Cost-balanced packing; where it needs over `slack` more containers than the least number possible, and tightest fit needs
    fewer, tightest fit's containers count.
    """
    out = balanced(sizes, capacity, attention)
    if out and max(out) + 1 > (1 + slack) * -(-sum(sizes) // capacity):
        tight = tightest(sizes, capacity)
        if max(tight) < max(out):
            return tight
    return out


def tightest(sizes: list[int], capacity: int) -> list[int]:
    """Best fit, descending: an item goes to the container with the least room that holds it, lowest number among equals."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rooms: list[tuple[int, int]] = []
    out, n = [0] * len(sizes), 0
    for i in order:
        k = bisect.bisect_left(rooms, (sizes[i], -1))
        if k == len(rooms):
            left, no, n = capacity, n, n + 1
        else:
            left, no = rooms.pop(k)
        out[i] = no
        bisect.insort(rooms, (left - sizes[i], no))
    return out


def balanced(sizes: list[int], capacity: int, attention: float = ATTENTION) -> list[int]:
    """Descending, each item to the container of lowest cost with room.

    As many containers are opened as the items need at least; whatever then fits in none opens further ones. Ties in size keep the
    order given, ties in cost take the lowest container. Items of no tokens go where the cost is lowest.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out, room = [0] * len(sizes), _Open(capacity)
    n = -(-sum(sizes) // capacity)
    for no in range(n):
        room.put(capacity, 0.0, no)
    for i in order:
        t = sizes[i]
        got = room.take(t)
        if got is None:
            got, n = (0.0, n, capacity), n + 1
        cost, no, left = got
        out[i] = no
        room.put(left - t, cost + t + attention * t * t, no)
    return out


def _blocks(attention: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        name, capacity, block = (k.as_py() for k in key)
        ids, tokens = rows["doc_id"].to_pylist(), rows["n_tokens"].to_pylist()
        items: list[tuple[int, int, int, int]] = []  # doc, piece, size, container or -1
        full = 0
        for d, t in sorted(zip(ids, tokens), key=lambda x: (x[0], x[1])):
            pieces = t // capacity if t > capacity else 0
            for p in range(pieces):
                items.append((d, p, capacity, full))
                full += 1
            if t - pieces * capacity or not pieces:
                items.append((d, pieces, t - pieces * capacity, -1))
        loose = [i for i, x in enumerate(items) if x[3] < 0]
        where = [x[3] for x in items]
        for i, no in zip(loose, pack([items[i][2] for i in loose], capacity, attention)):
            where[i] = full + no
        n = len(items)
        return pa.table({
            "budget_name": pa.array([name] * n, pa.string()), "capacity_tokens": pa.array([capacity] * n, pa.int32()), "doc_id": pa.array([x[0] for x in items], pa.int64()), "piece_no": pa.array([x[1] for x in items], pa.int32()),
            "n_tokens": pa.array([x[2] for x in items], pa.int32()), "container_id": pa.array([f"{name}-{block}-{w}" for w in where], pa.string()),
        })

    return run


def packed(sizes: DataFrame, budgets: DataFrame, block: int = BLOCK, attention: float = ATTENTION) -> DataFrame:
    """(budget_name, capacity_tokens, doc_id, piece_no, n_tokens, container_id) for every item and every budget.

    sizes: (doc_id, n_tokens); budgets: (budget_name, capacity_tokens), a parameter table of at most 1,000 rows, of which null and
    non-positive capacities are ignored. Documents without tokens are placed too. Repeated rows of a document are items of their own.
    """
    known = [(r[0], r[1]) for r in budgets.where("capacity_tokens > 0").select("budget_name", "capacity_tokens").distinct().limit(1001).collect()]
    if len(known) > 1000:
        raise ValueError("more than 1,000 budgets")
    if not known:
        return sizes.sparkSession.createDataFrame([], PACKED)
    blocks = max(1, -(-sizes.count() // block))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(c).cast("int").alias("capacity_tokens")) for n, c in sorted(known, key=str)]))
    rows = sizes.where("doc_id is not null").select(each.alias("b"), "doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).select("b.*", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "n_tokens")
    return rows.groupBy("budget_name", "capacity_tokens", "block").applyInArrow(_blocks(attention), PACKED)


def packing(documents: DataFrame, budgets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return packed(materialize(token_sizes(documents, path=path), "sizes"), budgets)


def containers(documents: DataFrame, budgets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per container: items, tokens, unused room and cost."""
    cost = F.sum(F.col("n_tokens") + F.lit(ATTENTION) * F.col("n_tokens") * F.col("n_tokens"))
    return packing(documents, budgets, path).groupBy("budget_name", "container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.first(F.col("capacity_tokens")).alias("capacity"), cost.alias("cost")).withColumn("unused", F.col("capacity") - F.col("n_tokens"))


def fill(documents: DataFrame, budgets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per budget: containers, the least number possible, the filled share, and the spread of cost."""
    c = containers(documents, budgets, path)
    return c.groupBy("budget_name").agg(F.count("*").alias("n_containers"), F.ceil(F.sum("n_tokens") / F.first("capacity")).alias("least_containers"), (F.sum("n_tokens") / F.sum("capacity")).alias("filled"), F.avg("cost").alias("mean_cost"), F.stddev_pop("cost").alias("std_cost"))
