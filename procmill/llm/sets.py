"""Tables of shingle sets: one row for each distinct set (class), with its members beside it.

Rows with equal sets form one class, so exact copies, however many, are compared once; members are expanded only in results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from procmill.llm.words import shingles, words
from procmill.session import drop_shuffles, materialize, ship, spread


@dataclass
class Sets:
    """rows: (cls binary, n int, shingles array<long>, and the columns asked for), as many as there are texts; equal cls, equal set."""

    rows: DataFrame
    keep: list[str]
    numbered: bool = False  # cls is a number instead, and only one row of each class has its set

    @property
    def members(self) -> DataFrame:
        return self.rows.select("cls", *self.keep).distinct()

    @property
    def classes(self) -> DataFrame:
        """(cls, n, shingles), once each where sets are numbered, else as many as there are texts."""
        return self.rows.where("shingles is not null").select("cls", "n", "shingles")

    def of(self, classes: DataFrame) -> DataFrame:
        """(cls, n, shingles) of the classes in `classes`, once each."""
        if self.numbered:
            return self.classes.join(classes.select("cls").distinct(), "cls", "left_semi")
        return self.rows.join(classes.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def _class_of(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _make(k: int, least_words: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = b["_head"].to_pylist() if "_head" in b.schema.names else [None] * b.num_rows
            rows, cls, flat, ends = [], [], [], [0]
            for i, (head, text) in enumerate(zip(heads, b["_text"].to_pylist())):
                ws = words(text)
                if len(ws) < least_words:
                    continue
                s = shingles(words(head) + ws if head else ws, k)
                if not len(s):
                    continue
                rows.append(i)
                cls.append(_class_of(s))
                flat.append(s)
                ends.append(ends[-1] + len(s))
            values = pa.array(np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64))
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls, pa.binary()), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), *[b[c].take(take) for c in keep]],
                ["cls", "n", "shingles", *keep],
            )

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes, each in one part only, to numbers: the part and the place of the class in it. Repeated sets become null."""
    from pyspark import TaskContext

    known: dict[bytes, int] = {}
    part = TaskContext.get().partitionId() << 32
    for b in batches:
        at, new = [], []
        for c in b["cls"].to_pylist():
            new.append(c not in known)
            at.append(part + known.setdefault(c, len(known)))
        first = pa.array([i if x else None for i, x in enumerate(new)], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), b["n"], b["shingles"].take(first), *[b[c] for c in b.schema.names[3:]]], b.schema.names)


def shingle_sets(df: DataFrame, text: Column, keep: dict[str, Column], k: int = 3, least_words: int = 20, head: Column | None = None, name: str = "sets", numbered: bool = False) -> Sets:
    """Sets of runs of k words of the rows of df whose text has at least least_words words (and one run).

    head: another text put before it, which doesn't count for least_words; null is empty. keep: columns of the members by their new
    name. Null texts and texts with fewer words are in no class. Both tables are written once in the shared folder: readers of the
    sets never repeat the work on the texts. numbered: sets are shuffled once, so that a set of many copies is kept once and classes
    have numbers of 8 bytes with much in common.
    """
    spark = df.sparkSession
    ship(spark)
    cols = [c.alias(f"_k_{n}") for n, c in keep.items()]
    src = df.where(text.isNotNull()).select(text.alias("_text"), *([head.alias("_head")] if head is not None else []), *cols)
    kept = [f"_k_{n}" for n in keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*kept).schema)
    made = spread(src).mapInArrow(_make(k, least_words, kept), f"cls binary, n int, shingles array<bigint>, {kinds}")
    made = made.select("cls", "n", "shingles", *[F.col(f"_k_{n}").alias(n) for n in keep])
    if numbered:
        of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields[1:])
        made = made.repartition("cls").mapInArrow(_number, f"cls bigint, {of}")
    return Sets(materialize(made, name), list(keep), numbered)


def jaccard_pairs(pairs: DataFrame, sets: Sets, least: float, held: list[DataFrame] | None = None) -> DataFrame:
    """(a, b, similarity) of the candidate pairs of classes (a, b) whose exact similarity is at least `least`. held: gets the tables
    that can be dropped when the result is written."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    found = materialize(sets.of(ends), "candidates")
    if held is not None:
        held.append(found)
        drop_shuffles(found.sparkSession)
    a = found.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = found.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.size(F.array_intersect("sa", "sb")))
    return (
        pairs.select("a", "b").join(a, "a").join(b, "b")
        .select("a", "b", "na", "nb", both.alias("both"))
        .where(F.col("both") >= F.lit(least) * (F.col("na") + F.col("nb") - F.col("both")) - F.lit(1e-9))
        .select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))
    )
