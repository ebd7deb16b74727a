"""Rows sent to an outside service (a model, say) from the executors: in order, at a limited rate, tried again, failures as rows.

The client is pluggable: a picklable function that makes a callable once per task, so queries can start from stored answers and tests
from a plain function. A rate holds per task; the whole rate is that times the tasks that run at once.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from procmill.operators.pipeline import shortened
from procmill.session import ship

RESULT = "status string, answer string, tries int, error_type string, error_message string"


class Limiter:
    """At most `rate` turns a second, evenly spaced; 0 is no limit."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.free = 1 / rate if rate else 0.0, clock, sleep, 0.0

    def turn(self) -> None:
        now = self.clock()
        wait, self.free = max(0.0, self.free - now), max(now, self.free) + self.gap
        if wait:
            self.sleep(wait)


def attempt(f: Callable[[str], str], prompt: str | None, tries: int, base: float, seed: int, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(status, answer, tries used, error type, message): pauses of base * 2^k with jitter between tries. A null prompt is skipped."""
    if prompt is None:
        return "skipped", None, 0, None, None
    rng = random.Random(seed)
    for k in range(1, tries + 1):
        try:
            return "succeeded", f(prompt), k, None, None
        except Exception as e:  # noqa: BLE001 - whatever the service does is the row's result
            error = e
            if k < tries:
                sleep(base * 2 ** (k - 1) * (0.5 + rng.random()))
    return "failed", None, tries, type(error).__name__, shortened(str(error))


def call_rows(df: DataFrame, keys: Sequence[str], prompt: str, client: Callable[[], Callable[[str], str]], rate: float = 0.0, tries: int = 3, base: float = 1.0, workers: int = 4) -> DataFrame:
    """(keys, status, answer, tries, error_type, error_message) for each row; rows keep their order within a part."""
    ship(df.sparkSession)
    src = df.select(*keys, F.col(prompt).alias("_prompt"))
    kinds = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, limit = client(), Limiter(rate)

        def once(p: str) -> str:
            limit.turn()
            return call(p)

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                got = list(pool.map(lambda x: attempt(once, x[1], tries, base, x[0]), enumerate(b["_prompt"].to_pylist())))
                cols = list(zip(*got)) or [()] * 5
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*[b[k] for k in keys], *[pa.array(c, t) for c, t in zip(cols, types)]], [*keys, "status", "answer", "tries", "error_type", "error_message"])

    return src.mapInArrow(run, f"{kinds}, {RESULT}")
