"""Passages of evaluation texts inside training texts (problem 1).

Training texts are scanned once, whatever the number of evaluation texts. A shared run of at least L words holds, wherever it begins,
a window of L - s + 1 words that starts at a multiple of s in the evaluation text (s is a third of L). A filter of fixed size over the
hashes of these windows is all that is broadcast; training texts with a window that passes are kept, with the hashes of the L words
around it. Those meet the evaluation texts' own in an exact join, which names the texts that can have leaked, and where.

Aho-Corasick automata over the evaluation texts that are left then scan the training texts that are left: its patterns are the
windows, every hit is extended both ways to the end of the shared run, which counts if it has L words, and every such run is kept.
Evaluation texts are dealt out to units of at most SHARD_WORDS words, a unit's training texts to as many tasks as they need, so no
task holds more than one unit's automaton and no evaluation text crosses the driver. An automaton works on words, each a code point
of its own; words that no evaluation text has share one code that matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from procmill.llm.cross_split import split_of
from procmill.llm.filters import MOST_BITS, filter_of
from procmill.llm.words import Runs, hash_words, word_spans, words
from procmill.session import materialize, ship, spread

#: Words of the evaluation texts of a unit. There are 1,111,998 code points to use, so every word of an automaton can have its own.
SHARD_WORDS = 1_000_000
#: Training texts of a task, at least.
TASK_TEXTS = 500
#: Words of one piece of a very long evaluation text; pieces overlap by L - 1 words, so no run of L words is lost, and the parts of a
#: run that goes on in the next piece overlap and are joined again.
PIECE_WORDS = 50_000

_UNKNOWN = "\x00"


def _stride(least: int) -> int:
    return max(1, (least + 1) // 3)


def _words_of(least: int):
    """(id, doc, text) to pieces (id, start, words, n, doc): normalised words joined by blanks, and which text they are of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, texts, sizes, docs = [], [], [], [], []
            every = b["doc"].to_pylist() if "doc" in b.schema.names else [b""] * b.num_rows
            for i, doc, t in zip(b["id"].to_pylist(), every, b["text"].to_pylist()):
                ws = words(t)
                for at in range(0, max(len(ws) - least + 1, 0), PIECE_WORDS):
                    piece = ws[at : at + PIECE_WORDS + least - 1]
                    ids.append(i)
                    starts.append(at)
                    texts.append(" ".join(piece))
                    sizes.append(len(piece))
                    docs.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(docs, pa.binary())], ["id", "start", "words", "n", "doc"])

    return run


def _code_points():
    for c in range(1, 0x110000):
        if not 0xD800 <= c < 0xE000:
            yield chr(c)


class Automaton:
    """Windows of the pieces [(key, words)], and the scan of a text against them."""

    def __init__(self, pieces: list[tuple[bytes, str]], least: int):
        import ahocorasick

        self.least, self.stride = least, _stride(least)
        self.window = least - self.stride + 1
        self.keys, self.texts = [p[0] for p in pieces], []
        free, self.codes = _code_points(), {}
        codes = self.codes
        self.machine = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for no, (_, text) in enumerate(pieces):
            ws = text.split(" ")
            for w in ws:
                if w not in codes:
                    codes[w] = next(free)
            coded = "".join(map(codes.__getitem__, ws))
            self.texts.append(coded)
            for at in range(0, len(coded) - self.window + 1, self.stride):
                places.setdefault(coded[at : at + self.window], []).append((no, at))
        for pattern, where in places.items():
            self.machine.add_word(pattern, where if len(where) == 1 else self._by_context(where))
        if places:
            self.machine.make_automaton()
        self.empty = not places

    def _by_context(self, where: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
        """Places of a window that several pieces have, by each run of `least` words around it, so that a text only meets those that it
        shares such a run with."""
        out: dict[str, list[tuple[int, int]]] = {}
        for no, at in where:
            text = self.texts[no]
            for a in range(max(at - self.stride + 1, 0), min(at, len(text) - self.least) + 1):
                out.setdefault(f"{at - a}:{text[a : a + self.least]}", []).append((no, at))
        return out

    def scan(self, ws: list[str]) -> list[tuple[bytes, int, int, int]]:
        """(key, first word here, first word there, words) of every run of at least `least` words that a piece shares and that goes on neither way."""
        if self.empty or len(ws) < self.least:
            return []
        get = self.codes.get
        coded = "".join([get(w, _UNKNOWN) for w in ws])
        runs: list[tuple[bytes, int, int, int]] = []
        done: dict[tuple[int, int], int] = {}
        for end, where in self.machine.iter(coded):
            here = end - self.window + 1
            if isinstance(where, dict):
                around = range(max(here - self.stride + 1, 0), min(here, len(coded) - self.least) + 1)
                where = [p for a in around for p in where.get(f"{here - a}:{coded[a : a + self.least]}", ())]
            for no, there in where:
                diagonal = (no, here - there)
                if done.get(diagonal, -1) > here:  # inside a run already measured
                    continue
                other = self.texts[no]
                a, b = here, there
                while a and b and coded[a - 1] == other[b - 1]:
                    a, b = a - 1, b - 1
                x, y = here + self.window, there + self.window
                while x < len(coded) and y < len(other) and coded[x] == other[y]:
                    x, y = x + 1, y + 1
                done[diagonal] = x
                if x - a >= self.least:
                    runs.append((self.keys[no], a, b, x - a))
        return runs


# ---- which texts can share a run ----

def _windows(least: int):
    """(words) of pieces to the hashes of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = _stride(least)
        for b in batches:
            got = [Runs(hash_words(t.split(" "))).of(least - stride + 1)[::stride] for t in b["words"].to_pylist()]
            h = np.unique(np.concatenate(got)) if got else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return run


def _survivors(shared, least: int):
    """(id, cls, text) to the same and the hashes of the runs of `least` words around windows that pass; texts without any are dropped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, stride = set(), _stride(least)
        for b in batches:
            rows, flat, ends = [], [], [0]
            for k, (c, t) in enumerate(zip(b["cls"].to_pylist(), b["text"].to_pylist())):
                a = hash_words(words(t))
                n = len(a) - least + 1
                if n <= 0:
                    continue
                runs = Runs(a)
                at = np.flatnonzero(shared.value.might(runs.of(least - stride + 1)))
                near = np.zeros(n + stride, bool)
                for j in range(stride):
                    near[np.minimum(at[at >= j] - j, n)] = True
                g = np.unique(runs.of(least)[near[:n]])
                if len(g):
                    rows.append(k)
                    flat += [g] if c not in seen else []  # copies in the same part say the same
                    ends.append(ends[-1] + (len(g) if c not in seen else 0))
                    seen.add(c)
            take = pa.array(rows, pa.int32())
            values = pa.array(np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b["id"].take(take), b["cls"].take(take), b["text"].take(take), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["id", "cls", "text", "runs"])

    return run


def _passing(shared, least: int):
    """(key, words) of pieces to (key, h): the hashes of their runs of `least` words that pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, flat = [], []
            for k, t in enumerate(b["words"].to_pylist()):
                g = np.unique(Runs(hash_words(t.split(" "))).of(least))
                g = g[shared.value.might(g)]
                rows.append(np.full(len(g), k, np.int32))
                flat.append(g)
            if rows:
                yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(flat).view(np.int64))], ["key", "h"])

    return run


# ---- the scan ----

def _scan(least: int, shard_words: int, with_runs: bool):
    """Rows (unit, side, key, text) sorted by unit and side, evaluation texts first, to a row for every shared run, or without with_runs
    for every pair of texts that share one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, pieces, machines = None, [], []
        for b in batches:
            rows: list[tuple] = []
            for u, side, key, text in zip(b["unit"].to_pylist(), b["side"].to_pylist(), b["key"].to_pylist(), b["text"].to_pylist()):
                if u != unit:
                    unit, pieces, machines = u, [], []
                if side == 0:
                    pieces.append((key, text))
                    continue
                if not machines:
                    machines, part, room = [], [], 0
                    for p in pieces:
                        n = p[1].count(" ") + 1
                        if part and room + n > shard_words:
                            machines.append(Automaton(part, least))
                            part, room = [], 0
                        part.append(p)
                        room += n
                    machines.append(Automaton(part, least))
                ws = words(text)
                got = [g for m in machines for g in m.scan(ws)]
                if not with_runs:
                    rows += [(key, k, None, None, None, None, None) for k in {g[0] for g in got}]
                elif got:
                    spans = word_spans(text)
                    rows += [(key, k, here, there, n, spans[here][1], spans[here + n - 1][2]) for k, here, there, n in got]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["cls", "key", "word_at", "eval_word_at", "n_words", "start", "stop"])

    return run


_HITS = "cls binary, key binary, word_at int, eval_word_at int, n_words int, start int, stop int"


def _digest(c: str):
    return F.unhex(F.md5(c))


def _hits(train: DataFrame, evaluation: DataFrame, least: int, shard_words: int, with_runs: bool, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of _scan with the training ids and the evaluation texts (eval_id, eval_doc, piece_at) that hold the pieces."""
    spark = train.sparkSession
    ship(spark)
    share = spark.sparkContext.broadcast
    pieces = spread(evaluation.where("id is not null and text is not null").select("id", _digest("text").alias("doc"), "text")).mapInArrow(_words_of(least), "id string, start int, words string, n int, doc binary")
    pieces = materialize(pieces.select("id", "start", _digest("words").alias("key"), "words", "n", "doc"), "evaluation")
    unique = materialize(pieces.groupBy("key").agg(F.first("words").alias("words"), F.first("n").alias("n")), "patterns")
    total = unique.agg(F.sum("n")).first()[0] or 0
    windows = filter_of(unique.select("words").mapInArrow(_windows(least), "h bigint"), total // _stride(least), most_bits)
    left = spread(train.where("id is not null and text is not null").select("id", _digest("text").alias("cls"), "text")).mapInArrow(_survivors(share(windows), least), "id string, cls binary, text string, runs array<bigint>")
    left = materialize(left, "survivors")
    runs = left.select("cls", F.explode("runs").alias("h"))
    passing = filter_of(runs.select("h"), left.agg(F.sum(F.size("runs"))).first()[0] or 0, most_bits)
    mine = unique.select("key", "words").mapInArrow(_passing(share(passing), least), "key binary, h bigint")
    pairs = materialize(runs.join(mine, "h").select("cls", "key").distinct(), "pairs")

    # units: a share of the evaluation texts that are left each; a unit's training texts are dealt out to slices of the unit
    units = max(-(-(unique.join(pairs.select("key").distinct(), "key", "left_semi").agg(F.sum("n")).first()[0] or 0) // shard_words), 1)
    shard = F.pmod(F.xxhash64("key"), F.lit(units)).cast("int")
    texts = left.join(pairs.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("text").alias("text"))
    wanted = materialize(pairs.select("cls", shard.alias("shard")).distinct().join(texts, "cls"), "wanted")
    each = max(TASK_TEXTS, -(-wanted.count() // (2 * spark.sparkContext.defaultParallelism)))
    slices = wanted.groupBy("shard").agg(F.ceil(F.count("*") / each).cast("int").alias("slices"))
    unit = lambda s: F.concat_ws("-", "shard", s.cast("string")).alias("unit")
    ours = unique.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "words", shard.alias("shard")).join(slices, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("_s"), "key", "words").select(unit(F.col("_s")), F.lit(0).alias("side"), "key", F.col("words").alias("text"))
    theirs = wanted.join(slices, "shard").select(unit(F.pmod(F.xxhash64("cls"), F.col("slices"))), F.lit(1).alias("side"), F.col("cls").alias("key"), "text")
    parts = slices.agg(F.sum("slices")).first()[0] or 1
    hits = materialize(ours.union(theirs).repartition(parts, "unit").sortWithinPartitions("unit", "side").mapInArrow(_scan(least, shard_words, with_runs), _HITS).distinct(), "hits")
    return hits.join(left.select("id", "cls").distinct(), "cls").join(pieces.select("key", F.col("id").alias("eval_id"), F.col("doc").alias("eval_doc"), F.col("start").alias("piece_at")), "key").where("id <> eval_id")


def leaked_pairs(train: DataFrame, evaluation: DataFrame, least: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(train_id, eval_id) of texts that share a run of at least `least` words; of the same rows as leaked_passages."""
    return _hits(train, evaluation, least, shard_words, False).select(F.col("id").alias("train_id"), "eval_id").distinct()


def leaked_passages(train: DataFrame, evaluation: DataFrame, least: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(train_id, eval_id, n_words, word_at, eval_word_at, start, stop): every shared run of at least `least` words that goes on neither way.

    train and evaluation: (id string, text string). start and stop are the run's offsets in the original training text. Equal
    evaluation texts are one pattern, expanded in the result; null, blank and shorter texts match nothing; repeated rows count once;
    ids may be in both tables, but are never paired with themselves. A passage that is at several places of either text is a run at
    each pair of places. Runs cut by the pieces of a long evaluation text are joined. Empty tables give no rows.
    """
    runs = _hits(train, evaluation, least, shard_words, True).withColumn("eval_word_at", F.col("eval_word_at") + F.col("piece_at"))
    same = W.partitionBy("id", "cls", "eval_id", "eval_doc", F.col("word_at") - F.col("eval_word_at")).orderBy("word_at", "n_words")
    before = same.rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_new", (F.col("word_at") >= F.coalesce(F.max(F.col("word_at") + F.col("n_words")).over(before), F.lit(0))).cast("int"))
    runs = runs.withColumn("_diagonal", F.col("word_at") - F.col("eval_word_at")).withColumn("_run", F.sum("_new").over(same.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("id", "cls", "eval_id", "eval_doc", "_diagonal", "_run").agg(F.min("word_at").alias("word_at"), F.min("eval_word_at").alias("eval_word_at"), F.max(F.col("word_at") + F.col("n_words")).alias("_end"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return out.select(F.col("id").alias("train_id"), "eval_id", (F.col("_end") - F.col("word_at")).alias("n_words"), "word_at", "eval_word_at", "start", "stop").distinct()


def _sides(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = split_of()
    one = lambda name: samples.where(s == name).select("id", F.col("raw_text").alias("text"))
    return one("sft"), one("holdout")


def found(samples: DataFrame) -> DataFrame:
    t, e = _sides(samples)
    return leaked_pairs(t, e).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def spans(samples: DataFrame) -> DataFrame:
    """Every leaked passage with its place in the training text; a pair of texts has as many rows as it shares passages."""
    return leaked_passages(*_sides(samples))
