"""Groups of records that differ by small edits (problem 6).

Circulant MinHash (Li and Li 2021): a first permutation breaks the structure of the shingles, a second one, circularly shifted by
1, 2, ... K places, gives all K signature coordinates, so two permutations replace K. Bands of the signature meet in one shuffle;
candidates are verified by exact Jaccard on the sets, verified links form components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from procmill.llm.components import components
from procmill.llm.prefix import candidates, prefixes, rarity
from procmill.llm.sets import Sets, jaccard_pairs, shingle_sets
from procmill.llm.words import mix
from procmill.session import drop, drop_shuffles, materialize

#: Places of the permutations, bands times rows of the signature, and the bands that a pair has to share to be compared.
#: At similarity 0.6 a pair shares fewer than two of 96 bands of 4 rows with probability 2.5e-5; at 0.1, far above that of unrelated
#: texts, it shares one with probability 0.01 and two with probability 5e-5.
PLACES, BANDS, ROWS, SHARED = 1 << 18, 96, 4, 2
#: Distance up to which a class is a near copy of its leader.
NEAR = 0.1
#: Leaders of a bucket up to which their pairs are counted; larger buckets go through the exact prefix join instead, whose candidates
#: among texts with common phrases are many more than the pairs that share two buckets.
BUCKET = 1 << 13
#: Rows of a bucket that one task sorts, at least; and the sketch that finds larger ones: 8 MB.
HOT, SKETCH_BITS = 200_000, 20
#: Pairs of leaders that are counted at once; more are counted in slices, one after another, by their first class.
AT_ONCE = 50_000_000
#: Bits of a set's sketch, which bounds similarities before sets are sent; and pairs whose sets are sent at once: this many, or one for
#: every four classes.
WIDTH, SETS_AT_ONCE = 1024, 50_000


def _permutation(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(PLACES).astype(np.int32)


def signatures(flat: np.ndarray, ends: np.ndarray, k: int, pi: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """(sets, k): coordinate j of a set is the least value of pi, shifted by j, over sigma's places of its shingles. No set may be empty."""
    at = sigma[(flat >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)]
    wide = np.concatenate([pi, pi[:k]])  # shifting by j is reading j places further on
    out = np.empty((len(ends) - 1, k), np.int32)
    for j in range(k):
        out[:, j] = np.minimum.reduceat(wide[j:][at], ends[:-1])
    return out


def _bands(bands: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, sigma = _permutation(seed), _permutation(seed + 1)
        seen: set = set()
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches:
            keep = []
            for i, c in enumerate(b["cls"].to_pylist()):
                if c not in seen:  # a copy in the same part adds nothing
                    seen.add(c)
                    keep.append(i)
            if not keep:
                continue
            b = b.take(pa.array(keep, pa.int32()))
            ends = np.asarray(b["shingles"].offsets).astype(np.int64)
            flat = b["shingles"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sig = signatures(flat, ends - ends[0], bands * width, pi, sigma).astype(np.uint64).reshape(len(keep), bands, width)
            h = np.zeros((len(keep), bands), np.uint64) + salt
            for r in range(width):
                h = mix(h * np.uint64(31) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), b["cls"].take(pa.array(np.repeat(np.arange(len(keep), dtype=np.int32), bands)))], ["bucket", "cls"])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        total += np.bincount(_counter(b), minlength=1 << SKETCH_BITS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def _counter(b: pa.RecordBatch) -> np.ndarray:
    return (b["bucket"].to_numpy().view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _marked(shared, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["bucket"], b["cls"], pa.array(shared.value[_counter(b)] > limit)], ["bucket", "cls", "hot"])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and class to (bucket, cls, head), head the first class, once each, of buckets with two classes or more."""
    bucket = head = last = None
    for b in batches:
        keys = b["bucket"].to_numpy()
        near = np.zeros(len(keys), bool)  # rows with a neighbour in the same bucket; at the ends of a batch any may have one
        if len(keys):
            eq = keys[1:] == keys[:-1]
            near[1:] |= eq
            near[:-1] |= eq
            near[0] = near[-1] = True
        at = np.flatnonzero(near)
        out: list[tuple] = []
        for k, c in zip(keys[at].tolist(), b["cls"].take(pa.array(at)).to_pylist()):
            if k != bucket:
                bucket, head, last = k, c, c
            elif c != last:
                if last == head:
                    out.append((k, head, head))
                out.append((k, c, head))
                last = c
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), b["cls"].type, b["cls"].type))], ["bucket", "cls", "head"])


def buckets_met(made: DataFrame) -> DataFrame:
    """(bucket, cls, head), distinct: the classes of every bucket of at least two, with the least of them.

    One shuffle of the bands. A bucket that is too large for one task (a sketch of fixed size over all bands tells) is not sorted: its
    head is an aggregate that combines before the shuffle, and its rows meet the head in a join.
    """
    spark = made.sparkSession
    cls = made.schema["cls"].dataType.simpleString()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in made.select("bucket").mapInArrow(_tally, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).toLocalIterator():  # 2 ** SKETCH_BITS rows at most
        counts[r["at"]] = r["n"]
    limit = max(HOT, 4 * int(counts.mean()))
    if not (counts > limit).any():
        return made.repartition("bucket").sortWithinPartitions("bucket", "cls").mapInArrow(_heads, f"bucket bigint, cls {cls}, head {cls}")
    marked = made.mapInArrow(_marked(spark.sparkContext.broadcast(counts), limit), f"bucket bigint, cls {cls}, hot boolean")
    cold = marked.where("not hot").select("bucket", "cls").repartition("bucket").sortWithinPartitions("bucket", "cls").mapInArrow(_heads, f"bucket bigint, cls {cls}, head {cls}")
    hot = materialize(marked.where("hot").select("bucket", "cls").distinct(), "hot")
    heads = hot.groupBy("bucket").agg(F.min("cls").alias("head"), F.max("cls").alias("_last")).where("head < _last").select("bucket", "head")
    return cold.union(hot.join(heads, "bucket").select("bucket", "cls", "head"))


def _clusters(seen: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, root, leader, far): of every class that has met another like it, its component, and the least class within NEAR of it
    that heads one of its buckets, with the distance; a class without one leads itself."""
    near = seen.where(F.col("similarity") >= 1 - NEAR).groupBy(F.col("b").alias("cls")).agg(F.min(F.struct("a", "similarity")).alias("_n"))
    return roots.join(near, "cls", "left").select("cls", "root", F.coalesce("_n.a", "cls").alias("leader"), F.coalesce(1 - F.col("_n.similarity"), F.lit(0.0)).alias("far"))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, n, shingles) to (cls, n, bits): a bit for every shingle, of WIDTH."""
    for b in batches:
        flat = b["shingles"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.asarray(b["shingles"].offsets)
        grid = np.zeros((b.num_rows, WIDTH), np.uint8)
        grid[np.repeat(np.arange(b.num_rows), np.diff(ends)), (mix(flat) & np.uint64(WIDTH - 1)).astype(np.int64)] = 1
        yield pa.RecordBatch.from_arrays([b["cls"], b["n"], pa.array([r.tobytes() for r in np.packbits(grid, axis=1)], pa.binary())], ["cls", "n", "bits"])


def _likely(least: float):
    """Pairs whose similarity may be `least`: of a set's shingles at least as many are not in the other as bits of its sketch are not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("bits_a", "bits_b"))
            na, nb = b["na"].to_numpy(), b["nb"].to_numpy()
            both = np.minimum(na - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            keep = pa.array(both >= least * (na + nb - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(keep)

    return run


def _verified(pairs: DataFrame, sets: Sets, sketches: DataFrame, at_once: int, least: float) -> DataFrame:
    """jaccard_pairs of the pairs that the sketches leave, in slices of `at_once`: however many pairs there are, the disk holds the
    sets of one slice."""
    of = lambda x: sketches.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    kind = sets.rows.schema["cls"].dataType.simpleString()
    likely = materialize(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_likely(least), f"a {kind}, b {kind}"), "likely")
    slices = 1 + likely.count() // at_once
    drop_shuffles(pairs.sparkSession)
    out = None
    for k in range(slices):
        held: list[DataFrame] = []
        part = materialize(jaccard_pairs(likely if slices == 1 else likely.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == k), sets, least, held), "verified")
        drop(*held)
        out = part if out is None else out.union(part)
    drop(likely)
    return out


def _open(most: int):
    """Rows (bucket, leader, root) sorted by bucket and leader to (leaders, roots, crowded): the distinct leaders of every bucket with
    two roots or more, in one row where they are at most `most`, else in rows of a bounded size, marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, leaders, roots, big, kind = None, [], [], False, None
        out: list[tuple] = []

        def flush(last: bool):
            nonlocal leaders, roots, big
            if big or len(leaders) > 1 and (not last or min(roots) < max(roots)):
                out.append((leaders, roots, big or len(leaders) > most))
            big = not last and (big or bool(leaders))
            leaders, roots = [], []

        def batch():
            cols = list(zip(*out)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, kind, pa.bool_()))], ["leaders", "roots", "crowded"])

        for b in batches:
            kind = pa.list_(b["leader"].type)
            keys = b["bucket"].to_numpy()
            near = np.zeros(len(keys), bool)
            if len(keys):
                eq = keys[1:] == keys[:-1]
                near[1:] |= eq
                near[:-1] |= eq
                near[0] = near[-1] = True
            at = np.flatnonzero(near)
            for k, c, r in zip(keys[at].tolist(), b["leader"].take(pa.array(at)).to_pylist(), b["root"].take(pa.array(at)).to_pylist()):
                if k != bucket:
                    flush(True)
                    bucket = k
                elif leaders and leaders[-1] == c:
                    continue
                elif len(leaders) >= 1 << 16:
                    flush(False)  # whether it has other roots is not known yet; pairs of one root are left out later
                leaders.append(c)
                roots.append(r)
            yield batch()
        flush(True)
        if out:
            yield batch()

    return run


def _leader_pairs(few: DataFrame, shared: int) -> DataFrame:
    """(a, b): leaders of different roots that meet in `shared` buckets or more. Pairs are counted in slices, so that the disk holds
    AT_ONCE of them, however many there are."""
    n = F.size("leaders").cast("bigint")
    slices = 1 + (few.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0) // AT_ONCE
    a = few.where("size(leaders) > 1").select("leaders", "roots", F.explode(F.expr("sequence(0, size(leaders) - 2)")).alias("i"))
    out = None
    for k in range(int(slices)):
        mine = a if slices == 1 else a.where(F.pmod(F.xxhash64(F.expr("leaders[i]")), F.lit(int(slices))) == k)
        both = mine.select("leaders", "roots", "i", F.explode(F.expr("sequence(i + 1, size(leaders) - 1)")).alias("j")).select(*[F.expr(x) for x in ("leaders[i] AS a", "leaders[j] AS b", "roots[i] AS ra", "roots[j] AS rb")])
        part = materialize(both.where("a < b and ra <> rb").groupBy("a", "b").agg(F.count("*").alias("_n")).where(F.col("_n") >= shared).select("a", "b"), "met-pairs")
        out = part if out is None else out.union(part)
        drop_shuffles(few.sparkSession)
    return out


def linked(sets: Sets, least: float = 0.6, bands: int = BANDS, rows: int = ROWS, most: int = BUCKET, seed: int = 1, shared: int = SHARED) -> DataFrame:
    """(cls, root): the components of all links between classes that share at least `shared` buckets, for every class with a link.

    No bucket gives all its pairs. First every class is compared with the least class of each of its buckets (stars); verified links
    form components. Only classes of a bucket that are in different components can add anything, and of those only the leaders of
    near copies that share as many buckets are compared. Two classes x, y of the same buckets with similarity `least` or more have leaders P, Q with a distance of at most
    1 - least + 2 NEAR (Jaccard distance is a metric), so leaders are compared down to that; where they are linked, all is said; where
    they are not, classes behind them are compared as far as the triangle inequality leaves a chance. So the components are those of
    all pairs, and n near copies cost n comparisons. A bucket with more than `most` leaders in different components gives no pairs of
    its own: its leaders go through the exact prefix join.
    """
    low = least - 2 * NEAR
    cls = sets.rows.schema["cls"].dataType.simpleString()
    made = materialize(sets.classes.select("cls", "shingles").mapInArrow(_bands(bands, rows, seed), f"bucket bigint, cls {cls}"), "bands")
    drop_shuffles(made.sparkSession)  # that of the sets: just after they were written, Spark may still hold it
    met = materialize(buckets_met(made), "met")
    drop(made)
    sketched = sets.classes.mapInArrow(_sketched, f"cls {cls}, n int, bits binary")
    sketches = materialize(sketched if sets.numbered else sketched.dropDuplicates(["cls"]), "sketches")
    at_once = max(SETS_AT_ONCE, sketches.count() // 4)
    stars = materialize(met.where("cls <> head").groupBy(F.col("head").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("_n")).where(F.col("_n") >= shared).select("a", "b"), "stars")
    seen = _verified(stars, sets, sketches, at_once, low)
    over = F.col("similarity") >= least - 1e-12
    who = materialize(_clusters(seen, components(seen.where(over).select("a", "b"))), "clusters")
    roots = who.select("cls", "root")

    lead = materialize(met.select("bucket", "cls").join(who, "cls", "left").select("bucket", F.coalesce("leader", "cls").alias("leader"), F.coalesce("root", "cls").alias("root")), "leaders")
    drop(met)
    open_ = materialize(lead.repartition("bucket").sortWithinPartitions("bucket", "leader").mapInArrow(_open(most), f"leaders array<{cls}>, roots array<{cls}>, crowded boolean"), "open")
    drop(lead)
    pairs = _leader_pairs(open_.where("not crowded"), shared)
    crowded = open_.where("crowded").select(F.explode(F.arrays_zip("leaders", "roots")).alias("x")).select(F.col("x.leaders").alias("cls"), F.col("x.roots").alias("root")).distinct()
    if not crowded.isEmpty():
        part = materialize(sets.of(crowded), "crowded")
        first = materialize(prefixes(part, low, rarity(part)), "crowded-prefixes")
        end = lambda x: crowded.select(F.col("cls").alias(x), F.col("root").alias(f"r{x}"))
        pairs = pairs.union(candidates(first, first, low, once=True).join(end("a"), "a").join(end("b"), "b").where("ra <> rb").select("a", "b")).distinct()
    pairs = materialize(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    drop(open_)
    more = _verified(pairs, sets, sketches, at_once, low)

    # classes behind leaders that are not linked, but not far from it
    inside = who.select("cls", "leader", "far").union(who.where("cls <> leader").select(F.col("leader").alias("cls"), "leader", F.lit(0.0))).distinct()
    of = lambda x: inside.select(F.col("leader").alias(x), F.col("cls").alias(f"c{x}"), F.col("far").alias(f"f{x}"))
    root = lambda x: who.select(F.col("cls").alias(x), F.col("root").alias(f"r{x}"))
    border = seen.union(more).where(~over).join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    border = border.select("a", "b", "similarity").join(of("a"), "a", "left").join(of("b"), "b", "left").select("similarity", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"), F.coalesce("fa", F.lit(0.0)).alias("fx"), F.coalesce("fb", F.lit(0.0)).alias("fy"))
    border = border.where((F.col("fx") + F.col("fy") > 0) & (F.col("fx") + F.col("fy") >= least - F.col("similarity") - 1e-9)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
    behind = _verified(materialize(border, "border"), sets, sketches, at_once, least)
    added = materialize(more.where(over).select("a", "b").union(behind.select("a", "b")), "added")
    if added.isEmpty():
        return roots
    # only components that an added link touches are joined; the others stay as they are
    ends = added.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    over_roots = components(materialize(ends, "ends")).select(F.col("cls").alias("root"), F.col("root").alias("_to"))
    new = added.select(F.explode(F.array("a", "b")).alias("cls")).join(roots, "cls", "left_anti").distinct().select("cls", F.col("cls").alias("root"))
    return roots.union(new).join(over_roots, "root", "left").select("cls", F.coalesce("_to", "root").alias("root"))


def sample_sets(samples: DataFrame, k: int = 3, least_words: int = 20, numbered: bool = False) -> Sets:
    """Sets of title (null as empty) followed by raw_text, of samples with at least least_words words in raw_text."""
    return shingle_sets(samples.where("id is not null"), F.col("raw_text"), {"id": F.col("id")}, k, least_words, head=F.col("title"), name="near", numbered=numbered)


def groups(samples: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, root): every sample in a class of copies or in a chain of links, by the root class of its group.

    Null and blank texts and those of fewer than 20 words are in no group. Repeated rows count once. An empty table gives no rows.
    """
    sets = sample_sets(samples, numbered=True)
    roots = linked(sets, least)
    m = materialize(sets.members, "members")
    g = materialize(m.join(roots, "cls", "left").select("id", F.coalesce("root", "cls").alias("root")).distinct(), "groups")
    drop(m, sets.rows)
    return g


def found(samples: DataFrame) -> DataFrame:
    """(id_a, id_b): every two samples of one group. The result itself is quadratic in a group's size, as the problem asks."""
    g = groups(samples)
    many = g.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    ids = g.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again"))  # ids with texts in several groups
    g = g.join(many, "root", "left_semi").join(ids, "id", "left").select("id", "root", F.coalesce("again", F.lit(False)).alias("again"))
    a, b = (g.select("root", F.col("id").alias(f"id_{x}"), F.col("again").alias(f"again_{x}")) for x in "ab")
    pairs = a.join(b, "root").where("id_a < id_b")
    both = F.col("again_a") & F.col("again_b")  # only these two can meet in more than one group
    return pairs.where(~both).select("id_a", "id_b").union(pairs.where(both).select("id_a", "id_b").distinct())


def group_report(samples: DataFrame) -> DataFrame:
    """One row for each sample in a group of at least two: its group (least id in it) and the group's size."""
    g = groups(samples)
    n = g.groupBy("root").agg(F.count("*").alias("n_members"), F.min("id").alias("group_id")).where("n_members > 1")
    return g.join(n, "root").select("id", "group_id", "n_members")
