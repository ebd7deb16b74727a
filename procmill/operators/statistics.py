"""Per-item aggregates and paired inference. Rows meet in joins and windows; only group sums and report rows are small.

Columns by name: arm, item, value. NULL values are 0 in medians (a missing score counts as none), as long as the row exists.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from procmill.operators.ranks import exact_ranks, same, with_average_rank
from procmill.session import materialize, ship, spread


def item_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per key; null counts as 0."""
    return df.groupBy(*keys).agg(F.median(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias(name))


def arm_means(medians: DataFrame, arm: str, value: str = "median") -> DataFrame:
    return medians.groupBy(arm).agg(F.count("*").alias("n_items"), F.avg(value).alias("mean"))


def item_spread(df: DataFrame, arm: str, item: str, value: str) -> DataFrame:
    """Per arm: items with more than one row, the widest max - min among them, and how many have any."""
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    per = df.groupBy(arm, item).agg(F.count("*").alias("n"), (F.max(v) - F.min(v)).alias("spread")).where("n > 1")
    return per.groupBy(arm).agg(F.count("*").alias("n_items"), F.max("spread").alias("max_spread"), F.sum((F.col("spread") > 0).cast("int")).alias("n_divergent"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Nearest-rank quantiles sorted[min(n - 1, int(p * n))], exact, by exact_ranks; nulls are left out."""
    c = exact_ranks(df, keys, value)
    at = lambda p: F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total")))
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"q{round(p * 100)}") for p in shares])


def average_rank(value: str, keys: Sequence[str] = (), order: Column | None = None) -> Column:
    """The rank of a value within its keys, ties sharing the mean of their ranks; for keys of bounded size (else ranks.with_average_rank)."""
    o = order if order is not None else F.col(value)
    return F.rank().over(W.partitionBy(*keys).orderBy(o)) + (F.count("*").over(W.partitionBy(*keys, o)) - 1) / 2.0


def paired(medians: DataFrame, arm: str, item: str, a: str, b: str, value: str = "median") -> DataFrame:
    """(item, a, b, d) of items that both arms have; d = a - b."""
    one = lambda x, n: medians.where(F.col(arm) == x).select(item, F.col(value).alias(n))
    return one(a, "a").join(one(b, "b"), item).withColumn("d", F.col("a") - F.col("b"))


def rank_biserial(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(wins - losses) / (wins + losses), 0 without any."""
    s = pairs.groupBy(*keys).agg(F.sum((F.col("d") > 0).cast("int")).alias("wins"), F.sum((F.col("d") < 0).cast("int")).alias("losses"))
    return s.withColumn("effect", F.when(F.col("wins") + F.col("losses") > 0, (F.col("wins") - F.col("losses")) / (F.col("wins") + F.col("losses"))).otherwise(0.0))


def signed_rank(pairs: DataFrame, keys: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Wilcoxon's signed-rank sums: zeros dropped, ties averaged. (keys, n, w_plus, w_minus, ties = sum of t^3 - t).

    Differences are rounded to `digits` first, so that sums that differ in their last bits only still tie.
    """
    k = list(keys)
    d = pairs.select(*k, F.round("d", digits).alias("_d")).where("_d <> 0").select(*k, F.abs("_d").alias("_a"), (F.col("_d") > 0).cast("bigint").alias("_up"))
    r = exact_ranks(d, k, "_a").select(*k, "_a", "n", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("_r"))
    ups = d.groupBy(*k, "_a").agg(F.sum("_up").alias("_p"))
    x = r.join(ups, same(r, ups, [*k, "_a"])).select(*[r[c] for c in k], "n", "_r", "_p")  # a row for each distinct size, however many pairs share it
    n = F.col("n")
    return x.groupBy(*k).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.sum(F.col("_p") * F.col("_r")).alias("w_plus"), F.sum((n - F.col("_p")) * F.col("_r")).alias("w_minus"), F.sum(n * (n * n - 1)).alias("ties"))


def signed_rank_p(n: int, w_plus: float, ties: float) -> float:
    """Two-sided p of w_plus: exact up to 50 pairs without ties, else normal with tie correction; 1 without pairs."""
    if not n:
        return 1.0
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        low = int(min(w_plus, n * (n + 1) / 2 - w_plus))
        return min(1.0, 2 * sum(ways[: low + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if var <= 0:
        return 1.0
    return math.erfc(abs(w_plus - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2))


def wilcoxon(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """signed_rank with its p-value; one Arrow batch of report rows."""
    @F.pandas_udf("double")
    def p(n, w, t):
        import pandas as pd

        return pd.Series([signed_rank_p(int(a), float(b), float(c)) for a, b, c in zip(n, w, t)])

    return signed_rank(pairs, keys).withColumn("p", p("n", "w_plus", "ties"))


def holm(df: DataFrame, p: str, keys: Sequence[str], family: Sequence[str] = ()) -> DataFrame:
    """Holm's step-down adjustment within a family; ties in p by keys."""
    w = W.partitionBy(*family).orderBy(p, *keys)
    m = F.count("*").over(W.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks; null if either side is constant or has fewer than two values. Rows with nulls are left out."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    d = with_average_rank(with_average_rank(d, keys, x, "_x"), keys, y, "_y")
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("_x", "_y").alias("_c"), F.stddev_pop("_x").alias("_a"), F.stddev_pop("_y").alias("_b"))
    return s.withColumn("rho", F.try_divide("_c", F.col("_a") * F.col("_b"))).drop("_c", "_a", "_b")


def concordance(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """P(a > b) + P(a = b) / 2 per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col(a) > F.col(b), 1.0).when(F.col(a) == F.col(b), 0.5).otherwise(0.0)).alias("concordance"))


def verdict(low: Column, high: Column, margin: float) -> Column:
    """equivalent, superior, inferior or inconclusive, by an interval and a margin; all inequalities strict."""
    return F.when((low > -margin) & (high < margin), "equivalent").when(low > margin, "superior").when(high < -margin, "inferior").otherwise("inconclusive")


def draw(seed: int, b: Column, i: Column, n: Column) -> Column:
    """A number in 0..n-1 from (seed, b, i), the same on every engine: the leading 8 hex digits of an md5, modulo n."""
    h = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), b.cast("string"), i.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), n)


def bootstrap(values: DataFrame, value: str, order: str, times: int, seed: int, stat: str = "mean") -> DataFrame:
    """(b, stat): the mean or median of `times` resamples of the rows. The values are one per item, numbered by `order`.

    Every slot of every resample draws its item where the slot's row is, so nothing is dealt out first; for means the drawn values are
    summed before the shuffle, which holds `times` rows a task. The numbers come from exact ranks, not from one sorted task. Drawn
    items meet their values in a join that is broadcast only where Spark finds the items small.
    """
    numbered = exact_ranks(values.where(F.col(value).isNotNull()), [], order).select((F.col("upto") - 1).alias("_i"), F.col(order).alias("_o"), F.col("total").alias("_n"))
    held = values.where(F.col(value).isNotNull()).select(F.col(order).alias("_o"), F.col(value).alias("_v"))
    numbered = materialize(numbered.join(held, "_o").select("_i", "_v", "_n"), "items")
    slots = spread(numbered.select("_i", "_n")).select("_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("b"))
    drawn = slots.select("b", draw(seed, F.col("b"), F.col("_i"), F.col("_n")).alias("_i")).join(numbered.select("_i", "_v"), "_i")
    if stat == "mean":
        return drawn.groupBy("b").agg(F.avg("_v").alias("stat"))
    return drawn.groupBy("b", "_v").agg(F.count("*").alias("_w")).groupBy("b").agg(F.percentile("_v", 0.5, F.col("_w")).alias("stat"))


def interval(stats: DataFrame, times: int | None = None, alpha: float = 0.05, upper_less_one: bool = False) -> DataFrame:
    """(low, high) at sorted positions int(alpha / 2 * n) and int((1 - alpha / 2) * n), the upper one less 1 if asked; n is `times`, or else the number of rows."""
    ranked = stats.select("stat", (F.row_number().over(W.orderBy("stat")) - 1).alias("_k"), (F.lit(times) if times else F.count("*").over(W.partitionBy())).alias("_n"))
    lo, hi = F.floor(F.lit(alpha / 2) * F.col("_n")), F.least(F.floor(F.lit(1 - alpha / 2) * F.col("_n")) - int(upper_less_one), F.col("_n") - 1)
    return ranked.agg(F.min(F.when(F.col("_k") == lo, F.col("stat"))).alias("low"), F.min(F.when(F.col("_k") == hi, F.col("stat"))).alias("high"))


#: Rows of a chunk of the cluster bootstrap, at least, and numbers that a task keeps for the values of x of its resamples.
CHUNK, KEPT = 1 << 18, 1 << 24
#: Resamples whose weights stand side by side, rows of a group up to which groups are added up together, and groups of a tile.
WIDE, LONG, TILE = 64, 256, 2048


def _md5_heads(seed: int, b: int, n: int):
    """The leading 32 bits of md5 of "seed-b-i" for i in 0..n-1, as in draw(); many at once where numbers of as many digits are many."""
    import hashlib

    import numpy as np

    head = f"{seed}-{b}-".encode()
    each = lambda low, high: np.frombuffer(b"".join([hashlib.md5(b"%b%d" % (head, i)).digest()[:4] for i in range(low, high)]), ">u4").astype(np.uint32)
    if len(head) + len(str(n)) > 55:
        return each(0, n)
    turns = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    out, low = np.empty(n, np.uint32), 0
    while low < n:
        size = len(str(low))
        high = min(n, 10**size, low + (1 << 14))
        if high - low < 1 << 11:
            out[low:high] = each(low, high)
            low = high
            continue
        i, k = np.arange(low, high), len(head) + size
        text = np.zeros((high - low, (k + 4) // 4 * 4), np.uint8)
        text[:, : len(head)] = np.frombuffer(head, np.uint8)
        for j in range(size):
            text[:, k - 1 - j] = i // 10**j % 10 + 48
        text[:, k] = 0x80
        m = [np.ascontiguousarray(w) for w in text.view("<u4").T] + [np.uint32(0)] * 16
        m = m[:14] + [np.uint32(8 * k), np.uint32(0)]
        start = tuple(np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        x, y, z, w = (np.full(high - low, v, np.uint32) for v in start)
        for r in range(64):
            if r < 16:
                f, g = w ^ (y & (z ^ w)), r
            elif r < 32:
                f, g = z ^ (w & (y ^ z)), (5 * r + 1) % 16
            elif r < 48:
                f, g = y ^ z ^ w, (3 * r + 5) % 16
            else:
                f, g = z ^ (y | ~w), 7 * r % 16
            f += x
            f += np.uint32(int(abs(math.sin(r + 1)) * 2**32) & 0xFFFFFFFF)
            if g < 15:
                f += m[g]
            t = turns[r // 16][r % 4]
            turned = f << np.uint32(t)
            turned |= f >> np.uint32(32 - t)
            turned += y
            x, w, z, y = w, z, y, turned
        out[low:high] = (x + start[0]).byteswap()
        low = high
    return out


def _packed(batches):
    """Rows (c, x, y) sorted by y, x, c to chunks (part, seq, c, n, g, gx, ys): clusters and their copies, rows and x of each pair of
    x and y, pairs of each y, as numbers of the least size. A value of y is in one chunk only."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    small = lambda v: v.astype(np.min_scalar_type(int(v.max()) if len(v) else 0))
    part, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def chunk(t):
        nonlocal seq
        c, x = t["c"].to_numpy(), t["x"].to_numpy()
        new_y = _changes(pc, np, t["y"])
        new_g = new_y | np.concatenate([[True], x[1:] != x[:-1]])
        new = np.flatnonzero(new_g | np.concatenate([[True], c[1:] != c[:-1]]))
        n = np.diff(np.append(new, len(c)))
        g, ys = np.flatnonzero(new_g[new]), np.flatnonzero(new_y[new][new_g[new]])
        parts = [c[new], n, np.diff(np.append(g, len(new))), x[new][g], np.diff(np.append(ys, len(g)))]
        seq += 1
        cells = [f for v in map(small, parts) for f in (v.dtype.str, v.tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([",".join(cells[::2])]), *[pa.array([v], pa.binary()) for v in cells[1::2]]], ["part", "seq", "kinds", "c", "n", "g", "gx", "ys"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_changes(pc, np, t["y"]))[-1])
            held, rows = [t], t.num_rows
            if last:
                yield chunk(t.slice(0, last))
                held, rows = [t.slice(last)], t.num_rows - last
            held = [x for t in held for x in t.to_batches()]
    if rows:
        yield chunk(pa.Table.from_batches(held).combine_chunks())


def _changes(pc, np, y):
    """Where a sorted column has another value than in the row before; NaN is like NaN."""
    y = y.combine_chunks() if hasattr(y, "combine_chunks") else y
    out = np.ones(len(y), bool)
    a, b = y.slice(1), y.slice(0, len(y) - 1)
    differ = pc.not_equal(a, b)
    if str(y.type) in ("double", "float"):
        differ = pc.and_not(differ, pc.and_(pc.is_nan(a), pc.is_nan(b)))
    out[1:] = differ.to_numpy(zero_copy_only=False)
    return out


def _group_sums(c, n, g):
    """Rows in groups that begin at g to a function of weights (clusters, resamples): (groups, resamples), the sums of the rows'
    weights. The weights of a cluster are read side by side, and the first rows of all groups are added at once, then the second ones."""
    import numpy as np

    size = np.diff(np.append(g, len(c)))
    most = float(np.add.reduceat(n, g).max()) if n is not None else float(size.max())
    if most == 1:
        return lambda w: w.take(c, axis=0)
    order = np.argsort(-size, kind="stable")
    first, size, back = g[order], size[order], np.argsort(order)
    big = int((size > LONG).sum())
    runs = [(int(a), int(a + k)) for a, k in zip(first[:big], size[:big])]
    layers = [first[big : int((size > k).sum())] + k for k in range(int(size[big]) if big < len(size) else 0)]

    def sums(w):
        kind = np.float64 if n is not None or most * int(w.max()) >= 1 << 32 else np.uint16 if most * int(w.max()) < 1 << 16 else np.uint32
        acc = np.zeros((len(g), w.shape[1]), kind)
        for k, (a, end) in enumerate(runs):
            for at in range(a, end, 1 << 14):
                v = w.take(c[at : min(end, at + (1 << 14))], axis=0)
                acc[k] += np.add.reduce(v if n is None else v * n[at : min(end, at + (1 << 14)), None], 0, dtype=kind)
        for rows in layers:
            v, to = w.take(c[rows], axis=0), acc[big : big + len(rows)]
            to += v if n is None else v * n[rows, None]
        return acc.take(back, axis=0)

    return sums


def _running(m):
    """Running sums down the columns, 16 rows at a time."""
    import numpy as np

    out = m.copy()
    whole = len(m) // 16 * 16
    if whole:
        v = out[:whole].reshape(-1, 16, m.shape[1])
        for k in range(1, 16):
            v[:, k] += v[:, k - 1]
        v[1:] += np.cumsum(v[:-1, -1], axis=0, dtype=m.dtype)[:, None]
    for k in range(max(whole, 1), len(m)):
        out[k] += out[k - 1]
    return out


def _tiles(c, n, g, gx, ys):
    """A chunk to functions of weights (clusters, resamples), for about TILE groups each: (end, values of x, m, v, cubes, most), the sum of
    all weights, and for each value of x the sum of the weights and of weights times twice their mean rank in the tile; sum of cubes and
    maximum of the weights of each y. Whole numbers of 4 bytes where they are enough."""
    import numpy as np

    y0 = np.cumsum(ys) - ys
    cuts = np.unique(np.searchsorted(y0, np.arange(0, len(g), TILE)))
    for ya, yb in zip(cuts, np.append(cuts[1:], len(ys))):
        if ya == yb:
            continue
        a, b = int(y0[ya]), int(y0[yb]) if yb < len(ys) else len(g)
        ra, rb = int(g[a]), int(g[b]) if b < len(g) else len(c)
        sums = _group_sums(c[ra:rb], None if n is None else n[ra:rb], g[a:b] - ra)
        rows = float(rb - ra if n is None else n[ra:rb].sum())
        first, by_x = y0[ya:yb] - a, np.argsort(gx[a:b], kind="stable")
        last, of_y = np.append(first[1:], b - a) - 1, np.repeat(np.arange(yb - ya), ys[ya:yb])
        kinds = gx[a:b][by_x]
        at = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
        ends = np.append(at[1:], b - a)

        def by(v, by_x=by_x, at=at, ends=ends):
            v = v.take(by_x, axis=0)
            if len(at) > 64:
                return np.add.reduceat(v, at, axis=0)
            return np.array([np.add.reduce(v[i:j], 0, dtype=v.dtype) for i, j in zip(at, ends)])

        def run(w, sums=sums, rows=rows, first=first, last=last, of_y=of_y, x=kinds[at], by=by):
            most = rows * int(w.max())
            m = sums(w).astype(np.int32 if 2 * most * most < 1 << 31 else np.float64)
            r = _running(m)
            end = r[-1].astype(float)
            if len(first) == len(m):
                t = m
                r += r
                r -= m
            else:
                high, low = r.take(last, axis=0), r.take(first, axis=0) - m.take(first, axis=0)
                t = high - low
                r = (high + low).take(of_y, axis=0)
            top = t.max(axis=0)
            u = t if most * float(top.max()) ** 2 < 1 << 31 else t.astype(float)
            return end, x, by(m).astype(float), by(np.multiply(m, r, out=r)).astype(float), np.add.reduce(u * u * u, 0, dtype=u.dtype), top

        yield run


def _weighted_rhos(clusters: int, xs: int, rows: int, times: int, blocks: int, seed: int):
    """All chunks, in order, with the number of a block to (b, n, rho) of the resamples b of that block: weights of clusters, no rows are
    copied. With w the weight of a row, ranks of y follow from running sums, and those of x at the end, from sums for each value of x."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def weights(bs):
        """(clusters, resamples)"""
        out = np.zeros((len(bs), clusters), np.uint8)
        for k, b in enumerate(bs):
            w = np.bincount(_md5_heads(seed, b, clusters) % np.uint32(clusters), minlength=clusters)
            if w.max() > 255 and out.dtype == np.uint8:
                out = out.astype(np.uint32)
            out[k] = w
        return np.ascontiguousarray(out.T)

    def unpacked(cells):
        c, n, g, gx, ys = (np.frombuffer(v, k) for k, v in zip(cells["kinds"].split(","), (cells[x] for x in ("c", "n", "g", "gx", "ys"))))
        c, n, g = c.astype(np.intp), n.astype(np.intp), np.cumsum(g, dtype=np.intp) - g
        if n.sum() <= 2 * len(n):  # few copies are rows like others
            c, n, g = np.repeat(c, n), None, (np.cumsum(n) - n)[g]
        return c, None if n is None else n.astype(float), g, gx.astype(np.intp), ys.astype(np.intp)

    def rhos(chunks, bs):
        w_all = [(at, weights(bs[at : at + WIDE])) for at in range(0, len(bs), WIDE)]
        upto, cubes, most = np.zeros(len(bs)), np.zeros(len(bs)), np.zeros(len(bs))
        wx, wxy = np.zeros((xs, len(bs))), np.zeros((xs, len(bs)))
        for cells in chunks:
            for tile in _tiles(*unpacked(cells)):
                for at, w in w_all:
                    k = slice(at, at + w.shape[1])
                    end, x, m, v, cube, top = tile(w)
                    wx[x, k] += m
                    wxy[x, k] += v / 2 + m * (upto[k] + 0.5 - rows / 2)
                    cubes[k] += cube
                    most[k] = np.maximum(most[k], top)
                    upto[k] += end
        for k, b in enumerate(bs):
            total, of_x = upto[k], wx[:, k]
            if most[k] < total and of_x.max() < total:
                rx = np.cumsum(of_x) - of_x / 2 - total / 2  # mean ranks of ties, less the mean of all ranks
                sx, sy = of_x.dot(rx * rx), (total**3 - cubes[k]) / 12
                yield b, int(total), float(rx.dot(wxy[:, k]) / np.sqrt(sx * sy))

    def run(batches):
        import itertools

        cells = ({n: b[n][i].as_py() for n in b.schema.names} for b in batches for i in range(b.num_rows))
        first = next(cells, None)
        if first is None:
            return
        chunks = itertools.chain([first], cells)
        bs = list(range(first["_block"], times, blocks))
        step = max(1, KEPT // xs)
        if step < len(bs):
            chunks = list(chunks)  # x has so many values that the chunks are read again and again
        for at in range(0, len(bs), step):
            got = pd.DataFrame(list(rhos(chunks, bs[at : at + step])), columns=["b", "n", "rho"]).astype({"b": "int32", "n": "int64", "rho": "float64"})
            yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    return run


def cluster_bootstrap_rho(df: DataFrame, cluster: str, x: str, y: str, times: int, seed: int) -> DataFrame:
    """(b, n, rho): Spearman's rho over resampled clusters; resamples with a constant side are left out.

    A resample is a weight for each cluster, and rows count by weight. Rows are sorted once by the side with more values and packed
    into chunks of numbers of a few bytes a row; resamples are dealt out in as many blocks as there are cores, and a task reads the
    chunks one after another. It holds its resamples' weights, a byte for each cluster, and sums for each value of the other side;
    where those are too many it holds the chunks too.
    """
    spark = df.sparkSession
    ship(spark)
    df = df.select(F.col(cluster).alias("_c"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    ids = materialize(df.select("_c").distinct().select("_c", (F.row_number().over(W.orderBy("_c")) - 1).cast("bigint").alias("c")), "clusters")
    d = df.where("_x is not null and _y is not null")
    few = d.agg(F.approx_count_distinct("_x") <= F.approx_count_distinct("_y"), F.count("*")).first()  # which side is x changes no result
    d = d if few[0] else d.select("_c", F.col("_y").alias("_x"), F.col("_x").alias("_y"))
    codes = materialize(exact_ranks(d.select("_x").distinct(), [], "_x").select("_x", (F.col("upto") - 1).alias("x")), "values")
    d = d.join(ids, "_c").join(codes, "_x").select("c", "x", F.col("_y").alias("y"))
    kinds = "part int, seq int, kinds string, c binary, n binary, g binary, gx binary, ys binary"
    chunks = materialize(d.repartitionByRange("y").sortWithinPartitions("y", "x", "c").mapInArrow(_packed, kinds.replace("int,", "bigint,")), "chunks")
    blocks = min(spark.sparkContext.defaultParallelism, times)
    lands: dict[int, int] = {}  # a number for each block that is hashed to a part of its own
    for r in spark.range(64 * blocks).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(blocks)).alias("p")).collect():
        lands.setdefault(r["p"], r["k"])
    keys = [F.struct(F.lit(k).alias("_key"), F.lit(i).alias("_block")) for i, k in enumerate([lands[p] for p in sorted(lands)])]
    blocks = len(keys)
    each = chunks.withColumn("_k", F.explode(F.array(*keys))).select("_k._key", "_k._block", *chunks.columns).repartition(blocks, "_key").sortWithinPartitions("_key", "part", "seq")
    run = _weighted_rhos(ids.count(), codes.count(), few[1], times, blocks, seed)
    return each.mapInArrow(run, "b int, n bigint, rho double")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name) of any number of rows per key, by exact_ranks: the value in the middle, or the mean of the two."""
    c = exact_ranks(df, keys, value)
    at = lambda k: F.min(F.when(F.col("upto") > F.floor((F.col("total") - k) / 2), F.col(value)))
    return c.groupBy(*keys).agg(((at(1) + at(0)) / 2).alias(name))


def mean_ratio(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of ratios x / y (not the ratio of means), their median, and the reduction 1 - 1 / mean; rows with y null or 0 are left out."""
    k = list(keys)
    r = df.where(F.col(y) != 0).select(*k, (F.col(x) / F.col(y)).cast("double").alias("_r"))
    m = r.groupBy(*k).agg(F.count("*").alias("n"), F.avg("_r").alias("mean_ratio"))
    med = exact_median(r, k, "_r", "median_ratio")
    return m.join(med, same(m, med, k) if k else F.lit(True), "left").select(*[m[c] for c in k], "n", "mean_ratio", "median_ratio", (1 - 1 / F.col("mean_ratio")).alias("reduction"))
