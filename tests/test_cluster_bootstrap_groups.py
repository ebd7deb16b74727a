"""The cluster bootstrap adds up the weights of many resamples at once."""

import numpy as np
import pytest

from procmill.operators import statistics as S


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("most", [5, 200, 70_000])
def test_groups_of_all_lengths(repeated, most):
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(1, 9, 20_000), [700, 1, 40_000, 255, 257]])
    g = np.cumsum(sizes) - sizes
    c = rng.integers(0, 500, sizes.sum())
    n = rng.integers(1, 4, len(c)).astype(float) if repeated else None
    w = rng.integers(0, most, (500, 7)).astype(np.uint8 if most < 256 else np.uint32)
    got = S._group_sums(c, n, g)(w)
    each = w[c].astype(float) * (n[:, None] if repeated else 1)
    assert (got == np.add.reduceat(each, g, axis=0)).all()


def test_md5_is_taken_once_for_each_cluster_and_resample(monkeypatch):
    import pyarrow as pa

    seen = []
    plain = S._md5_heads
    monkeypatch.setattr(S, "_md5_heads", lambda seed, b, n: seen.append((b, n)) or plain(seed, b, n))
    cells = [np.array(v, np.uint8) for v in ([0, 1, 2, 1], [1, 1, 1, 1], [2, 2], [0, 1], [1, 1])]
    row = {"_block": [0], "kinds": [",".join(v.dtype.str for v in cells)], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("c", "n", "g", "gx", "ys"), cells)}}
    out = pa.Table.from_batches(S._weighted_rhos(3, 2, 4, 150, 1, 7)(iter([pa.record_batch(row)] * 3)))
    assert sorted(seen) == [(b, 3) for b in range(150)] and set(out["b"].to_pylist()) <= set(range(150))
