"""Links and components against all pairs."""

import numpy as np
import pytest

from voxtally.llm import vectors
from voxtally.llm.components import components


def brute(rows, cosine):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float) / max(map(abs, v))
            ok[n] = x / np.linalg.norm(x)
    near = {n: {m for m in ok if m != n and rows[n][2] == rows[m][2] and len(ok[n]) == len(ok[m]) and ok[n] @ ok[m] >= cosine} for n in ok}
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, front = {n}, [n]
        while front:
            for m in near.get(front.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    front.append(m)
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(near.get(n, ())), least, i is None or i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,block", [(16, 8), (256, 512)])
def test_all_kinds_of_rows(spark, window, block):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    centres = rng.normal(size=(30, 12))
    for k, size in enumerate([90, 40, 12, 5] + [2] * 16 + [1] * 10):
        # tight and loose groups, near and past the bound
        for _ in range(size):
            noise = rng.normal(size=12) * np.linalg.norm(centres[k]) / np.sqrt(12) * [0.02, 0.12, 0.15][k % 3]
            rows.append((1000 - n, (centres[k] + noise).tolist(), int(k % 2)))
            n += 1
    rows += [(5000 + i, rows[3][1], rows[3][2]) for i in range(60)]
    rows += [(6000, None, 1), (6001, [0.0] * 12, 1), (6002, [None] + [1.0] * 11, 1), (6003, [float("nan")] * 12, 1), (6004, [1.0] * 12, None),
             (None, rows[0][1], 0), (6005, [1e-200] * 12, 1), (6006, [1e200] * 12, 1), (6007, [1.0, 2.0], 1), (6008, [1.0, 2.0], 1), (6008, [1.0, 2.0], 1), (6009, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, kept string").repartition(4)
    out = vectors.near_vectors(df, cosine=0.98, window=window, block=block)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 0.98)


def test_a_large_loose_group_is_whole(spark):
    """One label, mean cosine 0.96: most links are far apart in every pass of few and narrow windows."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    centre /= np.linalg.norm(centre)
    x = centre + rng.normal(size=(1500, 16)) * np.sqrt((1 / 0.96 - 1) / 16)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, passes=2, window=8, block=64).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.98
    root = np.arange(len(x))
    while (least := np.where(near, root[None, :], len(x)).min(1)).tolist() != root.tolist():
        root = least
    assert got == {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(len(x))}


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(7, 1000 + i) for i in range(300)] + [(5, 5), (None, 3), (3000, 2999)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    want = {i: 100 for i in range(100, 181)} | {7: 7} | {1000 + i: 7 for i in range(300)} | {3000: 2999, 2999: 2999}
    assert got == want
