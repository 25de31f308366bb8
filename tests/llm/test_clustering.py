import hashlib

import numpy as np
import pytest

from plumbline.llm.clustering import cluster, clustered, drift_bounds, first_centroids, integer_components, squared_distances


def plain(rows, k, rounds=5, scale=256.0, dim=64):
    kept = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: ("z" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if members:
                cents[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    told = [(i, *near(v)) for i, v in kept]
    per = {j: sum(d for _, d, o in told if o == j) for j in range(len(cents))}
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in told), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, vec string, cluster int").repartition(3)


def mixed_rows(n=160, seed=0, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, 64))
    rows = [(i, (centres[i % 8] + spread * r.normal(size=64)).tolist()) for i in range(n)]
    bad = [None] * 63 + [1.0]
    return rows + [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, bad), (n + 4, [float("nan")] * 64), (n + 5, [float("inf")] * 64), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (n + 6, [0.0] * 64), (n + 7, [0.0] * 64)]


@pytest.mark.parametrize("k", [1, 5, 12])
def test_equal_to_plain_rounds(spark, k):
    rows = mixed_rows()
    got = sorted((tuple(r) for r in clustered(table(spark, rows), k=k).collect()), key=str)
    assert got == plain(rows, k)


def test_bounds_spare_scans_and_change_nothing(spark):
    vectors = integer_components(table(spark, mixed_rows(800, seed=4)))
    found = cluster(vectors, first_centroids(vectors, 8), rounds=5)
    assert found.scanned[0] == found.total[0] and sum(found.scanned[1:]) < sum(found.total[1:]) / 2


def test_drift_bound_holds_and_is_below_the_whole_drift():
    r, tighter = np.random.default_rng(1), 0
    for dim in (2, 3, 16):
        for _ in range(60):
            old = r.normal(size=(6, dim)) * 100
            new = old + r.normal(size=old.shape) * r.choice([1, 10, 60], size=(6, 1)) * (r.random((6, 1)) < 0.8)
            radius = r.uniform(0, 80, 6)
            lost = drift_bounds(old, new, radius)
            for i in range(6):
                x = r.normal(size=(400, dim))
                x = old[i] + radius[i] * x / np.linalg.norm(x, axis=1, keepdims=True) * r.uniform(0, 1, (400, 1)) ** 0.2
                for j in range(6):
                    if j != i:
                        assert (np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() <= lost[i] + 1e-6
                whole = np.delete(np.linalg.norm(new - old, axis=1), i).max()
                assert lost[i] <= whole * (1 + 1e-6)
                tighter += lost[i] < 0.9 * whole
    assert tighter > 100


def test_exact_for_large_components(spark):
    r = np.random.default_rng(2)
    x, c = r.integers(-(1 << 27), 1 << 27, (30, 64)), r.integers(-(1 << 27), 1 << 27, (4, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
    assert squared_distances(x, c).tolist() == want
    rows = [(i, (v / 256.0).tolist()) for i, v in enumerate(x)]
    assert sorted((tuple(q)[:4] for q in clustered(table(spark, rows), k=4).collect()), key=str) == [q[:4] for q in plain(rows, 4)]
    beyond = [(99, [float(1 << 20)] * 64), (98, [1e300] * 64)]
    assert sorted(q["vec_id"] for q in clustered(table(spark, rows + beyond), k=4).collect()) == list(range(30))


def test_few_and_no_vectors(spark):
    assert clustered(table(spark, [(1, None)])).count() == 0
    assert clustered(table(spark, [(1, None)])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = [(5, [0.5] * 64), (6, [-0.001] * 64)]
    assert sorted((tuple(q) for q in clustered(table(spark, rows)).collect()), key=str) == plain(rows, 40)
