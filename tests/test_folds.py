import heapq
import random

from plumbline.operators.folds import greedy_folds, run_folds
from plumbline.operators.sampling import draw_with_replacement


def plain(sizes, folds):
    heap, out = [(0, f) for f in range(folds)], []
    for n in sizes:
        load, f = heapq.heappop(heap)
        out.append(f)
        heapq.heappush(heap, (load + n, f))
    return out, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_runs_of_equal_sizes_are_dealt_by_arithmetic():
    r = random.Random(0)
    for _ in range(400):
        folds = r.randrange(1, 7)
        runs = sorted({r.randrange(1, 40): r.randrange(1, 30) for _ in range(r.randrange(1, 8))}.items(), reverse=True)
        want, loads = plain([n for n, c in runs for _ in range(c)], folds)
        now, got = [0] * folds, []
        for n, c in runs:
            segments, now = run_folds(now, n, c)
            for i in range(c):
                first, turn = [s for s in segments if s[0] <= i][-1]
                got.append(turn[(i - first) % len(turn)])
        assert got == want and now == loads
    start = [50, 0, 7, 7]
    segments, after = run_folds(start, 5, 100)
    heap, want = [(load, f) for f, load in enumerate(start)], []
    heapq.heapify(heap)
    for _ in range(100):
        load, f = heapq.heappop(heap)
        want.append(f)
        heapq.heappush(heap, (load + 5, f))
    assert [[s for s in segments if s[0] <= i][-1][1][(i - [s for s in segments if s[0] <= i][-1][0]) % len([s for s in segments if s[0] <= i][-1][1])] for i in range(100)] == want
    assert after == [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_greedy_folds_do_not_depend_on_cells(spark):
    r = random.Random(1)
    rows = [(i, int(r.paretovariate(0.8)) % 90) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id long, g long").repartition(3)
    found = [{x["grp"]: (x["n"], x["fold"]) for x in greedy_folds(df, "g", 4, seed=3, cells=c).collect()} for c in (1, 16)]
    assert found[0] == found[1] and len(found[0]) == len({g for _, g in rows})
    load = [sum(n for n, f in found[0].values() if f == k) for k in range(4)]
    sizes = sorted((n for n, _ in found[0].values()), reverse=True)
    assert sorted(load) == sorted(plain(sizes, 4)[1])


def test_draws_take_the_row_whose_span_they_fall_in(spark):
    r = random.Random(2)
    rows = [(10**15 if i == 299 else i * 3, r.choice([0, 1, 1, 2, 500])) for i in range(300)]  # one far id, some heavy rows
    df = spark.createDataFrame(rows, "row_id long, weight int").repartition(4)
    for cells in (50_000, 20):
        got = {x["draw"]: x["row_id"] for x in draw_with_replacement(df, 700, cells).collect()}
        import hashlib

        total, ends, at = sum(w for _, w in rows), [], 0
        for i, w in sorted(rows):
            ends.append((at, at + w, i))
            at += w
        for k in range(700):
            u = int(int(hashlib.md5(f"draw|{k}".encode()).hexdigest()[:13], 16) / float(1 << 52) * total)
            assert [i for a, b, i in ends if a <= u < b] == [got[k]]
        assert len(got) == 700
    assert draw_with_replacement(df.where("weight = 0")).count() == 0
