import numpy as np
import pytest

from plumbline.operators import fusion as U
from plumbline.operators import training as T
from plumbline.operators.gradients import Var, pull

WIDTHS, CUTS = [4, 3, 2], [(0, 4), (4, 3), (7, 2)]


@pytest.mark.parametrize("kind", U.KINDS)
@pytest.mark.parametrize("on", [(True, True, True), (True, False, True)])
def test_gradients_equal_differences(kind, on):
    r = np.random.default_rng(0)
    head = {k: v + 0.1 * r.normal(size=v.shape) for k, v in U.new_head(kind, WIDTHS, 6, 2, seed=1).items()}
    xs, y, w = [r.normal(size=(7, n)) for n in WIDTHS], r.integers(0, 2, 7).astype(float), np.array([0.4, 1.6])
    got = T.slopes(head, kind, xs, y, w, on, True)
    start = T.flat(head)
    for i in r.choice(len(start), 60, replace=False):
        step = np.zeros(len(start))
        step[i] = 1e-5
        up, down = (T.slopes(T.unflat(start + d, head), kind, xs, y, w, on, True)[-2] for d in (step, -step))
        assert got[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)
    square = T.slopes(head, kind, xs, y * 3, w, on, False)
    z = U.forward(head, xs, kind, on)[:, 0]
    assert square[-2] == pytest.approx(((z - 3 * y) ** 2).sum()) and square[-1] == 7


def test_shared_values_add_up():
    v = Var(np.array([[2.0, 3.0]]))
    out = v * v + v
    pull(out, np.ones((1, 2)))
    assert out.value.tolist() == [[6.0, 12.0]] and v.grad.tolist() == [[5.0, 7.0]]


def data(spark, n=240):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 9))
    y = (x[:, 0] * x[:, 4] + x[:, 7] > 0).astype(int)
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist(), i % 4 == 0) for i in range(n)], "row_id long, y int, values array<double>, valid boolean"), x, y


def test_tasks_together_equal_one_process(spark):
    df, x, y = data(spark)
    head, s = U.new_head("gated", WIDTHS, 8, 2), T.Training(epochs=4, batch=50, rate=0.01, dropout=0.5)
    one, told = T.train_fusion(df, head, "gated", CUTS, s, tasks=1)
    three, again = T.train_fusion(df, head, "gated", CUTS, s, tasks=3)
    assert np.abs(T.flat(one) - T.flat(three)).max() < 1e-9 and len(told.collect()) == 4
    assert [r["valid"] for r in again.orderBy("epoch").collect()] == pytest.approx([r["valid"] for r in told.orderBy("epoch").collect()])
    # and a plain loop over all rows
    held, keys = np.arange(240) % 4 == 0, np.arange(240)
    xs, count = [x[:, a : a + n] for a, n in CUTS], np.bincount(y[~held])
    w = 2 / count / (1 / count).sum()
    vector, m, v, t, best = T.flat(head), 0.0, 0.0, 0, (np.inf, None)
    for epoch in range(4):
        own = T.batch_of(keys, s, epoch, 4)
        for b in range(4):
            rows = (own == b) & ~held
            g = T.slopes(T.unflat(vector, head), "gated", [c[rows] for c in xs], y[rows].astype(float), w, T.blocks_on(s, epoch, b, 3), True)
            g = g[:-2] / g[-1]
            g = g * min(1.0, 1.0 / (np.linalg.norm(g) + 1e-6)) if np.linalg.norm(g) > 1 else g
            t, m, v = t + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            vector = vector - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        loss = T.slopes(T.unflat(vector, head), "gated", [c[held] for c in xs], y[held].astype(float), w, (True,) * 3, True)
        best = min(best, (loss[-2] / loss[-1], vector), key=lambda p: p[0])
    assert np.abs(T.flat(one) - best[1]).max() < 1e-9


def test_states_are_gone_on_from(spark, tmp_path):
    df, _, _ = data(spark)
    head = U.new_head("mlp", WIDTHS, 8, 2)
    s = T.Training(epochs=5, batch=60, rate=0.01)
    whole, _ = T.train_fusion(df, head, "mlp", CUTS, s)
    folder = f"file://{tmp_path}/states"
    T.train_fusion(df, head, "mlp", CUTS, T.Training(epochs=2, batch=60, rate=0.01), keep=folder)
    rest, history = T.train_fusion(df, head, "mlp", CUTS, s, keep=folder)
    assert np.abs(T.flat(whole) - T.flat(rest)).max() < 1e-9 and history.count() == 5


def test_rate_falls_on_a_plateau_and_training_stops():
    state, s = T._State(np.zeros(3), 0.1), T.Training(epochs=50, plateau=1, patience=4, factor=0.5)
    goes = [state.close(s, 1.0, v) for v in (1.0, 1.0, 1.0, 1.0, 1.0)]
    assert goes == [True, True, True, True, False] and [h[3] for h in state.history] == [0.1, 0.1, 0.1, 0.05, 0.05] and state.rate == 0.025
    state.step(np.full(3, 100.0), 1.0)
    assert state.steps == 1 and np.allclose(state.m, 0.1 / np.sqrt(3), rtol=1e-5)


def test_blocks_are_off_by_chance():
    s = T.Training(dropout=0.3)
    seen = [T.blocks_on(s, e, b, 3) for e in range(30) for b in range(30)]
    assert abs(np.mean([all(x) for x in seen]) - 0.7) < 0.06 and all(sum(x) >= 2 for x in seen) and len(set(seen)) == 4


def test_a_split_without_rows_is_refused(spark):
    df, _, _ = data(spark, 12)
    with pytest.raises(ValueError, match="both need rows"):
        T.train_fusion(df.where("NOT valid"), U.new_head("mlp", WIDTHS, 8, 2), "mlp", CUTS, T.Training(epochs=1))


def test_heads_side_by_side_equal_each_alone(spark):
    df, _, _ = data(spark)
    wanted = [(U.new_head(kind, WIDTHS, 6, 2, seed=k), kind, T.Training(epochs=2 + k, batch=2, rate=0.01, dropout=0.3, seed=k)) for k, kind in enumerate(("mlp", "tri"))]  # 90 batches, more than a chunk
    together = T.train_heads(df, wanted, CUTS)
    for (head, kind, s), (got, told) in zip(wanted, together, strict=True):
        alone, history = T.train_fusion(df, head, kind, CUTS, s, tasks=2)
        assert np.abs(T.flat(got) - T.flat(alone)).max() < 1e-9 and [h[0] for h in told] == list(range(s.epochs)) and history.count() == s.epochs


def test_the_error_function_is_that_of_the_library():
    import math

    x = np.append(np.linspace(-7, 7, 5001), [0.0, np.inf, -np.inf])
    assert np.abs(U.erf(x) - [math.erf(v) for v in x]).max() < 5e-16
