import numpy as np

from plumbline.operators import kernel as K


def test_a_pass_turns_only_rows_near_the_hinge_and_sums_the_same(monkeypatch):
    r = np.random.default_rng(0)
    x, marks, n = r.normal(size=(400, 5)), r.normal(size=(30, 5)), []
    value, vector = np.linalg.eigh(K.kernel(marks, marks, 0.3))
    m = K.Head(0, np.zeros(5), np.eye(5), 0.3, marks, vector / np.sqrt(value))
    y, w, h = np.where(r.random(400) < 0.5, 1.0, -1.0), r.normal(size=31), 0.1
    weight = np.where(y > 0, 2.0, 0.5)
    f = np.column_stack([m.features(x), np.ones(400)])
    loss, first, second = K.hinge(y * (f @ w), h)
    want = np.column_stack([(f * (weight * second)[:, None]).T @ f, f.T @ (weight * first * y)])
    stacked = np.column_stack
    monkeypatch.setattr(np, "column_stack", lambda parts: (n.append(len(parts[0])), stacked(parts))[1])
    got, value = K.pass_sums(m, w, h, weight, y, x)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(want).max()) and np.isclose(value, (weight * loss).sum())
    assert n[0] == (second > 0).sum() < 100
