"""Fusion heads against plain arithmetic, one row and one number at a time."""

import math

import numpy as np
import pytest

from plumbline.operators import fusion as U

WIDTHS = [5, 4, 3]


def dense(head, name, x):
    w, b = head[f"{name}.w"], head[f"{name}.b"]
    z = [sum(x[i] * w[i][o] for i in range(len(x))) + b[o] for o in range(len(b))]
    return plain_norm(z, head[f"{name}.scale"], head[f"{name}.shift"]) if f"{name}.scale" in head else z


def plain_norm(z, scale, shift):
    mean = sum(z) / len(z)
    var = sum((v - mean) ** 2 for v in z) / len(z)
    return [(v - mean) / math.sqrt(var + 1e-5) * s + t for v, s, t in zip(z, scale, shift, strict=True)]


def gelu(z):
    return [v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in z]


def relu(z):
    return [max(v, 0.0) for v in z]


def soft(z):
    e = [math.exp(v) for v in z]
    return [v / sum(e) for v in e]


def plain(head, xs, kind):
    a, b, c = (relu(dense(head, f"proj{i}", x)) for i, x in enumerate(xs))
    alpha = 1 / (1 + math.exp(-head["alpha"][0]))
    if kind == "gated":
        g = soft(dense(head, "gate2", gelu(dense(head, "gate1", a + b + c))))
        a, b, c = ([v * w for v in h] for h, w in zip((a, b, c), g, strict=True))
    fused = gelu(dense(head, "base", a + b + c))
    if kind == "residual_dynamic":
        g = soft(dense(head, "dyn.gate2", relu(dense(head, "dyn.gate1", a + b + c))))
        products = [x * y for x, y in zip(a, b)] + [x * y for x, y in zip(a, c)] + [x * y for x, y in zip(b, c)]
        pair = dense(head, "dyn.pair2", relu(dense(head, "dyn.pair1", products)))
        dyn = [g[0] * x + g[1] * y + g[2] * z + 0.3 * p + 0.3 * (x + y + z) / 3 for x, y, z, p in zip(a, b, c, pair)]
        dyn = plain_norm(dyn, head["dyn.norm.scale"], head["dyn.norm.shift"])
        fused = [f + 0.2 * alpha * v for f, v in zip(fused, dyn)]
    if kind == "gated_3d_downweight":
        (g,) = dense(head, "down.gate2", gelu(dense(head, "down.gate1", a + b + c)))
        c = [v / (1 + math.exp(-g)) for v in c]
        logits = dense(head, "down.weight2", gelu(dense(head, "down.weight1", a + b + c)))
        w = soft([logits[0], logits[1], logits[2] - math.log(1 + math.exp(head["down.penalty"][0]))])
        out = gelu(dense(head, "down.out", [(x + y + z) / 3 for x, y, z in zip(a, b, c)]))
        fused = [(1 - alpha) * f + alpha * (w[0] * x + w[1] * y + w[2] * z + o) for f, x, y, z, o in zip(fused, a, b, c, out)]
    return dense(head, "out2", gelu(dense(head, "out1", fused)))


def blocks(n=7):
    rng = np.random.default_rng(4)
    return [rng.normal(size=(n, w)) for w in WIDTHS]


@pytest.mark.parametrize("kind", ["mlp", "gated", "residual_dynamic", "gated_3d_downweight"])
def test_forward_is_the_plain_arithmetic(kind):
    head, xs = U.new_head(kind, WIDTHS, 6, 2, seed=3), blocks()
    head["alpha"][:] = 0.7
    want = [plain(head, [x[i].tolist() for x in xs], kind) for i in range(len(xs[0]))]
    assert np.allclose(U.forward(head, xs, kind), want, atol=1e-12)


@pytest.mark.parametrize("kind", ["dual", "tri"])
def test_mixed_heads_lie_between_their_parts(kind):
    head, xs = U.new_head(kind, WIDTHS, 6, 2, seed=5, context=3), blocks()
    context = np.array([1.0, 0.0, 0.4])
    whole = U.forward(head, xs, kind, context=context)
    for o in ("mlp", "gated", "residual")[: 2 if kind == "dual" else 3]:
        head[f"out.{o}2.w"][:], head[f"out.{o}2.b"][:] = 0, 7.0
    assert np.allclose(U.forward(head, xs, kind, context=context), 7.0) and not np.allclose(whole, 7.0)


@pytest.mark.parametrize("kind", U.KINDS)
def test_a_block_that_is_off_has_no_effect(kind):
    head, xs = U.new_head(kind, WIDTHS, 6, 2, seed=1), blocks()
    other = [xs[0], xs[1] + 5, xs[2]]
    on = (True, False, True)
    assert np.array_equal(U.forward(head, xs, kind, on), U.forward(head, other, kind, on))
    assert not np.allclose(U.forward(head, xs, kind), U.forward(head, other, kind))
    with pytest.raises(ValueError, match="at least one"):
        U.forward(head, xs, kind, (False, False, False))


def test_heads_are_rows_with_a_gate(spark, tmp_path):
    head = U.new_head("tri", WIDTHS, 6, 2, seed=2)
    sizes = U.layer_sizes("tri", WIDTHS, 6, 2)
    U.save_head(spark, head, str(tmp_path / "h"))
    back = U.load_head(spark, str(tmp_path / "h"), sizes)
    assert back.keys() == head.keys() and all(np.array_equal(back[k], head[k]) for k in head)
    with pytest.raises(Exception, match="(?i)exist"):
        U.save_head(spark, head, str(tmp_path / "h"))
    with pytest.raises(ValueError, match="another size"):
        U.load_head(spark, str(tmp_path / "h"), U.layer_sizes("tri", WIDTHS, 8, 2))
    bad = U.head_rows(spark, head).selectExpr("name", "shape", "CASE WHEN name = 'base.b' THEN transform(weights, x -> x + 1) ELSE weights END AS weights", "digest")
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="differ"):
        U.load_head(spark, str(tmp_path / "bad"))


def test_scores_of_a_table(spark):
    xs = blocks(600)
    values = np.hstack(xs)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "row_id long, values array<double>").repartition(3)
    cuts = [(0, 5), (5, 4), (9, 3)]
    head = U.new_head("gated", WIDTHS, 6, 1, seed=2)
    got = {r["row_id"]: r["score"] for r in U.fused_scores(df, head, "gated", cuts, label=(3.0, 2.0)).collect()}
    want = U.forward(head, xs, "gated")[:, 0] * 2 + 3
    assert len(got) == 600 and np.allclose([got[i] for i in range(600)], want)
    with pytest.raises(Exception, match="finite"):
        U.fused_scores(spark.createDataFrame([(1, [float("nan")] * 12)], df.schema), head, "gated", cuts).collect()
