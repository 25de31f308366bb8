"""Heads that fuse three embedding blocks, with their weights as rows of a table.

A head is a dict of arrays by name. Layers ``x`` have ``x.w`` (inputs x outputs) and ``x.b``; a normalised layer has
``x.scale`` and ``x.shift`` too. Blocks are in the order C, K, E; all rows are independent of each other, so a table is
scored batch by batch where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import write_new

Head = dict[str, np.ndarray]
KINDS = ("mlp", "gated", "residual_dynamic", "gated_3d_downweight", "dual", "tri")
_erf = np.frompyfunc(math.erf, 1, 1)


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def _erf_table(step: int = 64, end: int = 6, order: int = 7) -> np.ndarray:
    """Taylor coefficients of the error function at multiples of 1 / step within +-end, one row a power."""
    x = np.arange(-end * step, end * step + 1) / step
    slopes = [np.array([math.erf(v) for v in x]), 2 / math.sqrt(math.pi) * np.exp(-x * x)]
    for n in range(1, order - 1):
        slopes.append(-2 * x * slopes[n] - (2 * (n - 1) * slopes[n - 1] if n > 1 else 0.0))
    return np.stack([s / math.factorial(n) for n, s in enumerate(slopes)])


_ERF = _erf_table()


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, within some 2e-16 (tested); beyond +-6 it is +-1."""
    x = np.minimum(np.maximum(x, -6.0), 6.0)
    at = np.rint(x * 64)
    off, at = x - at / 64, at.astype(np.int64) + 384
    out = _ERF[-1][at]
    for row in _ERF[-2::-1]:
        out = out * off + row[at]
    return out


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + (erf(x / math.sqrt(2)) if isinstance(x, np.ndarray) else _erf(x / math.sqrt(2))))


def softmax(x: np.ndarray) -> np.ndarray:
    if hasattr(x, "softmax"):  # while it is trained, as in the functions below
        return x.softmax()
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logistic(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def normed(head: Head, name: str, x: np.ndarray) -> np.ndarray:
    if hasattr(x, "normed"):
        return x.normed(head[f"{name}.scale"], head[f"{name}.shift"])
    off = x - x.mean(axis=1, keepdims=True)
    return off / np.sqrt((off * off).mean(axis=1, keepdims=True) + 1e-5) * head[f"{name}.scale"] + head[f"{name}.shift"]


def same(x: np.ndarray) -> np.ndarray:
    return x


def layer(head: Head, name: str, x: np.ndarray, act: Callable = same) -> np.ndarray:
    if hasattr(head[f"{name}.w"], "layer"):
        return head[f"{name}.w"].layer(x, head[f"{name}.b"], head.get(f"{name}.scale"), head.get(f"{name}.shift"), act)
    z = x @ head[f"{name}.w"] + head[f"{name}.b"]
    return act(normed(head, name, z) if f"{name}.scale" in head else z)


def _two(head: Head, name: str, x: np.ndarray, act: Callable = gelu) -> np.ndarray:
    return layer(head, f"{name}2", layer(head, f"{name}1", x, act))


def _mix(weights: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    if hasattr(weights, "mix"):
        return weights.mix(parts)
    return sum(weights[:, i : i + 1] * p for i, p in enumerate(parts))


def residual_dynamic(head: Head, hs: list[np.ndarray], pair_scale: float = 0.3, residual_scale: float = 0.3) -> np.ndarray:
    """Gated sum, a term of the products of each two blocks, and their mean, normalised."""
    a, b, c = hs
    gate = softmax(_two(head, "dyn.gate", np.hstack(hs), relu))
    pair = _two(head, "dyn.pair", np.hstack([a * b, a * c, b * c]), relu)
    return normed(head, "dyn.norm", _mix(gate, hs) + pair_scale * pair + residual_scale * sum(hs) / 3)


def downweighted(head: Head, hs: list[np.ndarray]) -> np.ndarray:
    """The last block is gated down and its logit lowered by a learned penalty before the sum; the mean goes through a layer of its own."""
    hs = [*hs[:2], hs[2] * logistic(_two(head, "down.gate", np.hstack(hs)))]
    logits = _two(head, "down.weight", np.hstack(hs))
    logits = logits - np.array([0.0, 0.0, 1.0]) * np.logaddexp(0.0, head["down.penalty"])
    return _mix(softmax(logits), hs) + layer(head, "down.out", sum(hs) / 3, gelu)


def _gated(head: Head, hs: list[np.ndarray], on: tuple[bool, ...], context: np.ndarray) -> list[np.ndarray]:
    logits = np.where(on, _two(head, "gate", np.hstack([*hs, context])), -1e9)
    gate = softmax(logits)
    return [h * gate[:, i : i + 1] for i, h in enumerate(hs)]


def forward(head: Head, xs: list[np.ndarray], kind: str, on: tuple[bool, ...] = (True, True, True), context: np.ndarray | None = None) -> np.ndarray:
    """Logits of rows of the three blocks. Blocks that are off count as zeros after their projection; all off is an error.

    ``context`` is the task's vector, for heads that were made with one.
    """
    if not any(on):
        raise ValueError("at least one modality must be on")
    if kind not in KINDS:
        raise ValueError(f"unknown fusion {kind}")
    hs = [layer(head, f"proj{i}", x, relu) * float(o) for i, (x, o) in enumerate(zip(xs, on, strict=True))]
    ctx = np.tile(context if context is not None else np.zeros(0), (len(hs[0]), 1))
    base = lambda name, parts: layer(head, name, np.hstack(parts), gelu)
    if kind in ("dual", "tri"):
        fused = {"mlp": base("base", hs), "gated": base("gbase", _gated(head, hs, on, ctx))}
        if kind == "tri":
            fused["residual"] = residual_dynamic(head, hs)
        mixer = _two(head, "mixer", np.hstack([*fused.values(), ctx]))
        share = softmax(mixer) if kind == "tri" else np.hstack([1 - logistic(mixer), logistic(mixer)])
        return _mix(share, [_two(head, f"out.{name}", f) for name, f in fused.items()])
    if kind == "gated":
        hs = _gated(head, hs, on, ctx)
    fused, alpha = base("base", hs), logistic(head["alpha"])
    if kind == "residual_dynamic":
        fused = fused + 0.2 * alpha * residual_dynamic(head, hs)
    elif kind == "gated_3d_downweight":
        fused = (1 - alpha) * fused + alpha * downweighted(head, hs)
    return _two(head, "out", fused)


def layer_sizes(kind: str, widths: list[int], hidden: int, outputs: int, context: int = 0) -> dict[str, tuple[int, int, bool]]:
    """(inputs, outputs, normalised) of each layer of a head."""
    h, three = hidden, hidden * len(widths)
    out = {f"proj{i}": (n, h, True) for i, n in enumerate(widths)}
    two = lambda name, i, m, o, norm=True: {f"{name}1": (i, m, norm), f"{name}2": (m, o, False)}
    out["base"] = (three, h, True)
    if kind in ("gated", "dual", "tri"):
        out |= two("gate", three + context, h, 3)
    if kind in ("residual_dynamic", "tri"):
        out |= two("dyn.gate", three, h, 3, False) | two("dyn.pair", three, h, h, False)
    if kind == "gated_3d_downweight":
        out |= two("down.gate", three, h, 1) | two("down.weight", three, h, 3) | {"down.out": (h, h, True)}
    if kind in ("dual", "tri"):
        names = ["mlp", "gated", "residual"][: 2 if kind == "dual" else 3]
        out["gbase"] = (three, h, True)
        out |= two("mixer", h * len(names) + context, h, 1 if kind == "dual" else 3)
        for name in names:
            out |= two(f"out.{name}", h, h // 2, outputs)
    else:
        out |= two("out", h, h // 2, outputs)
    return out


def new_head(kind: str, widths: list[int], hidden: int, outputs: int, seed: int = 0, context: int = 0) -> Head:
    """A head with uniform weights of a seed, before any training."""
    rng, head = np.random.default_rng(seed), {"alpha": np.zeros(1), "down.penalty": np.full(1, 0.5), "dyn.norm.scale": np.ones(hidden), "dyn.norm.shift": np.zeros(hidden)}
    for name, (i, o, norm) in layer_sizes(kind, widths, hidden, outputs, context).items():
        head[f"{name}.w"], head[f"{name}.b"] = rng.uniform(-1, 1, (i, o)) / math.sqrt(i), rng.uniform(-1, 1, o) / math.sqrt(i)
        if norm:
            head[f"{name}.scale"], head[f"{name}.shift"] = np.ones(o), np.zeros(o)
    return head


def head_rows(spark: SparkSession, head: Head) -> DataFrame:
    """(name, shape, weights, digest): a row for each array of a head, with a hash of its numbers."""
    rows = [(name, list(a.shape), a.astype(float).ravel().tolist()) for name, a in sorted(head.items())]
    df = spark.createDataFrame(rows, "name string, shape array<int>, weights array<double>")
    return df.withColumn("digest", _digest())


def _digest():
    return F.sha2(F.concat_ws("|", "name", F.to_json("shape"), F.to_json("weights")).cast("binary"), 256)


def save_head(spark: SparkSession, head: Head, path: str) -> None:
    """Write a head's rows where nothing is yet."""
    write_new(head_rows(spark, head).coalesce(1), path)


def load_head(spark: SparkSession, path: str, expected: dict[str, tuple[int, int, bool]] | None = None) -> Head:
    """The head written by :func:`save_head`; ValueError where a row's hash or, with ``expected`` sizes, a layer's size differs."""
    rows = spark.read.parquet(path).withColumn("same", _digest() == F.col("digest")).collect()  # a row for each array of one head
    if bad := sorted(r["name"] for r in rows if not r["same"]):
        raise ValueError(f"weights differ from their record: {bad}")
    head = {r["name"]: np.array(r["weights"]).reshape(r["shape"]) for r in rows}
    wrong = [n for n, (i, o, norm) in (expected or {}).items() if head.get(f"{n}.w", np.zeros(0)).shape != (i, o) or head.get(f"{n}.b", np.zeros(0)).shape != (o,) or norm != (f"{n}.scale" in head)]
    if wrong:
        raise ValueError(f"layers missing or of another size: {wrong}")
    return head


def fused_scores(df: DataFrame, head: Head, kind: str, cuts: list[tuple[int, int]], on: tuple[bool, ...] = (True, True, True), context: np.ndarray | None = None, label: tuple[float, float] | None = None, batch: int = 256) -> DataFrame:
    """(row_id, score) of (row_id, values): with ``label`` = (mean, deviation) the label of a regression head, else P(last class).

    ``cuts`` are the blocks' (start, width) in ``values``. A row with a null or non-finite component is an error.
    """
    width = max(a + n for a, n in cuts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                rows = pdf.iloc[at : at + batch]
                x = np.vstack(rows["values"].to_numpy()).astype(float)
                if x.shape[1] < width or not np.isfinite(x).all():
                    raise ValueError("blocks must be finite and of the head's widths")
                z = forward(head, [x[:, a : a + n] for a, n in cuts], kind, on, context)
                yield pd.DataFrame({"row_id": rows["row_id"], "score": softmax(z)[:, -1] if label is None else z[:, 0] * label[1] + label[0]})

    return df.select("row_id", "values").mapInPandas(run, "row_id long, score double")
