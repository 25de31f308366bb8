"""Training of fusion heads on the cluster: rows are dealt to batches by a shuffle, and each head is trained by a stream of them.

A row's batch of an epoch is a hash of its id. An epoch is one job for all heads: tasks pack their rows by head and chunk of
batches, the shuffle sorts the chunks, and one task a head takes a step for each batch of the stream (Adam, the gradient's norm
clipped), holding one chunk at a time; validation rows come last. With some chance, by a hash of the batch, one of the blocks is
off for it. After an epoch the validation loss decides on the rate (plateau) and on stopping (patience). The state of each epoch
is kept in the shared folder, from where the next one and a task that is started again go on. Steps of one head follow each
other, so its time is that of its steps, as many as batches; heads are trained side by side.
"""

from __future__ import annotations

import io
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, shared_root
from .boosting import U, _stream, mix
from .fusion import Head, forward, softmax
from .gradients import Var, pull


@dataclass(frozen=True)
class Training:
    """Settings: Adam's rate, norm of the clipped gradient, chance that a block is off, plateau and patience in epochs, least gain of the loss."""

    epochs: int = 50
    batch: int = 64
    rate: float = 1e-3
    clip: float = 1.0
    dropout: float = 0.0
    factor: float = 0.5
    plateau: int = 5
    patience: int = 10
    least: float = 1e-6
    seed: int = 0
    classification: bool = True


def flat(head: Head) -> np.ndarray:
    return np.concatenate([head[k].astype(float).ravel() for k in sorted(head)])


def unflat(vector: np.ndarray, like: Head) -> Head:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def slopes(head: Head, kind: str, xs: list[np.ndarray], y: np.ndarray, weights: np.ndarray, on: tuple[bool, ...], classification: bool) -> np.ndarray:
    """(gradient of the summed loss, summed loss, summed weights) as one vector: cross entropy by class weights, else squared error."""
    size = sum(a.size for a in head.values())
    if not len(y):
        return np.zeros(size + 2)
    wrapped = {k: Var(v) for k, v in head.items()}
    z = forward(wrapped, xs, kind, on)
    if classification:
        w, p = weights[y.astype(int)], softmax(z.value)
        own = p[np.arange(len(y)), y.astype(int)]
        d = p * w[:, None]
        d[np.arange(len(y)), y.astype(int)] -= w
        loss, total = -(w * np.log(np.maximum(own, 1e-300))).sum(), w.sum()
    else:
        off = z.value[:, 0] - y
        d, loss, total = np.zeros_like(z.value), (off * off).sum(), float(len(y))
        d[:, 0] = 2 * off
    pull(z, d)
    grads = {k: np.zeros_like(v) if wrapped[k].grad is None else wrapped[k].grad for k, v in head.items()}
    return np.concatenate([flat(grads), [loss, total]])


def blocks_on(s: Training, epoch: int, batch: int, count: int) -> tuple[bool, ...]:
    """Which blocks a batch sees: with the chance ``dropout`` all but one."""
    draw = _stream(s.seed, 7, epoch, batch)
    if float(draw >> U(11)) / float(1 << 53) >= s.dropout:
        return (True,) * count
    off = int(mix(draw) % U(count))
    return tuple(i != off for i in range(count))


def batch_of(keys: np.ndarray, s: Training, epoch: int, batches: int) -> np.ndarray:
    return (mix(keys.view(U) ^ _stream(s.seed, 6, epoch)) % U(batches)).astype(np.int64)


class _State:
    """Weights, Adam's moments, rate and the best weights so far; what an epoch leaves to the next."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights, self.m, self.v = weights.copy(), np.zeros_like(weights), np.zeros_like(weights)
        self.best_weights, self.history = weights.copy(), []
        self.steps, self.epoch, self.rate, self.best, self.bad, self.stale = 0, 0, rate, float("inf"), 0, 0

    def step(self, gradient: np.ndarray, clip: float) -> None:
        norm = float(np.sqrt((gradient * gradient).sum()))
        if norm > clip:
            gradient = gradient * (clip / (norm + 1e-6))
        self.steps += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient * gradient
        self.weights = self.weights - self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)

    def close(self, s: Training, train: float, valid: float) -> bool:
        """End an epoch; whether to go on."""
        self.history.append([self.epoch, train, valid, self.rate])
        if valid < self.best - s.least:
            self.best, self.best_weights, self.bad, self.stale = valid, self.weights.copy(), 0, 0
        else:
            self.bad, self.stale = self.bad + 1, self.stale + 1
        if self.bad > s.plateau:
            self.rate, self.bad = self.rate * s.factor, 0
        self.epoch += 1
        return self.epoch < s.epochs and self.stale < s.patience

    def dump(self) -> bytes:
        out = io.BytesIO()
        numbers = json.dumps([self.history, self.steps, self.epoch, self.rate, self.best, self.bad, self.stale])
        np.savez(out, weights=self.weights, m=self.m, v=self.v, best=self.best_weights, numbers=np.frombuffer(numbers.encode(), np.uint8))
        return out.getvalue()

    def load(self, data: bytes) -> None:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        self.weights, self.m, self.v, self.best_weights = (got[k] for k in ("weights", "m", "v", "best"))
        self.history, self.steps, self.epoch, self.rate, self.best, self.bad, self.stale = json.loads(got["numbers"].tobytes())


def mean_loss(head: Head, kind: str, xs: list[np.ndarray], y: np.ndarray, weights: np.ndarray, classification: bool) -> np.ndarray:
    """(summed loss, summed weights) with all blocks on."""
    if not len(y):
        return np.zeros(2)
    z = forward(head, xs, kind)
    if classification:
        w = weights[y.astype(int)]
        return np.array([-(w * np.log(np.maximum(softmax(z)[np.arange(len(y)), y.astype(int)], 1e-300))).sum(), w.sum()])
    return np.array([((z[:, 0] - y) ** 2).sum(), float(len(y))])


#: Batches of a chunk, rows of a validation chunk, and what chunks of validation rows are numbered from.
_CHUNK, _HELD, _AFTER = 64, 4096, 1 << 30
_DEALT = "head int, chunk long, rows binary"


def _dealt(rows: DataFrame, heads: list[tuple[int, Training, int]], batches: int, held_chunks: int, width: int) -> DataFrame:
    """(head, chunk, rows) of (number, settings, epoch) heads: a task's rows of each chunk of batches, packed."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not (n := part.num_rows):
                continue
            packed = np.zeros(n, _packed(width))
            packed["key"], packed["y"] = part.column(0).to_numpy(), part.column(1).to_numpy()
            packed["x"] = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[:, :width]
            held = part.column(2).to_numpy(zero_copy_only=False)
            for number, s, epoch in heads:
                own = batch_of(packed["key"], s, epoch, batches)
                packed["batch"] = own
                chunk = np.where(held, _AFTER + mix(packed["key"].view(U)).astype(np.int64) % held_chunks, own // _CHUNK)
                order = np.argsort(chunk, kind="stable")
                ends = np.flatnonzero(np.append(np.diff(chunk[order]), 1)) + 1
                sorted_, starts = packed[order], np.append(0, ends[:-1])
                raw = pa.array([sorted_[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), number, np.int32)), pa.array(chunk[order][starts]), raw], ["head", "chunk", "rows"])

    return rows.mapInArrow(run, _DEALT)


def _packed(width: int) -> np.dtype:
    return np.dtype([("key", "<i8"), ("y", "<f8"), ("batch", "<i8"), ("x", "<f8", (width,))])


def _chunks(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, its rows by batch and key) of a head's sorted stream."""
    now, raw = None, []

    def whole() -> tuple[int, np.ndarray]:
        rows = np.frombuffer(b"".join(raw), _packed(width))
        return now, rows[np.lexsort((rows["key"], rows["batch"]))]

    for part in parts:
        for chunk, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            if chunk != now and raw:
                yield whole()
                raw = []
            now = chunk
            raw.append(data)
    if raw:
        yield whole()


def _latest(store: pafs.FileSystem, place: str) -> bytes | None:
    names = sorted(f.path for f in store.get_file_info(pafs.FileSelector(place, allow_not_found=True)) if f.path.endswith(".npz"))
    if not names:
        return None
    with store.open_input_stream(names[-1]) as f:
        return f.read()


def train_heads(rows: DataFrame, wanted: list[tuple[Head, str, Training]], cuts: list[tuple[int, int]], tasks: int | None = None, keep: str | None = None) -> list[tuple[Head, list[tuple]]]:
    """For each (head, kind, settings) the head of the epoch of least validation loss and its history [(epoch, train, valid, rate)].

    ``rows``: row_id (unique), y, values and valid (boolean; null counts as false); settings have one size of batches and one kind
    of loss. Classes are 0, 1, ... and weigh 1 / count, scaled to sum to their number. ``tasks`` deal the rows, by default those
    that read them. ``keep`` is the folder of the epochs' states, with a folder for each head, by default one below the shared
    folder that goes afterwards; a folder with states is gone on from.
    """
    spark, first = rows.sparkSession, wanted[0][2]
    if any((s.batch, s.classification) != (first.batch, first.classification) for _, _, s in wanted):
        raise ValueError("heads that are trained together have one size of batches and one kind of loss")
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("double").alias("y"), F.coalesce(F.col("valid"), F.lit(False)).alias("valid"), F.transform("values", lambda v: v.cast("double")).alias("values"))
    counts = {(r["valid"], r["y"]): r["n"] for r in rows.groupBy("valid", *(["y"] if first.classification else [])).agg(F.count(F.lit(1)).alias("n"), *([] if first.classification else [F.first("y").alias("y")])).collect()}
    n = sum(c for (v, _), c in counts.items() if not v)
    if not n or n == sum(counts.values()):
        raise ValueError("training and validation both need rows")
    weights = np.zeros(0)
    if first.classification:
        head = wanted[0][0]
        classes = head["out2.b" if "out2.b" in head else "out.mlp2.b"].size
        per = np.array([counts.get((False, float(c)), 0) for c in range(classes)], float)
        weights = 1 / np.maximum(per, 1)
        weights *= classes / weights.sum()
    batches, held_chunks = -(-n // first.batch), -(-(sum(counts.values()) - n) // _HELD)
    width = max(a + w for a, w in cuts)
    folder = keep or f"{shared_root(spark).rstrip('/')}/training-{uuid.uuid4().hex}"
    if tasks:
        rows = rows.repartition(tasks, "row_id")

    def state_of(k: int) -> _State:
        store, place = pafs.FileSystem.from_uri(f"{folder}/head-{k:03d}")
        state = _State(flat(wanted[k][0]), wanted[k][2].rate)
        if raw := _latest(store, place):
            state.load(raw)
        return state

    def run(parts: Iterator[pa.RecordBatch], epochs: dict[int, int]) -> Iterator[pa.RecordBatch]:
        for k, mine in itertools.groupby((b for p in parts for b in _by_head(p)), key=lambda b: b.column(0)[0].as_py()):
            like, kind, s = wanted[k]
            store, place = pafs.FileSystem.from_uri(f"{folder}/head-{k:03d}")
            store.create_dir(place, recursive=True)
            state, loss, total, held = _State(flat(like), s.rate), 0.0, 0.0, np.zeros(2)
            if epochs[k]:
                with store.open_input_stream(f"{place}/epoch-{epochs[k]:06d}.npz") as f:
                    state.load(f.read())
            for chunk, data in _chunks(mine, width):
                xs = [np.ascontiguousarray(data["x"][:, a : a + w]) for a, w in cuts]
                y, own = np.ascontiguousarray(data["y"]), data["batch"]
                if chunk >= _AFTER:
                    held += mean_loss(unflat(state.weights, like), kind, xs, y, weights, s.classification)
                    continue
                ends = np.flatnonzero(np.append(np.diff(own), 1)) + 1
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    on = blocks_on(s, state.epoch, int(own[a]), len(cuts))
                    got = slopes(unflat(state.weights, like), kind, [x[a:b] for x in xs], y[a:b], weights, on, s.classification)
                    if got[-1] > 0:
                        state.step(got[:-2] / got[-1], s.clip)
                        loss, total = loss + got[-2], total + got[-1]
            more = state.close(s, loss / max(total, 1e-300), held[0] / max(held[1], 1e-300))
            name = f"{place}/epoch-{state.epoch:06d}.npz"
            part = f"{name}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(state.dump())
            store.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([state.epoch], pa.int32()), pa.array([more])], ["head", "epoch", "more"])

    states = [state_of(k) for k in range(len(wanted))]
    going = {k: st.epoch for k, (st, (_, _, s)) in enumerate(zip(states, wanted, strict=True)) if st.epoch < s.epochs and st.stale < s.patience}
    before = spark.conf.get(limit := "spark.sql.execution.arrow.maxRecordsPerBatch")
    while going:
        numbers, epochs = list(going), dict(going)
        dealt = _dealt(rows, [(k, wanted[k][2], epochs[k]) for k in numbers], batches, held_chunks, width)
        place = F.element_at(F.create_map(*[F.lit(v) for i, k in enumerate(numbers) for v in (k, i)]), F.col("head"))
        sorted_ = dealt.repartitionById(len(numbers), place).sortWithinPartitions("head", "chunk")
        step = sorted_.mapInArrow(lambda parts, e=epochs: run(parts, e), "head int, epoch int, more boolean")
        spark.conf.set(limit, "256")  # rows that are packed are long
        try:
            told = step.collect()  # a row for each head
        finally:
            spark.conf.set(limit, before)
        going = {r["head"]: r["epoch"] for r in told if r["more"]}
    states = [state_of(k) for k in range(len(wanted))]
    if not keep:
        forget(spark, folder)
    return [(unflat(st.best_weights, head), [(int(e), *rest) for e, *rest in st.history]) for st, (head, _, _) in zip(states, wanted, strict=True)]


def _by_head(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of sorted rows, each of one head."""
    heads = batch.column(0).to_numpy()
    ends = (np.flatnonzero(np.append(np.diff(heads), 1)) + 1).tolist() if len(heads) else []
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        yield batch.slice(a, b - a)


def train_fusion(rows: DataFrame, head: Head, kind: str, cuts: list[tuple[int, int]], s: Training, tasks: int | None = None, keep: str | None = None) -> tuple[Head, DataFrame]:
    """(the head of the epoch of least validation loss, history (epoch, train, valid, rate)) of one head, as in :func:`train_heads`."""
    trained, history = train_heads(rows, [(head, kind, s)], cuts, tasks, keep)[0]
    return trained, rows.sparkSession.createDataFrame(history, "epoch int, train double, valid double, rate double")
