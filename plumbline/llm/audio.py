"""Operator 3: audio features of 8-bit sounds: polyphase resampling, log-mel filterbanks, hysteresis segments.

A payload is stored as a mono 8-bit PCM WAVE file in a table of the shared folder and read back from there. Features
come from blocks of ``BLOCK`` frames, each resampled from just the samples it needs, so memory for filters and spectra
is bounded however long a sound is; log-mel frames and energies themselves grow with it. They are returned as an Arrow
IPC stream of fixed-shape tensors (``CHUNK`` frames x ``MELS`` bands, half floats, zero-padded) with a time span each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import written

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 24
WIN, HOP, FFT, MELS = 300, 120, 512, 24
CHUNK, BLOCK = 64, 4096
RISE, FALL = 1.5, 0.0  # dB above the sound's mean level at which a segment starts and below which it ends
WAVE = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wave_file(payload: bytes) -> bytes:
    """A mono 8-bit WAVE file; an odd payload gets the format's pad byte."""
    pad = b"\0" * (len(payload) & 1)
    return WAVE.pack(b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + pad


def wave_payload(data: bytes) -> bytes:
    """The samples of :func:`wave_file`; ValueError if the header or the lengths are wrong."""
    if len(data) < WAVE.size:
        raise ValueError("too short for a WAVE file")
    riff, size, kind, fmt, n, code, channels, rate, _, _, bits, mark, length = WAVE.unpack_from(data)
    if (riff, kind, fmt, n, code, channels, rate, bits, mark) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, RATE, 8, b"data") or size + 8 != len(data) or WAVE.size + length + (length & 1) != len(data):
        raise ValueError("not a mono 8-bit WAVE file of this rate")
    return data[WAVE.size : WAVE.size + length]


def payload_of(text: str | None, unit: int = 576) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with 255 to a positive multiple of ``unit``, their number without padding); null is empty."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw)), len(raw)


@cache
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polyphase filters UP x TAPS, window, mel bands)."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    taps = np.sinc(n * cut) * cut * UP * np.hamming(len(n))
    taps *= UP / taps.sum()
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    hz = np.arange(FFT // 2 + 1) * rate / FFT
    up, down = (hz - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - hz) / np.diff(edges)[1:, None]
    return taps.reshape(TAPS, UP).T.astype(np.float32), np.hanning(WIN).astype(np.float32), np.clip(np.minimum(up, down), 0, None).T.astype(np.float32)


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Output samples ``first`` .. ``first + count`` at RATE * UP / DOWN, from 8-bit samples; silence beyond the ends.

    Output m uses the filter of phase m * DOWN mod UP on the TAPS inputs that end TAPS / 2 after m * DOWN / UP. Outputs
    that are UP apart have the same phase and inputs DOWN apart, so each phase is a few strided products.
    """
    phases, _, _ = _filters()
    out = np.zeros(count, np.float32)
    for j in range(min(UP, count)):
        n = len(out[j::UP])
        whole, phase = divmod((first + j) * DOWN, UP)
        lo = whole + TAPS // 2 - TAPS + 1
        x = np.zeros((n - 1) * DOWN + TAPS, np.float32)
        a, b = max(lo, 0), min(lo + len(x), len(samples))
        if a < b:
            x[a - lo : b - lo] = (samples[a:b].astype(np.float32) - 128) / 128
        for k in range(TAPS):
            at = TAPS - 1 - k
            out[j::UP] += phases[phase, k] * x[at : at + (n - 1) * DOWN + 1 : DOWN]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS natural logs of band powers, level of each frame in dB); the last frame is padded with silence."""
    _, window, bands = _filters()
    total = -(-len(samples) * UP // DOWN)
    n = 1 + max(0, -(-(total - WIN) // HOP))
    mels, level = np.zeros((n, MELS), np.float32), np.zeros(n, np.float32)
    for f in range(0, n, BLOCK):
        m = min(BLOCK, n - f)
        y = resample(samples, f * HOP, (m - 1) * HOP + WIN)
        frames = np.lib.stride_tricks.sliding_window_view(y, WIN)[::HOP] * window
        power = np.abs(np.fft.rfft(frames, FFT, axis=1)).astype(np.float32) ** 2
        mels[f : f + m] = np.log(power @ bands + 1e-6)
        level[f : f + m] = 10 * np.log10(np.mean(frames * frames, axis=1) + 1e-10)
    return mels, level


def hysteresis(level: np.ndarray, rise: float = RISE, fall: float = FALL) -> list[tuple[int, int]]:
    """Frame ranges that start where the level is over mean + rise and end where it falls below mean + fall."""
    mean = float(np.mean(level, dtype=np.float64)) if len(level) else 0.0
    state = np.where(level > mean + rise, 1, np.where(level < mean + fall, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.concatenate([[0], np.where(known >= 0, state[known], 0), [0]])
    return list(zip(np.flatnonzero(np.diff(on) == 1).tolist(), np.flatnonzero(np.diff(on) == -1).tolist(), strict=True))


@cache
def _schema() -> pa.Schema:
    return pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.fixed_shape_tensor(pa.float16(), [CHUNK, MELS]))])


def tensor_stream(mels: np.ndarray) -> bytes:
    """The log-mel frames as an Arrow IPC stream of (start_s, end_s, CHUNK x MELS tensor)."""
    n = -(-len(mels) // CHUNK)
    full = np.zeros((n * CHUNK, MELS), np.float16)
    full[: len(mels)] = mels
    start = np.arange(n) * CHUNK
    end = np.minimum(start + CHUNK, len(mels))
    second = HOP * DOWN / (UP * RATE)
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, CHUNK, MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _schema()) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(start * second), pa.array((end - 1) * second + WIN * DOWN / (UP * RATE)), tensors], schema=_schema()))
    return sink.getvalue().to_pybytes()


def store_media(docs: DataFrame) -> DataFrame:
    """Write each text's payload as a WAVE file to a table in the shared folder: (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                made = [payload_of(t) for t in batch.column(1).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array([n for _, n in made], pa.int64()), pa.array([wave_file(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "audio-media")[0]


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, segments array<struct<start_s: double, end_s: double>>, tensors binary"


def audio_features(media: DataFrame) -> DataFrame:
    """Per stored sound: sizes, digests, n_frames, segments (time spans) and tensors (Arrow IPC stream of fixed-shape tensors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = HOP * DOWN / (UP * RATE)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("tensors", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for doc, n, data in zip(*(c.slice(at, 200).to_pylist() for c in batch.columns), strict=True):
                    payload = wave_payload(data)
                    mels, level = log_mel(np.frombuffer(payload, np.uint8))
                    spans = [{"start_s": a * second, "end_s": (b - 1) * second + WIN * DOWN / (UP * RATE)} for a, b in hysteresis(level)]
                    rows.append({
                        "doc_id": doc, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
                        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "n_frames": len(mels), "segments": spans, "tensors": tensor_stream(mels),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    return media.mapInArrow(run, _OUT)


def document_audio(docs: DataFrame) -> DataFrame:
    """Store and analyse all texts; features and tensors are a table of the shared folder, as the media are, and are read from it.

    Null texts are empty payloads; null and repeated doc_ids stay; other columns are not read.
    """
    return written(audio_features(store_media(docs)), "audio-tensors")[0]
