"""Audio, top-k and WARC."""

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import audio as A
from plumbline.llm import topk as K
from plumbline.llm import warc as W


def test_wave_round_trip_and_faults():
    for payload in (b"\xff" * 576, bytes(range(256)) * 9, b"abc"):
        assert A.wave_payload(A.wave_file(payload)) == payload
    for bad in (b"", A.wave_file(b"ab")[:-1], b"X" + A.wave_file(b"ab")[1:]):
        with pytest.raises(ValueError):
            A.wave_payload(bad)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (3, 4)])
def test_resampling_keeps_a_tone_and_is_the_same_in_pieces(monkeypatch, up, down):
    monkeypatch.setattr(A, "UP", up), monkeypatch.setattr(A, "DOWN", down)
    A._filters.cache_clear()
    n = np.arange(4000)
    x = np.round(128 + 100 * np.sin(2 * np.pi * 0.02 * n)).astype(np.uint8)
    y = A.resample(x, 0, 1200)
    level = np.sqrt(np.mean(y[200:1000] ** 2)) / (100 / 128 / np.sqrt(2))
    assert 0.95 < level < 1.05
    assert np.array_equal(np.concatenate([A.resample(x, 0, 333), A.resample(x, 333, 867)]), y)
    monkeypatch.undo()
    A._filters.cache_clear()


def test_hysteresis():
    level = np.array([0, 0, 5, 3, 2.6, 5, 0, 2.7, 0, 6.0])
    mean = level.mean()
    want, on = [], False
    for v in level:
        on = v > mean + 1.5 or (on and not v < mean)
        want.append(on)
    spans = A.hysteresis(level, 1.5, 0.0)
    assert [any(a <= i < b for a, b in spans) for i in range(len(level))] == want
    assert A.hysteresis(np.zeros(5)) == [] and A.hysteresis(np.zeros(0)) == []


def test_document_audio(docs, rows, empty):
    got = A.document_audio(docs).collect()
    by = {}
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        by.setdefault(r[0], []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest()))
    same = {}
    for g in got:
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"]) in by[g["doc_id"]]
        assert same.setdefault(g["payload_sha256"], (bytes(g["tensors"]), g["segments"])) == (bytes(g["tensors"]), g["segments"])
        t = pa.ipc.open_stream(g["tensors"]).read_all()
        assert t.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float16(), [A.CHUNK, A.MELS])
        assert len(t) == -(-g["n_frames"] // A.CHUNK) and t["start_s"][0].as_py() == 0
    assert len(got) == len(rows) and A.document_audio(empty).count() == 0


def brute(vectors, queries, k):
    out = []
    for q, x in sorted({q: x for q, x in queries}.items()):
        s = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q and len(y) == len(x)))
        out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 300])
def test_top_k(spark, n, monkeypatch):
    rng = np.random.default_rng(n)
    data = [(i * 5, [float(v) for v in np.round(rng.normal(size=4), 1)]) for i in range(n)]
    data += [(7000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30 if n > 4 else 0)]  # ties
    rows = data + [(9001, None), (9050, [1.0, None, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (9100, [float("nan"), 0.0, 0.0, 0.0]), (9150, [])]
    vecs = K.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    ints = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in data]
    got = K.top_k(vecs, vecs.where("vec_id % 50 = 0"), 5, block=4)
    assert sorted(map(tuple, got.collect())) == brute(ints, [(i, x) for i, x in ints if i % 50 == 0], 5)


def test_large_scores_are_exact():
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**21, 3.0]])
    assert K._scores(q, v).tolist() == [[2**61 + 3]]


def test_scores_beyond_the_range(spark):
    """Products that leave 64 bits are held at the ends; components that overflow when scaled take no part."""
    rows = [(1, [1e300, 1.0]), (2, [1e300, 0.0]), (3, [-1e300, 0.0]), (4, [1e12, 1e12]), (5, [1e307, 0.0])]
    vecs = K.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in K.top_k(vecs, vecs, k=5).collect()}
    assert got[1, 2] == K.MOST and got[2, 3] == -K.MOST and got[4, 3] == -K.MOST
    assert all(5 not in pair for pair in got) and len(got) == 12


def test_warc(spark):
    page = lambda i, h: (i, f"https://e.org/{i}", h, "x")
    rows = [page(i, f"<p>{'é' * (i % 3)}{i % 5}</p>" * 9) for i in range(40)] + [page(90, None), page(91, ""), (None, None, "only", "x"), (92, None, "<p>0</p>" * 9, "x"), page(93, "a" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    got = {r["page_id"]: r for r in W.archive_pages(df).collect()}
    same = {}
    for i, _, h, _ in rows:
        same.setdefault((h or "").encode(), []).append(i)
    assert len(got) == len(rows)
    for data, ids in same.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            r = got[i]
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (r["record_type"], r["refers_to"]) == (("response", None) if i == top else ("revisit", top))
            assert (bytes(r["payload"]) == data) if i == top else r["payload"] is None
    assert W.archive_pages(df.where("false")).count() == 0


def archive(records, dictionary=b"WARC/1.1 some shared words " * 40):
    import zstandard

    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return struct.pack("<II", W.SKIPPABLE, len(dictionary)) + dictionary + b"".join(z.compress(r) for r in records)


def test_warc_faults():
    row = {"record_type": "response", "page_id": 4, "url": "https://e.org/\r\nX: y", "sha1": hashlib.sha1(b"body").hexdigest()}
    good = W.record(row, b"body")
    assert [r["payload"] for r in W.read_archive(archive([good, good]))] == [b"body", b"body"]
    for bad in (good[:-1], good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(ValueError):
            list(W.read_archive(archive([bad])))
    data = archive([good])
    for cut in (data[:-2], data[:4], b"\0" * 8 + data[8:], data + b"\0"):
        with pytest.raises(Exception, match=".+"):
            list(W.read_archive(cut))


def test_warc_of_another_writer():
    """Record types and fields that our writer doesn't use, folded and repeated fields, a frame without its size, more skippable frames."""
    import zstandard

    def raw(kind, block, *more, version=b"WARC/1.0"):
        fields = [f"WARC-Type:{kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2021-01-01T00:00:00Z", *more, f"CONTENT-length: {len(block)}"]
        return b"\r\n".join([version, *map(str.encode, fields)]) + b"\r\n\r\n" + block + b"\r\n\r\n"

    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    http = "Content-Type: application/http; msgtype=response"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n"
    rows = [
        raw("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Filename: a\r\n b"),
        raw("request", b"GET / HTTP/1.1\r\n\r\n", http, "WARC-Target-URI: https://e.org/", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>"),
        raw("response", W.HTTP + b"body", http, "WARC-Target-URI: https://e.org/", f"WARC-Payload-Digest: {sha1(b'body')}", f"WARC-Block-Digest: {sha1(W.HTTP + b'body')}", version=b"WARC/1.1"),
        raw("response", chunked, http, f"WARC-Payload-Digest: {sha1(b'ab')}"),
        raw("revisit", b"", http, f"WARC-Profile: {W.PROFILE}", f"WARC-Payload-Digest: {sha1(b'body')}"),
        raw("resource", b"", "Content-Type: text/plain"),
    ]
    dictionary = W.train_dictionary_from([])
    assert struct.unpack_from("<I", dictionary)[0] == W.DICTIONARY
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False)
    packed = zstandard.ZstdCompressor().compress(dictionary)
    skip = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    data = struct.pack("<II", W.SKIPPABLE, len(packed)) + packed + skip + b"".join(z.compress(r) for r in rows) + skip
    got = list(W.read_archive(data))
    assert [g["record_type"] for g in got] == ["warcinfo", "request", "response", "response", "revisit", "resource"]
    assert [g["payload"] for g in got] == [b"software: x\r\n", b"", b"body", b"2\r\nab\r\n0\r\n\r\n", None, b""]
    assert [g["url"] for g in got] == [None, "https://e.org/", "https://e.org/", None, None, None]
    assert all(g["page_id"] is None and g["refers_to"] is None for g in got) and "sha1:" + got[4]["payload_digest"] == sha1(b"body")
    for bad in (raw("reply", b""), raw("resource", b"x", f"WARC-Block-Digest: {sha1(b'y')}"), raw("resource", b"x", "A: 1", "A: 2"), raw("resource", b"x", "Bad name: 1"), raw("response", b"HTTP/1.1 200 OK", http)):
        with pytest.raises(ValueError):
            list(W.read_archive(data[: 8 + len(packed)] + z.compress(bad)))
    with pytest.raises(ValueError, match="cut off"):
        list(W.read_archive(data[:-1]))


@pytest.mark.parametrize(("up", "down"), [(3, 4), (3, 2)])
def test_features_are_those_of_a_plain_transform(monkeypatch, up, down):
    """Zeros between samples, one long convolution, every DOWN-th output; a DFT by its sum; triangles on the mel scale."""
    monkeypatch.setattr(A, "UP", up), monkeypatch.setattr(A, "DOWN", down), monkeypatch.setattr(A, "BLOCK", 7)
    A._filters.cache_clear()
    x = np.random.default_rng(up).integers(0, 256, 5760).astype(np.uint8)
    n = np.arange(up * A.TAPS) - (up * A.TAPS - 1) / 2
    taps = np.sinc(n / max(up, down)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(len(n)) / (len(n) - 1)))
    taps *= up / taps.sum()
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = (x - 128.0) / 128
    total = -(-len(x) * up // down)
    frames = 1 + -(-(total - A.WIN) // A.HOP)
    y = np.concatenate([np.convolve(stuffed, taps), np.zeros(down * (A.WIN + A.HOP))])[up * A.TAPS // 2 :: down]
    rate = A.RATE * up / down
    k, t = np.arange(A.FFT // 2 + 1), np.arange(A.WIN)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (A.WIN - 1))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = np.linspace(mel(60), mel(rate / 2), A.MELS + 2)
    hz_of = lambda m: 700 * (10 ** (m / 2595) - 1)
    want, level = [], []
    for f in range(frames):
        frame = y[f * A.HOP : f * A.HOP + A.WIN] * window
        power = np.abs((frame * np.exp(-2j * np.pi * np.outer(k, t) / A.FFT)).sum(axis=1)) ** 2
        bands = []
        for j in range(A.MELS):
            lo, mid, hi = hz_of(edges[j : j + 3])
            hz = k * rate / A.FFT
            bands.append((np.where(hz <= mid, (hz - lo) / (mid - lo), (hi - hz) / (hi - mid)).clip(0) * power).sum())
        want.append(np.log(np.array(bands) + 1e-6))
        level.append(10 * np.log10((frame**2).mean() + 1e-10))
    mels, levels = A.log_mel(x)
    monkeypatch.undo()
    A._filters.cache_clear()
    assert mels.shape == (frames, A.MELS) and np.abs(mels - want).max() < 2e-3 and np.abs(levels - level).max() < 1e-3
