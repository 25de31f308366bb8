"""One id, text or null on a third of the rows; ids that repeat; the tokenizer's own classes of characters."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import huffman as H
from plumbline.llm import langid as G
from plumbline.llm import mixing as M
from plumbline.llm import queries as Q
from plumbline.llm import topk as K
from plumbline.llm import warc as W
from plumbline.llm.tokens import TextEncoder


def test_all_code_points_get_the_ids_of_the_library(tokenizer):
    """Every assigned character but ideographs and syllables, and every seventh of all others."""
    from tokenizers import Tokenizer

    fresh, own = Tokenizer.from_file(tokenizer), TextEncoder(tokenizer)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or unicodedata.category(chr(c)) not in ("Cn", "Co", "Lo"))]
    for k in range(0, len(points), 3000):
        text = "\n".join("{c}'s c1 a{c}b {c}{c} 7{c} x {c} {c}y {c}.".replace("{c}", chr(c)) for c in points[k : k + 3000])
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_wide_vocabularies(spark, tmp_path, monkeypatch):
    """Ids of four bytes: counts, files and results keep them."""
    class Wide:
        width = 4

        class tok:
            get_vocab = staticmethod(lambda with_added_tokens: {"a": 5, "b": 90_000})

    def ids_of(docs, path, end_id):
        rows = [(1, np.array([90_000, 5, 70_001, end_id], "<u4").tobytes()), (2, np.array([70_001, end_id], "<u4").tobytes())]
        return docs.sparkSession.createDataFrame([(d, len(x) // 4, bytearray(x)) for d, x in rows], "doc_id long, n_tokens long, ids binary")

    monkeypatch.setattr(H, "encoder", lambda path: Wide)
    monkeypatch.setattr(H, "encode_texts", ids_of)
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in H.encode_corpus(spark.range(1), "-", end_id=2).collect()}
    assert got == {1: [90_000, 5, 70_001, 2], 2: [70_001, 2]}


def test_queries_of_token_ids(spark, sf_dir, tokenizer):
    """op1 and op2 over a whole table, against the library on whole texts."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer)
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, sf_dir, "documents").collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    one = Q.op1_token_ids(spark, sf_dir)
    assert one.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    at, told = 0, {r["doc_id"]: r for r in one.collect()}
    for i in sorted(texts):
        ids = [*fresh.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (told[i]["start"], told[i]["n_tokens"], told[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    two = Q.op2_packing(spark, sf_dir)
    assert two.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces, filled = {}, {}
    for r in two.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids, end = [*fresh.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == end and r["ids_crc32"] == crc(ids[end : end + r["length"]]) and r["doc_tokens"] == len(ids)
            end += r["length"]
        assert end == len(ids)
    for spans in filled.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 1024


def test_mix_takes_the_same_rows_however_they_are_dealt(spark):
    rows = [(None if i % 3 == 0 else i // 40, f"w{i} " * (1 + i % 4), "a" if i % 2 else "b") for i in range(600)]
    weights = spark.createDataFrame([(1, 2.0)], "doc_id long, quality_weight double")
    seen = []
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        seen.append(Counter(tuple(r) for r in M.mixed_documents(docs, weights).collect()))
    assert seen[0] == seen[1] == seen[2]


def test_rows_without_an_id_fall_into_many_ranges(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(500)], "doc_id long, text string")
    assert df.select(M.uniform(F.col("doc_id"), F.col("text")).alias("u")).distinct().count() == 500


def test_sample_of_languages_is_bounded_by_rows(spark, monkeypatch):
    rows = [(0 if i % 3 == 0 else i, f"some words of {'abcdefghij'[i % 10]} {i}", ("en", "de")[i % 2]) for i in range(3000)] + [(0, "a copy", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    plain = G.spherical_kmeans
    monkeypatch.setattr(G, "spherical_kmeans", lambda x, k: seen.append(len(x)) or plain(x, k))
    G.fit_languages(docs, per_lang=20, languages=2)
    assert len(seen) == 2 and sum(seen) <= 80
    many = spark.createDataFrame([(i, f"words {i}", f"lang{i % 50}") for i in range(500)], "doc_id long, text string, lang string")
    assert len(set(G.fit_languages(many, languages=5).langs)) == 5


def test_dictionary_sample_is_bounded_by_rows(spark, monkeypatch):
    rows = [(1 if i % 3 == 0 else i, f"u{i}", f"<p>page {i}</p>") for i in range(3000)]
    seen = []
    monkeypatch.setattr(W, "train_dictionary_from", lambda samples: seen.append(len(samples)) or b"")
    W.train_dictionary(W.revisit_plan(spark.createDataFrame(rows, "page_id long, url string, html string")), samples=40)
    assert seen == [40]


@pytest.mark.parametrize("block", [3, 4096])
def test_every_query_row_is_asked(spark, block):
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(60, 4)), 2)
    ids = [50 if i % 3 == 0 else i for i in range(60)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    vectors = K.integer_vectors(table)
    got = Counter((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in K.top_k(vectors, vectors.where("vec_id % 50 = 0"), 3, block).collect())
    z, want = np.floor(256 * x).astype(int), Counter()
    for q in range(60):
        if ids[q] % 50 == 0:
            best = sorted((-int(z[q] @ z[c]), ids[c]) for c in range(60) if ids[c] != ids[q])[:3]
            want.update((ids[q], k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert got == want


def test_held_out_columns(spark, sf_dir):
    for name, modulus, rest in (("op7_langid", 4, 2), ("op11_quality", 5, 0)):
        df = Q.QUERIES[name](spark, sf_dir)
        rows = df.collect()
        assert len(rows) == Q.table(spark, sf_dir, "documents").count()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_held_out_quality(spark):
    """Trained on the other rows of a larger table, nearly all held-out labels are told right."""
    d = "/root/testdata/sf0.1"
    quality = {r["doc_id"]: r["quality"] for r in Q.table(spark, d, "labels").collect()}
    rows = [(quality[r["doc_id"]], r["score"]) for r in Q.op11_quality(spark, d).where("held_out").collect() if quality.get(r["doc_id"]) is not None]
    good, bad = (np.array([s for q, s in rows if q == k]) for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and np.mean([(s >= 0.3) == (q == 1) for q, s in rows]) > 0.95




def test_pipeline_stages_take_columns_of_any_name(spark):
    import corpus_pipeline as P

    rows = [(i, f"words of text {i % 5} " * 12, "en", "a", 0, i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b c` int")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    kept = P.near_duplicate(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 5
    assert P.substring_dedup(spark, docs, "").columns == docs.columns and P.substring_dedup(spark, docs, "").count() == 20
    mixed = M.mixed_documents(docs, M.quality_weights(labels))
    assert mixed.columns == docs.columns and {r["a.b c"] for r in mixed.collect()} <= set(range(20))
