"""Operator 7: language identification by the nearest of several centroids per language.

Texts become vectors of hashed byte n-grams (1 to 3 bytes, Latin-1 capitals lowered, all other ASCII one symbol) with weights ln(1 + tf) * idf, of length one.
Document frequencies count all learning documents. Centroids come from spherical k-means within each language, on a
bounded sample of about ``per_lang`` documents each, those of least hash, whole texts. A text goes to the language of
the centroid of highest cosine; its score is that cosine. Where the cosine is below what nearly all of the centroid's
own sample reach, the prediction is marked as not accepted. Equal cosines go to the language first by code point.

Equal texts get equal results; texts of any length are read
whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices

DIM = 4096
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[c for c in range(128) if not chr(c).isalpha()]] = 32  # digits, marks and white space are one symbol


def gram_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) of consecutive rows: texts x DIM counts of hashed n-grams; a null text has none."""
    for a, b in slices(texts, 256 << 10):
        part = texts.slice(a, b - a).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        lo, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        x = _LOWER[np.frombuffer(part.buffers()[2], np.uint8)[lo : lo + n]] if n else np.zeros(0, np.uint32)
        capital = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)) + 1
        x[capital] += np.uint32(32)  # Latin-1 capitals
        row = np.repeat(np.arange(len(part), dtype=np.int64) * DIM, np.diff(offsets))
        total, code = np.zeros(len(part) * DIM, np.int64), np.zeros(n, np.uint32)
        for k in range(min(3, n)):
            code = code[: n - k] * np.uint32(0x01000193) + x[k:] + np.uint32(1)
            inside = row[: n - k] == row[k:]
            at = row[: n - k] + ((code * np.uint32(0x9E3779B1)) >> np.uint32(20))
            total += np.bincount(at[inside] if k else at, minlength=len(total))
        yield a, total.reshape(len(part), DIM)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one; a text without n-grams stays zero."""
    out = np.log1p(counts.astype(np.float32))
    out *= idf
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, number of each row's centroid); starts from the first row and then the farthest ones."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        far = (x @ centres.T).max(axis=1)
        if far.min() > 1 - 1e-6:
            break
        centres = np.vstack([centres, x[far.argmin()]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.vstack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (x @ centres.T).argmax(axis=1)


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # of each centroid, the cosine below which a text is too far from it
    langs: list[str]  # of each centroid


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out (and not learnt from either)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_languages(docs: DataFrame, per_lang: int = 400, centroids: int = 6, reject: float = 0.005, languages: int = 200) -> LanguageModel:
    """Learn from (doc_id, text, lang); rows with a null id, text or lang and texts without a letter are left out.

    The sample takes rows by a hash of id and text, about ``per_lang`` of each of the ``languages`` most frequent languages and
    twice as many in all at most; equal texts of a language are one example. Frequencies count all rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, counts in gram_counts(batch.column(0)):
                df += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1), pa.int32()), pa.array(np.append(df, n))], ["gram", "df"])

    df = np.zeros(DIM + 1)
    for r in rows.select("text").mapInArrow(frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        df[r["gram"]] = r["df"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(F.broadcast(sizes), "lang").where(share < F.lit(float(per_lang)) / F.col("n")).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, counts in gram_counts(batch.column(1)):
                used = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(counts)), pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()), pa.array([c[u].astype("<u4").tobytes() for c, u in zip(counts, used, strict=True)], pa.binary())], ["lang", "grams", "counts"])

    coded = sample.mapInArrow(sparse, "lang string, grams binary, counts binary").dropDuplicates(["lang", "grams", "counts"])
    taken = sorted(coded.orderBy(F.xxhash64("lang", "grams", "counts"), "lang", "grams", "counts").limit(2 * per_lang * languages).collect())
    found, least, langs = [np.zeros((0, DIM), np.float32)], [], []
    for lang in sorted({r["lang"] for r in taken}):
        own = [r for r in taken if r["lang"] == lang]
        counts = np.zeros((len(own), DIM), np.int64)
        for k, r in enumerate(own):
            counts[k, np.frombuffer(r["grams"], "<u2")] = np.frombuffer(r["counts"], "<u4")
        x = vectors(counts, idf)
        centres, of = spherical_kmeans(x, centroids)
        for j, c in enumerate(centres):
            near = x[of == j] @ c
            least.append(float(np.quantile(near, reject)) * 0.8 if len(near) else 0.0)
            langs.append(lang)
        found.append(centres)
    return LanguageModel(idf, np.vstack(found).astype(np.float32), np.array(least), langs)


def predict_language(model: LanguageModel, text: Column) -> Column:
    """A struct (lang, score, accepted). Null texts, texts without a letter, and all texts of an empty model are ``und``, 0, false."""

    @F.pandas_udf("lang string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        column = pa.array(texts, pa.string(), from_pandas=True)
        lang, score, accepted = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        letters = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
        if len(model.langs):
            names = np.array(model.langs, object)
            for a, counts in gram_counts(column):
                cos = vectors(counts, model.idf) @ model.centroids.T
                best = cos.argmax(axis=1)
                at = slice(a, a + len(counts))
                top = np.clip(cos[np.arange(len(best)), best].astype(float), 0, 1)
                lang[at] = np.where(letters[at], names[best], "und")
                score[at] = np.where(letters[at], top, 0.0)
                accepted[at] = letters[at] & (top >= model.least[best])
        return pd.DataFrame({"lang": lang, "score": score, "accepted": accepted})

    return predict(text)
