"""The queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, filters, mixing, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import encode_corpus

    rows = encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    rows = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=1024)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import document_audio

    rows = document_audio(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(";", "n_frames", F.size("segments"), F.round(F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end_s"] - s["start_s"]), 3), F.sha2("tensors", 256))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "_toxicity.expected_severity", "_toxicity.severity_grade", "_toxicity.p_toxic", "_toxicity.toxic")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=75)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import without_repeats

    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, held_out, predict_language

    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict_language(model, F.col("text")).alias("p"))
    return told.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_k

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources, quality_weights

    rows = mix_sources(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, held_out, quality_score

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_packing": op2_packing,
    "op3_audio": op3_audio,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard": op5_jaccard,
    "op6_repeats": op6_repeats,
    "op7_langid": op7_langid,
    "op8_topk": op8_topk,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_quality": op11_quality,
    "op12_clustering": op12_clustering,
    "op13_filters": op13_filters,
}

_WORD = r"[^\x20\x09-\x0D]+"

JACCARD_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""

REPEATS_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word, len(ws) AS n, ws FROM w
), v AS (
  SELECT doc_id, i, n, word, CASE WHEN i + 19 <= n THEN array_to_string(ws[i:i + 19], ' ') END AS win FROM p
), f AS (
  SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM v
), c AS (
  SELECT *, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f
), k AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY 1
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY sha1(h), strlen(h)) AS top FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM x
"""

#: Queries without SQL need a tokenizer, a fitted model or media files; tests compare them with plain versions.
ORACLE_SQL: dict[str, str] = {"op5_jaccard": JACCARD_SQL, "op6_repeats": REPEATS_SQL, "op8_topk": topk.ORACLE, "op9_mixing": mixing.ORACLE, "op10_warc": WARC_SQL, "op12_clustering": clustering.oracle(), "op13_filters": filters.ORACLE}
