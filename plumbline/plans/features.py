"""Queries: fingerprints, normalisation, losses, pair operators, sampling, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import graphs as Q
from ..operators import pairs as P
from ..operators import sampling as A
from ..sources.blocks import read_parts, write_blocks
from ..sources.shared import shared_root, stored
from ..sources.tables import file_hashes, manifest_faults, table
from .base import query

_W = "WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: lower(x)) AS ws FROM documents)"


def _bucket(e: str, n: int) -> str:
    return f"CAST(('0x' || substr(md5({e}), 1, 8)) AS BIGINT) % {n}"


@query(f"""{_W}, t AS (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS token FROM w WHERE len(ws) >= 2)
SELECT doc_id, {_bucket('token', 1024)} AS bucket, count(*) AS n FROM t GROUP BY 1, 2""")
def hashed_ngram_counts(spark, d):
    return X.hashed_counts(X.with_words(table(spark, d, "documents"), "doc_id"), "doc_id", X.grams(F.col("ws"), 2), 1024)


@query(f"""{_W}, t AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || '~2~' || ws[i + 2])) AS token FROM w WHERE len(ws) > 2)
SELECT doc_id, {_bucket('token', 2048)} AS bucket, count(*) AS n FROM t GROUP BY 1, 2""")
def skip_pair_counts(spark, d):
    return X.hashed_counts(X.with_words(table(spark, d, "documents"), "doc_id"), "doc_id", X.skip_pairs(F.col("ws"), 2), 2048)


@query(f"""{_W}, t AS (SELECT DISTINCT doc_id, {_bucket('token', 167)} AS bucket FROM (SELECT doc_id, unnest(ws) AS token FROM w))
SELECT doc_id, count(*)::BIGINT AS n_bits, CAST(sum(bucket) AS BIGINT) AS total FROM t GROUP BY 1""")
def presence_bits(spark, d):
    bits = X.presence(X.with_words(table(spark, d, "documents"), "doc_id"), "doc_id", F.col("ws"), 167)
    return bits.select("doc_id", F.size("bits").cast("long").alias("n_bits"), F.aggregate("bits", F.lit(0).cast("long"), lambda a, i: a + i).alias("total"))


@query("""
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(len(ws) AS INTEGER) AS n_words, CAST(len(list_distinct(ws)) AS INTEGER) AS n_distinct, CAST(len(regexp_extract_all(text, '[0-9]')) AS INTEGER) AS n_digits,
       CAST(len(regexp_extract_all(text, '[A-Z]')) AS INTEGER) AS n_upper, CAST(len(regexp_extract_all(text, '\n')) AS INTEGER) AS n_lines
FROM (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: lower(x)) AS ws FROM documents)
""")
def text_descriptors(spark, d):
    return table(spark, d, "documents").select("doc_id", *X.text_descriptors(F.col("text")))


@query("""
WITH l AS (SELECT vec_id, vec_id % 10 < 7 AS tr, unnest(range(64)) AS idx, CAST(unnest(embedding) AS DOUBLE) * 400 AS x FROM embeddings),
q AS (SELECT least(1e4, greatest(50.0, quantile_cont(abs(x), 0.999))) AS lim FROM l WHERE tr),
c AS (SELECT vec_id, tr, idx, greatest(-lim, least(lim, x)) AS x FROM l, q),
m AS (SELECT idx, avg(x) AS m FROM c WHERE tr GROUP BY 1), s AS (SELECT idx, m, sqrt(avg((x - m) * (x - m))) AS s FROM c JOIN m USING (idx) WHERE tr GROUP BY 1, 2)
SELECT vec_id AS row_id, CAST(idx AS INTEGER) AS idx, round((x - m) / CASE WHEN s < 1e-6 THEN 1.0 ELSE s END, 5) + 0.0 AS z FROM c JOIN s USING (idx)
""")
def clip_p999_standardize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 400)
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), scaled.alias("values"))
    out = X.clip_and_standardize(df, "values", F.col("row_id") % 10 < 7)
    return out.select("row_id", "idx", (F.round("z", 5) + 0.0).alias("z"))


@query("""
SELECT event_id, round(coalesce(x, quantile_cont(x, 0.5) OVER (PARTITION BY event_type)), 6) AS value FROM (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x FROM events)
""")
def median_impute(spark, d):
    x = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    df = table(spark, d, "events").select("event_id", "event_type", x.alias("value"))
    return X.median_impute(df, ["value"], ["event_type"]).select("event_id", F.round("value", 6).alias("value"))


@query("""
SELECT a.vec_id AS pos_id, b.vec_id AS neg_id, round(ln(1 + exp(-(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1]))), 9) AS loss
FROM embeddings a JOIN embeddings b ON a.vec_id // 64 = b.vec_id // 64 WHERE a.label >= 5 AND b.label < 5
""")
def pairwise_margin(spark, d):
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") >= 5).cast("int").alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return P.margin_losses(df, by=F.floor(F.col("row_id") / 64)).withColumn("loss", F.round("loss", 9))


@query("""
SELECT a.vec_id AS row_id, round(1 + sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE 1 / (1 + exp(-(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1]) / 0.1)) END), 6) AS soft_rank
FROM embeddings a JOIN embeddings b ON a.vec_id // 64 = b.vec_id // 64 GROUP BY 1
""")
def soft_rank(spark, d):
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return P.soft_ranks(df, 0.1, by=F.floor(F.col("row_id") / 64)).withColumn("soft_rank", F.round("soft_rank", 6))


@query()
def pairwise_margin_batches(spark, d):
    """The losses over the whole table, in batches of 64 rows by a hash instead of by id."""
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") >= 5).cast("int").alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return P.margin_losses(df, size=64)


@query()
def soft_rank_batches(spark, d):
    """The soft ranks over the whole table, in batches of 64 rows by a hash instead of by id."""
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return P.soft_ranks(df, 0.1, size=64)


@query("""
WITH h AS (SELECT vec_id, label, unnest([1, 2, 3, 4]) AS head, unnest([embedding[1], embedding[2], embedding[3], embedding[4]])::DOUBLE AS v FROM embeddings)
SELECT a.head AS head_a, b.head AS head_b, round(power(sum(a.v * b.v), 2) / (sum(a.v * a.v) * sum(b.v * b.v)), 9) AS cosine2
FROM h a JOIN h b ON a.vec_id = b.vec_id AND a.head < b.head GROUP BY 1, 2
""")
def head_pair_cosine(spark, d):
    heads = F.array(*[F.struct(F.lit(i + 1).alias("head"), F.get("embedding", F.lit(i)).cast("double").alias("v")) for i in range(4)])
    long = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.inline(heads))
    return P.head_cosines(long).withColumn("cosine2", F.round("cosine2", 9))


@query("""
WITH x AS (SELECT label % 2 AS y, CAST(embedding[1] AS DOUBLE) * 3 AS s, CAST(embedding[2] AS DOUBLE) * 3 AS t FROM embeddings), p AS (SELECT y, s - t AS e, s, 1 / (1 + exp(-s)) AS p FROM x)
SELECT y, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 8) AS cross_entropy, round(avg(-power(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END, 2) * ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 8) AS focal,
       round(avg(CASE WHEN abs(e) < 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), 8) AS smooth_l1, round(avg(e * e), 8) AS mse FROM p GROUP BY y
""")
def loss_values(spark, d):
    c = lambda i: F.get("embedding", F.lit(i)).cast("double") * 3
    df = table(spark, d, "embeddings").select((F.col("label") % 2).alias("y"), c(0).alias("s"), c(1).alias("t"))
    return P.losses(df, ["y"], 8)


@query("""
WITH x AS (SELECT vec_id // 64 AS batch, vec_id AS i, label % 2 AS y, CAST(embedding[1] AS DOUBLE) * 3 AS s, CAST(embedding[2] AS DOUBLE) * 3 AS t FROM embeddings),
c AS (SELECT *, CASE WHEN y = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, -ln(1 / (1 + exp(CASE WHEN y = 1 THEN -s ELSE s END))) AS ce FROM x),
b AS (SELECT batch, count(*) AS n, avg(power(1 - exp(-w * ce), 2) * w * ce) AS focal, sum(w * ce) / sum(w) AS ce, avg((s - t) * (s - t)) AS mse FROM c GROUP BY 1),
h AS (SELECT batch, i, s, exp(s) / sum(exp(s)) OVER (PARTITION BY batch) AS w FROM x WHERE y = 0),
p AS (SELECT batch, avg(l * w) AS hardest, avg(l) AS even FROM (SELECT a.batch, h.w, ln(1 + exp(0.5 - (a.s - h.s))) AS l FROM x a JOIN h USING (batch) WHERE a.y = 1) GROUP BY 1),
r AS (SELECT a.batch, a.i, sum(1 / (1 + exp(-10 * (a.s - o.s)))) AS rs, sum(1 / (1 + exp(-10 * (a.t - o.t)))) AS rt,
      sum(CASE WHEN a.i < o.i THEN greatest(0, 0.1 - sign(a.t - o.t) * (a.s - o.s)) ELSE 0 END) AS miss FROM x a JOIN x o USING (batch) GROUP BY 1, 2),
k AS (SELECT batch, corr(rs, rt) AS corr, sum(miss) / (count(*) * (count(*) - 1) / 2 + 1e-8) AS ord FROM r GROUP BY 1)
SELECT batch, CAST(n AS INTEGER) AS n, round(CASE WHEN hardest IS NULL THEN focal ELSE 0.65 * focal + 0.35 * hardest END, 7) AS ap_surrogate, round(CASE WHEN even IS NULL THEN ce ELSE 0.75 * ce + 0.25 * even END, 7) AS auroc_margin,
       round(0.1 * mse - corr, 7) AS spearman, round(0.5 * mse + 0.5 * ord, 7) AS ranking_mse FROM b JOIN k USING (batch) LEFT JOIN p USING (batch)
""")
def ranking_losses(spark, d):
    """Surrogate losses of all training batches of 64 ids."""
    c = lambda i: F.get("embedding", F.lit(i)).cast("double") * 3
    df = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), c(0).alias("s"), c(1).alias("t"))
    out = P.ranking_losses(df, F.floor(F.col("vec_id") / 64), weights=(1.0, 2.0))
    return out.select("batch", "n", *[F.round(m, 7).alias(m) for m in ("ap_surrogate", "auroc_margin", "spearman", "ranking_mse")])


@query("""
WITH w AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 4 ELSE 1 END AS w FROM labels), c AS (SELECT doc_id, w, sum(w) OVER (ORDER BY doc_id) - w AS lo, sum(w) OVER (ORDER BY doc_id) AS hi, sum(w) OVER () AS t FROM w),
n AS (SELECT i, floor(CAST(('0x' || substr(md5('draw|' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE * (SELECT sum(w) FROM w)) AS u FROM range((SELECT count(*) FROM w)) r(i))
SELECT i AS draw, doc_id FROM n JOIN c ON u >= lo AND u < hi
""")
def weighted_sampling(spark, d):
    df = table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("toxic") == 1, 4).otherwise(1).alias("weight"))
    return A.draw_with_replacement(df).select("draw", F.col("row_id").alias("doc_id"))


@query("""
SELECT conv_id, CAST(pos AS INTEGER) AS pos, score, CAST(b AS INTEGER) AS batch FROM (
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, CAST(length(text) AS INTEGER) AS score, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 3 AS b FROM conversations)
""")
def minibatch_numbers(spark, d):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    df = table(spark, d, "conversations").select("conv_id", pos.alias("pos"), F.length("text").alias("score"))
    return df.withColumn("batch", F.floor((F.col("pos") - 1) / 3).cast("int"))


@query("""
WITH RECURSIVE m AS (SELECT conv_id AS run, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS epoch, CAST(length(text) AS DOUBLE) AS metric FROM conversations),
r AS (SELECT run, epoch, metric AS best, 0 AS bad, 0.1::DOUBLE AS rate FROM m WHERE epoch = 1
      UNION ALL
      SELECT run, epoch, greatest(best, metric), CASE WHEN stale > 1 THEN 0 ELSE stale END, CASE WHEN stale > 1 THEN rate * 0.5::DOUBLE ELSE rate END
      FROM (SELECT m.run, m.epoch, m.metric, r.best, r.rate, CASE WHEN m.metric > r.best THEN 0 ELSE r.bad + 1 END AS stale FROM r JOIN m ON m.run = r.run AND m.epoch = r.epoch + 1))
SELECT run, epoch, rate FROM r
""")
def plateau_schedule(spark, d):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    df = table(spark, d, "conversations").select(F.col("conv_id").alias("run"), pos.alias("epoch"), F.length("text").cast("double").alias("metric"))
    return A.plateau_rates(df, first=0.1, factor=0.5, patience=1)


_NAMES = "WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'embed_chem_' ELSE 'chem_' END || replace(lower(n_name), ' ', '_') || CASE WHEN n_nationkey % 3 = 0 THEN '_base_pred' ELSE '' END AS block, CASE WHEN n_nationkey % 4 = 0 THEN 'xl_v4_' ELSE '' END || replace(lower(n_name), ' ', '_') || '_family' AS family FROM nation)"


@query(_NAMES + """ SELECT block, regexp_replace(regexp_replace(block, '^(embed_chem_|chem_)', ''), '_base_pred$', '') AS profile,
CASE WHEN starts_with(block, 'embed_chem_') THEN regexp_replace(family, '^xl_v4_', '') END AS candidate, regexp_matches(block, '_base_pred$') AS base_prediction FROM n""")
def profile_parser(spark, d):
    """Component names of every nation, as a table of recorded feature blocks and families."""
    k, name = F.col("n_nationkey"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_"))
    block = F.concat(F.when(k % 2 == 0, "embed_chem_").otherwise("chem_"), name, F.when(k % 3 == 0, "_base_pred").otherwise(""))
    family = F.concat(F.when(k % 4 == 0, "xl_v4_").otherwise(""), name, F.lit("_family"))
    named = table(spark, d, "nation").select(block.alias("block"), family.alias("family"))
    return named.select("block", *X.parse_profile(F.col("block"), F.col("family")))


@query("""
WITH b AS (SELECT r_regionkey AS pos, replace(lower(r_name), ' ', '_') AS prefix, (r_regionkey * 37) % 5 AS width FROM region), s AS (SELECT *, sum(width) OVER (ORDER BY pos) - width AS base FROM b)
SELECT prefix || '.' || CAST(i AS VARCHAR) AS name, CAST(base + i AS INTEGER) AS idx FROM (SELECT prefix, base, unnest(range(CAST(width AS BIGINT))) AS i FROM s)
""")
def column_names(spark, d):
    blocks = table(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("_")).alias("prefix"), (F.col("r_regionkey") * 37 % 5).alias("width"))
    return X.column_names(blocks)


_CUT = {"C": (1, 8), "K": (9, 16), "E": (25, 40)}  # start and width of the stand-ins of three encoders in a vector


def _sql_blocks(letters: str) -> str:
    return " || ".join(f"embedding[{_CUT[c][0]}:{_CUT[c][0] + _CUT[c][1] - 1}]" for c in letters)


@query("SELECT vec_id, candidate, CAST(len(m) AS INTEGER) AS width, CAST(m[1] AS DOUBLE) AS first, CAST(m[len(m)] AS DOUBLE) AS last FROM (" + " UNION ALL ".join(f"SELECT vec_id, '{c}' AS candidate, {_sql_blocks(b)} AS m FROM embeddings" for c, b in X.CANDIDATES.items()) + ")")
def embedding_candidates(spark, d):
    """The blocks of each embedding candidate in their order."""
    blocks = {c: F.slice("embedding", at, n) for c, (at, n) in _CUT.items()}
    each = F.array(*[F.struct(F.lit(c).alias("candidate"), X.assembled(blocks, X.candidate_blocks(c)).alias("m")) for c in X.CANDIDATES])
    out = table(spark, d, "embeddings").select("vec_id", F.inline(each))
    return out.select("vec_id", "candidate", F.size("m").alias("width"), F.get("m", F.lit(0)).cast("double").alias("first"), F.element_at("m", -1).cast("double").alias("last"))


@query("SELECT vec_id, mask, CAST(len(m) AS INTEGER) AS width, round(list_sum(list_transform(m, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM (" + " UNION ALL ".join("SELECT vec_id, '" + name + "' AS mask, " + " || ".join(_sql_blocks(c) if c in on else f"list_transform(range({_CUT[c][1]}), lambda i: 0.0::FLOAT)" for c in "CKE") + " AS m FROM embeddings" for name, on in X.MASKS.items()) + ")")
def named_modality_masks(spark, d):
    """The seven named masks over three blocks."""
    blocks = [(F.slice("embedding", at, n), n) for at, n in _CUT.values()]
    each = F.array(*[F.struct(F.lit(name).alias("mask"), X.masked_blocks(blocks, X.modality_mask(name)).alias("m")) for name in X.MASKS])
    out = table(spark, d, "embeddings").select("vec_id", F.inline(each))
    return out.select("vec_id", "mask", F.size("m").alias("width"), F.round(S.array_sum(F.col("m")), 6).alias("total"))


_ORDER = ["kpgt", "chemberta"]


@query("SELECT vec_id, CAST(len(m) AS INTEGER) AS width, CAST(m[1] AS DOUBLE) AS first, CAST(m[9] AS DOUBLE) AS middle, CAST(m[len(m)] AS DOUBLE) AS last FROM (SELECT vec_id, embedding[57:64] || embedding[9:24] || embedding[1:8] || [CAST(label AS FLOAT)] AS m FROM embeddings)")
def assembled_features(spark, d):
    """Embedding first, blocks in their order, base prediction last."""
    blocks = {"chemberta": F.slice("embedding", 1, 8), "kpgt": F.slice("embedding", 9, 16)}
    m = X.assembled(blocks, _ORDER, embedding=F.slice("embedding", 57, 8), base=F.col("label"))
    out = table(spark, d, "embeddings").select("vec_id", m.alias("m"))
    return out.select("vec_id", F.size("m").alias("width"), *[F.element_at("m", i).cast("double").alias(n) for i, n in ((1, "first"), (9, "middle"), (-1, "last"))])


@query(f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'd' WHEN regexp_matches(x, '^[A-Z]') THEN 'U' WHEN regexp_matches(x, '^[a-z]+$') THEN 'l' ELSE 'o' END) AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS token FROM w WHERE len(ws) >= 3)
SELECT doc_id, {_bucket('token', 1024)} AS bucket, count(*) AS n FROM t GROUP BY 1, 2""")
def token_class_counts(spark, d):
    """Hashed counts of runs of three word classes."""
    ws = F.regexp_extract_all("text", F.lit(f"({X.WORD})"), 1)
    classes = table(spark, d, "documents").select("doc_id", F.inline(F.array(F.struct(X.token_classes(ws).alias("ws")))))
    return X.hashed_counts(classes, "doc_id", X.grams(F.col("ws"), 3), 1024)


@query(f"""{_W}, t AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS token FROM w WHERE len(ws) >= 3)
SELECT doc_id, {_bucket('token', 2048)} AS bucket, count(*) AS n FROM t GROUP BY 1, 2""")
def hashed_trigram_counts(spark, d):
    """The order above :func:`hashed_ngram_counts`."""
    return X.hashed_counts(X.with_words(table(spark, d, "documents"), "doc_id"), "doc_id", X.grams(F.col("ws"), 3), 2048)


@query("""
SELECT key, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, coalesce(nullif(regexp_extract(text, '^([A-Z][a-z]+) ', 1), ''), 'invalid::' || CAST(doc_id AS VARCHAR)) AS key FROM documents) GROUP BY key
""")
def single_invalid_groups(spark, d):
    """Groups by a leading capitalised word; documents without one are groups of their own."""
    key = F.nullif(F.regexp_extract("text", "^([A-Z][a-z]+) ", 1), F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", X.group_key(key, F.col("doc_id").cast("string")).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


_LABELS = "CASE event_id % 11 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END"


@query(f"""
WITH y AS (SELECT event_id, event_type, {_LABELS} AS y FROM events), s AS (SELECT event_type, avg(y) AS m, stddev_pop(y) + 1e-8 AS s FROM y WHERE isfinite(y) GROUP BY 1)
SELECT event_id, round((y - m) / s, 5) + 0.0 AS z, round((y - m) / s * s + m, 6) AS back FROM y JOIN s USING (event_type) WHERE isfinite(y)
""")
def label_transform(spark, d):
    """Labels standardised by their finite values, deviation + 1e-8, and turned back."""
    m = F.col("event_id") % 11
    y = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).when(m == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    df = table(spark, d, "events").select("event_id", "event_type", y.alias("y"))
    out = X.standardized_labels(df, "y", ["event_type"]).where(S.is_finite(F.col("y")))
    back = S.denormalize(F.col("z"), F.col("label_mean"), F.col("label_std"))
    return out.select("event_id", (F.round("z", 5) + 0.0).alias("z"), F.round(back, 6).alias("back"))


@query("SELECT 'absent.parquet' AS name, 'missing' AS fault UNION ALL SELECT 'region.parquet', 'size'")
def manifest_check(spark, d):
    files = file_hashes(spark, f"{d}/*.parquet")
    listed = files.select("name", F.when(F.col("name") == "region.parquet", F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha256")
    more = spark.createDataFrame([("absent.parquet", 1, "")], "name string, size long, sha256 string")
    return manifest_faults(listed.unionByName(more), files)


@query()
def circular_counts(spark, d):
    """Environments of radius 0 to 2 of each document's word graphs, in 1024 buckets."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "row_id")
    return Q.counted_graphs(docs, "text", Q.environments_of(2), 1024)


@query()
def four_path_counts(spark, d):
    """Paths of four words along the edges of each document's word graphs, in 1024 buckets."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "row_id")
    return Q.counted_graphs(docs, "text", Q.paths_of(range(3, 4), False), 1024)


@query()
def pattern_path_bits(spark, d):
    """Presence of all paths of up to four edges, in 2048 buckets."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "row_id")
    return Q.counted_graphs(docs, "text", Q.paths_of(range(5), True), 2048, presence=True)


@query("SELECT vec_id AS row_id, len(embedding) AS width, round(embedding[1] + embedding[64], 5) AS ends FROM embeddings")
def block_files(spark, d):
    """Embeddings written as .npy files by tasks and read again by ranges of rows."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("values"))
    folder = f"{shared_root(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    files, _ = stored(write_blocks(rows, folder), "block-files")
    out = read_parts(spark, folder, rows=1000).withColumnRenamed("row_id", "at")
    ids = files.select("file", F.posexplode("ids").alias("at", "row_id"))
    both = out.join(ids, ["file", "at"])
    return both.select("row_id", F.size("values").cast("long").alias("width"), F.round(F.get("values", F.lit(0)) + F.get("values", F.lit(63)), 5).alias("ends"))
