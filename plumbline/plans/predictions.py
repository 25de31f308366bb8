"""Queries: guards, scans, blocks, ranks, blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blend as B
from ..operators import guards as G
from ..operators import ranks as R
from ..sources.tables import lookup_one, split_union, table
from .base import query

E64 = "[CAST(x AS DOUBLE) FOR x IN embedding]"


def components(spark: SparkSession, d: str, **more: str) -> DataFrame:
    """Coordinates of the embeddings as component scores of the task ``label``."""
    return B.wide_to_long(table(spark, d, "embeddings"), more, ["label", "vec_id"]).withColumnRenamed("vec_id", "row_id")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity >= 10 AND isfinite(l_extendedprice)
""")
def scan_filter_finite(spark, d):
    df = table(spark, d, "lineitem").where((F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")) & (F.col("l_quantity") >= 10))
    return df.where(S.is_finite(F.col("l_extendedprice"))).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT doc_id AS row_id FROM documents WHERE NOT coalesce(length(text) >= 200, false)")
def invalid_row_report(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("doc_id", "row_id")
    return G.invalid_rows(rows, F.length("text") >= 200)


@query("""
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (WHERE b.k IS NULL) AS left_only,
       count(*) FILTER (WHERE a.k IS NULL) AS right_only, count(*) FILTER (WHERE coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1) AS repeated
FROM (SELECT doc_id AS k, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id AS k, count(*) AS n FROM labels GROUP BY 1) b ON a.k = b.k
""")
def alignment_check(spark, d):
    return G.alignment(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT CAST(min(len(embedding)) AS INTEGER) AS least, CAST(max(len(embedding)) AS INTEGER) AS most FROM embeddings")
def width_check(spark, d):
    return G.widths(table(spark, d, "embeddings"), "embedding")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7")
def registry_lookup(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lookup_one(both, n_nationkey=7).select("n_nationkey", "n_name", "r_name")


RULES = {"1-URGENT": 0.5, "2-HIGH": 0.3, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.1, "5-LOW": 0.05}


@query("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice * w), 2) AS weighted
FROM orders JOIN (VALUES ('1-URGENT', 0.5::DOUBLE), ('2-HIGH', 0.3), ('3-MEDIUM', 0.2), ('4-NOT SPECIFIED', 0.1), ('5-LOW', 0.05)) r(p, w) ON o_orderpriority = p
GROUP BY o_orderstatus
""")
def rule_broadcast_join(spark, d):
    rules = F.broadcast(spark.createDataFrame(list(RULES.items()), "o_orderpriority string, w double"))
    df = table(spark, d, "orders").join(rules, "o_orderpriority")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice") * F.col("w")), 2).alias("weighted"))


@query("""
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1
""")
def json_config_extract(spark, d):
    df = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""
SELECT vec_id, CAST(len(b) AS INTEGER) AS width, CAST(b[1] AS DOUBLE) AS first, CAST(b[64] AS DOUBLE) AS last, round(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE))), 6) AS total
FROM (SELECT vec_id, list_concat(list_concat(embedding[49:64], embedding[1:32]), embedding[33:48]) AS b FROM embeddings)
""")
def block_slice_concat(spark, d):
    e = F.col("embedding")
    b = F.concat(S.block(e, 49, 16), S.block(e, 1, 32), S.block(e, 33, 16))
    df = table(spark, d, "embeddings").select("vec_id", b.alias("b"))
    return df.select("vec_id", F.size("b").alias("width"), F.get("b", F.lit(0)).cast("double").alias("first"), F.get("b", F.lit(63)).cast("double").alias("last"), F.round(S.array_sum(F.col("b")), 6).alias("total"))


@query("""
SELECT vec_id, CAST(len(m) AS INTEGER) AS width, round(list_sum(list_transform(m, lambda x: CAST(x AS DOUBLE))), 6) AS total
FROM (SELECT vec_id, list_concat(list_concat(embedding[1:32], list_transform(range(16), lambda i: 0.0::FLOAT)), embedding[49:64]) AS m FROM embeddings)
""")
def modality_mask(spark, d):
    e = F.col("embedding")
    m = F.concat(S.masked(S.block(e, 1, 32), True, 32), S.masked(S.block(e, 33, 16), False, 16), S.masked(S.block(e, 49, 16), True, 16))
    return table(spark, d, "embeddings").select("vec_id", F.size(m).alias("width"), F.round(S.array_sum(m), 6).alias("total"))


@query("SELECT vec_id, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[1] AS DOUBLE) AS b, CAST(embedding[64] AS DOUBLE) AS c FROM embeddings")
def column_index_projection(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", S.pick(F.col("embedding"), [3, 0, 63]).alias("p"))
    return df.select("vec_id", *[F.get("p", F.lit(i)).cast("double").alias(c) for i, c in enumerate("abc")])


@query("""
SELECT event_id, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE greatest(-1e6, least(1e6, x)) END AS value
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN value * 1e9 ELSE value END AS x FROM events)
""")
def sanitize_clip(spark, d):
    m = F.col("event_id") % 7
    x = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).when(m == 2, F.lit(float("-inf"))).when(m == 3, F.lit(None).cast("double")).when(m == 4, F.col("value") * 1e9).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", S.sanitize(x).alias("value"))


@query("""
SELECT event_type, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf
FROM (SELECT event_type, CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE value END AS x FROM events) GROUP BY 1
""")
def nan_inf_counters(spark, d):
    m = F.col("event_id") % 7
    x = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_type", x.alias("x")).groupBy("event_type").agg(F.count_if(F.isnan("x")).alias("n_nan"), F.count_if(F.abs("x") == float("inf")).alias("n_inf"))


@query("SELECT event_id, (rank() OVER w + count(*) OVER w) / 2.0::DOUBLE AS r FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)")
def avg_rank(spark, d):
    return R.with_ranks(table(spark, d, "events").select("event_id", "event_type", "value"), {"value": "r"}, ["event_type"]).select("event_id", "r")


@query("""
SELECT event_id, round((rank() OVER w + count(*) OVER w) / 2.0::DOUBLE / count(*) OVER (PARTITION BY event_type), 9) AS r
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)
""")
def rank_norm(spark, d):
    ranked = R.with_ranks(table(spark, d, "events").select("event_id", "event_type", "value"), {"value": "r"}, ["event_type"], normalized=True)
    return ranked.select("event_id", F.round("r", 9).alias("r"))


_Z = """
WITH m AS (SELECT *, avg(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus) AS mu FROM lineitem),
s AS (SELECT *, sqrt(avg((l_extendedprice - mu) * (l_extendedprice - mu)) OVER (PARTITION BY l_returnflag, l_linestatus)) AS sd FROM m)
"""


@query(_Z + "SELECT l_orderkey, l_linenumber, round(CASE WHEN sd = 0 THEN 0.0 ELSE (l_extendedprice - mu) / sd END, 6) + 0.0 AS z FROM s")
def zscore_f64(spark, d):
    df = R.zscore64(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return df.select("l_orderkey", "l_linenumber", (F.round("z", 6) + 0.0).alias("z"))


@query(_Z + "SELECT l_orderkey, l_linenumber, round(CAST(CAST(CASE WHEN sd < 1e-12 THEN 0.0 ELSE (l_extendedprice - mu) / sd END AS FLOAT) AS DOUBLE), 4) + 0.0 AS z FROM s")
def zscore_f32(spark, d):
    df = R.zscore32(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return df.select("l_orderkey", "l_linenumber", (F.round(F.col("z").cast("double"), 4) + 0.0).alias("z"))


@query("""
SELECT vec_id, round(ln(q / (1 - q)), 6) AS logit, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 9) AS softplus
FROM (SELECT vec_id, x, greatest(1e-6, least(1 - 1e-6, (x + 1) / 2)) AS q FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 3 AS x FROM embeddings))
""")
def logit_sigmoid_softplus(spark, d):
    x = F.get("embedding", F.lit(0)).cast("double") * 3
    df = table(spark, d, "embeddings").select("vec_id", x.alias("x"))
    return df.select("vec_id", F.round(S.logit((F.col("x") + 1) / 2), 6).alias("logit"), F.round(S.sigmoid(F.col("x")), 9).alias("sigmoid"), F.round(S.softplus(F.col("x")), 9).alias("softplus"))


C3 = {"a": "embedding[0]", "b": "embedding[1]", "c": "embedding[2]"}
W3 = {"a": 0.4, "b": 0.35, "c": 0.25}
_X = "WITH x AS (SELECT label, vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)"


def _ar(c: str, by: str = "label") -> str:
    w = f"(PARTITION BY {by} ORDER BY {c})"
    return f"((rank() OVER {w} + count(*) OVER {w}) / 2.0::DOUBLE)"


@query(f"{_X} SELECT row_id, round(0.4::DOUBLE * a + 0.35::DOUBLE * b + 0.25::DOUBLE * c, 6) AS score FROM x")
def blend_raw(spark, d):
    return B.blend(components(spark, d, **C3), W3, "raw", ("label",)).select("row_id", F.round("score", 6).alias("score"))


@query(f"{_X} SELECT row_id, round(0.4::DOUBLE * {_ar('a')} + 0.35::DOUBLE * {_ar('b')} + 0.25::DOUBLE * {_ar('c')}, 6) AS score FROM x")
def blend_rank(spark, d):
    return B.blend(components(spark, d, **C3), W3, "rank", ("label",)).select("row_id", F.round("score", 6).alias("score"))


_ZX = _X + ", " + ", ".join(f"m{c} AS (SELECT *, avg({c}) OVER (PARTITION BY label) AS mu_{c} FROM {src})" for c, src in (("a", "x"), ("b", "ma"), ("c", "mb"))) + ", z AS (SELECT label, row_id, " + ", ".join(f"({c} - mu_{c}) / sqrt(avg(({c} - mu_{c}) * ({c} - mu_{c})) OVER (PARTITION BY label)) AS z{c}" for c in "abc") + " FROM mc)"


@query(f"{_ZX} SELECT row_id, round(0.5::DOUBLE * za + 0.1::DOUBLE * zb + 0.4::DOUBLE * zc, 4) AS score FROM z")
def blend_zscore(spark, d):
    return B.blend(components(spark, d, **C3), {"a": 0.5, "b": 0.1, "c": 0.4}, "zscore", ("label",)).select("row_id", F.round("score", 4).alias("score"))


@query("""
SELECT vec_id AS row_id, round(1 / (1 + exp(-(0.65::DOUBLE * ln(a / (1 - a)) + 0.25::DOUBLE * ln(b / (1 - b)) + 0.1::DOUBLE * ln(c / (1 - c))))), 6) AS score
FROM (SELECT vec_id, greatest(1e-6, least(1 - 1e-6, (CAST(embedding[1] AS DOUBLE) + 1) / 2)) AS a, greatest(1e-6, least(1 - 1e-6, (CAST(embedding[2] AS DOUBLE) + 1) / 2)) AS b,
             greatest(1e-6, least(1 - 1e-6, (CAST(embedding[3] AS DOUBLE) + 1) / 2)) AS c FROM embeddings)
""")
def blend_logit_sigmoid(spark, d):
    p = {k: f"(cast({e} as double) + 1) / 2" for k, e in C3.items()}
    return B.blend(components(spark, d, **p), {"a": 0.65, "b": 0.25, "c": 0.1}, "logit", ("label",), squash=True).select("row_id", F.round("score", 6).alias("score"))


@query(f"{_X} SELECT row_id, round(({_ar('a')} + {_ar('b')} + {_ar('c')}) / 3 / count(*) OVER (PARTITION BY label), 6) AS score FROM x")
def kernel_rank_mean(spark, d):
    third = 1 / 3
    return B.blend(components(spark, d, **C3), dict.fromkeys(C3, third), "rank_n", ("label",)).select("row_id", F.round("score", 6).alias("score"))


def _seeded(spark, d) -> DataFrame:
    df = table(spark, d, "events")
    return df.select(F.col("event_type").alias("task"), F.col("user_id").alias("row_id"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("seed"), F.col("value").alias("score"))


@query("SELECT event_type AS task, user_id AS row_id, round(avg(value), 6) AS score FROM events GROUP BY 1, 2")
def seedbag_mean(spark, d):
    return B.seed_mean(_seeded(spark, d), ("task",)).select("task", "row_id", F.round("score", 6).alias("score"))


@query("""
SELECT vec_id AS row_id, round(0.7::DOUBLE * (CAST(embedding[1] AS DOUBLE) + embedding[2] + embedding[3] + embedding[4] + embedding[5]) / 5 + 0.3::DOUBLE * embedding[6], 6) AS score FROM embeddings
""")
def raw_seedbag_fp_blend(spark, d):
    df = table(spark, d, "embeddings").withColumnRenamed("vec_id", "row_id")
    heads = df.select("row_id", F.posexplode(S.block(F.col("embedding"), 1, 5)).alias("seed", "score")).withColumn("score", F.col("score").cast("double"))
    bag = B.seed_mean(heads).withColumn("component", F.lit("bag"))
    fp = df.select("row_id", F.get("embedding", F.lit(5)).cast("double").alias("score"), F.lit("fp").alias("component"))
    return B.blend(bag.unionByName(fp), {"bag": 0.7, "fp": 0.3}).select("row_id", F.round("score", 6).alias("score"))


@query("""
WITH x AS (SELECT label, vec_id AS row_id, unnest([0, 1, 2, 3, 4]) AS seed, unnest(embedding[1:5])::DOUBLE AS h, embedding[6]::DOUBLE AS p, embedding[7]::DOUBLE AS q FROM embeddings),
m AS (SELECT *, avg(h) OVER w AS mh, avg(p) OVER w AS mp, avg(q) OVER w AS mq FROM x WINDOW w AS (PARTITION BY label, seed)),
z AS (SELECT *, (h - mh) / sqrt(avg((h - mh) * (h - mh)) OVER w) AS zh, (p - mp) / sqrt(avg((p - mp) * (p - mp)) OVER w) AS zp, (q - mq) / sqrt(avg((q - mq) * (q - mq)) OVER w) AS zq FROM m WINDOW w AS (PARTITION BY label, seed))
SELECT row_id, round(avg(0.8::DOUBLE * zh + 0.1::DOUBLE * zp + 0.1::DOUBLE * zq), 6) AS score FROM z GROUP BY label, row_id
""")
def seedwise_zscore_blend(spark, d):
    df = table(spark, d, "embeddings").withColumnRenamed("vec_id", "row_id")
    heads = df.select("label", "row_id", F.posexplode(S.block(F.col("embedding"), 1, 5)).alias("seed", "h"), F.get("embedding", F.lit(5)).alias("p"), F.get("embedding", F.lit(6)).alias("q"))
    long = B.wide_to_long(heads, {"head": "h", "xl": "p", "side": "q"}, ["label", "row_id", "seed"])
    return B.seedwise_zscore_blend(long, {"head": 0.8, "xl": 0.1, "side": 0.1}, ("label",)).select("row_id", F.round("score", 6).alias("score"))


@query("""
WITH x AS (SELECT label, vec_id AS row_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c, embedding[4]::DOUBLE d, embedding[5]::DOUBLE e, embedding[6]::DOUBLE f, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
s1 AS (SELECT *, (RA / n + RB / n + RC / n) / 3 AS base FROM (SELECT *, %s AS RA, %s AS RB, %s AS RC FROM x)),
s2 AS (SELECT *, round(0.5::DOUBLE * (%s / n) + 0.5::DOUBLE * (%s / n), 12) AS prior FROM (SELECT * REPLACE (round(base, 12) AS base) FROM s1)),
s3 AS (SELECT *, round(0.75::DOUBLE * (%s / n) + 0.25::DOUBLE * (%s / n), 12) AS staged FROM s2)
SELECT row_id, round(0.75::DOUBLE * (%s / n) + 0.25::DOUBLE * (%s / n), 6) AS score FROM s3
""" % tuple(_ar(c) for c in ("a", "b", "c", "base", "d", "prior", "e", "staged", "f")))
def nested_rank_blend(spark, d):
    df = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("row_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("abcdef")])
    stages = [("base", {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}), ("prior", {"base": 0.5, "d": 0.5}), ("staged", {"prior": 0.75, "e": 0.25}), ("out", {"staged": 0.75, "f": 0.25})]
    return B.nested_rank_blend(df, stages, ("label",), digits=12).select("row_id", F.round("score", 6).alias("score"))


@query("""
SELECT split, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM
(SELECT vec_id, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM embeddings) GROUP BY split
""")
def split_union_counts(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    m = F.col("vec_id") % 10
    parts = {"train": e.where(m < 7), "valid": e.where(m == 7), "test": e.where(m > 7)}
    return split_union(parts).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("SELECT label, vec_id, pos FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings) WHERE pos BETWEEN 5 AND 14")
def row_range_slice(spark, d):
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    return table(spark, d, "embeddings").select("label", "vec_id", pos.alias("pos")).where(F.col("pos").between(5, 14))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT event_id, len(list_filter(map_keys(m), lambda x: x NOT IN ('k'))) AS n_unknown FROM (SELECT event_id, json_transform(props, '\"MAP(VARCHAR, INTEGER)\"') AS m FROM events)")
def unknown_key_guard(spark, d):
    m = F.from_json("props", "map<string,int>")
    return table(spark, d, "events").select("event_id", F.size(G.unknown_keys(m, ["k"])).cast("long").alias("n_unknown"))
