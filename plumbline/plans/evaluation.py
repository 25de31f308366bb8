"""Queries: metrics, evaluation statistics, selection, folds, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evalstats as E
from ..operators import features as X
from ..operators import folds as K
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import search as H
from ..operators import select as L
from ..sources.tables import table
from .base import query


def scored(spark, d):
    """(task, y, score): three coordinates as tasks, rounded to one decimal so that scores tie."""
    e = table(spark, d, "embeddings")
    pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("task"), F.round(F.get("embedding", F.lit(i)).cast("double"), 1).alias("score")) for i in range(3)]))
    return e.select((F.col("label") >= 5).cast("int").alias("y"), "vec_id", pairs)


_S = "WITH s AS (SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y, unnest([0, 1, 2]) AS task, round(CAST(unnest(embedding[1:3]) AS DOUBLE), 1) AS score FROM embeddings)"


@query(f"{_S} SELECT task, round(avg(CASE WHEN CAST(score > 0.5 AS INTEGER) = y THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM s GROUP BY task")
def metric_accuracy(spark, d):
    return M.accuracy(scored(spark, d), ["task"]).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""{_S}, r AS (SELECT *, (rank() OVER w + count(*) OVER w) / 2.0::DOUBLE AS r FROM s WINDOW w AS (PARTITION BY task ORDER BY score))
SELECT task, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) AS auroc FROM r GROUP BY task""")
def metric_auroc(spark, d):
    return M.auroc(scored(spark, d), ["task"]).withColumn("auroc", F.round("auroc", 9))


@query(f"""{_S}, g AS (SELECT task, score, sum(y)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2),
c AS (SELECT task, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY task) AS p FROM g WINDOW w AS (PARTITION BY task ORDER BY score DESC))
SELECT task, round(sum(tp / p * ctp / cn), 9) AS average_precision FROM c GROUP BY task""")
def metric_average_precision(spark, d):
    return M.average_precision(scored(spark, d), ["task"]).withColumn("average_precision", F.round("average_precision", 9))


@query("SELECT l_returnflag, round(avg(abs(l_quantity * 1000 - l_extendedprice)), 4) AS mae, round(sqrt(avg((l_quantity * 1000 - l_extendedprice) * (l_quantity * 1000 - l_extendedprice))), 4) AS rmse FROM lineitem GROUP BY 1")
def metric_mae_rmse(spark, d):
    df = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1000).alias("score"), F.col("l_extendedprice").alias("y"))
    return M.mae_rmse(df, ["l_returnflag"]).select("l_returnflag", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("""
WITH r AS (SELECT l_returnflag, (rank() OVER a + count(*) OVER a) / 2.0::DOUBLE AS ra, (rank() OVER b + count(*) OVER b) / 2.0::DOUBLE AS rb FROM lineitem
WINDOW a AS (PARTITION BY l_returnflag ORDER BY l_quantity), b AS (PARTITION BY l_returnflag ORDER BY l_extendedprice))
SELECT l_returnflag, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY 1
""")
def metric_spearman(spark, d):
    df = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y"), F.col("l_extendedprice").alias("score"))
    return M.spearman(df, ["l_returnflag"]).withColumn("spearman", F.round("spearman", 6))


@query("WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) SELECT label, n, round(1.0::DOUBLE / n * count(*) OVER () / sum(1.0::DOUBLE / n) OVER (), 9) AS weight FROM c")
def class_weights(spark, d):
    return M.class_weights(table(spark, d, "labels"), "toxic").withColumn("weight", F.round("weight", 9))


_D = "SELECT lang, toxic FROM documents JOIN labels USING (doc_id)"


@query(f"SELECT lang, round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS positive, round(2 * abs(0.5 - avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END)), 9) AS imbalance FROM ({_D}) GROUP BY 1")
def task_context(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return M.task_context(df, ["lang"], "toxic").select("lang", F.round("positive", 9).alias("positive"), F.round("imbalance", 9).alias("imbalance"))


@query(f"""
SELECT lang, metric, CASE WHEN metric IN ('AUROC', 'AUPRC') THEN 1.0::DOUBLE ELSE 0 END AS classification, CASE WHEN metric = 'AUPRC' THEN 1.0::DOUBLE ELSE 0 END AS precision_metric,
       CASE WHEN metric IN ('AUROC', 'AUPRC') THEN round(2 * abs(0.5 - p), 9) ELSE 0 END AS imbalance
FROM (SELECT lang, avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM ({_D}) GROUP BY 1), (SELECT unnest(['AUROC', 'AUPRC', 'MAE']) AS metric)
""")
def task_context_vector(spark, d):
    """The context of each task under each metric: is it classification, is it average precision, and the imbalance."""
    df = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    each = M.task_context(df, ["lang"], "toxic").withColumn("metric", F.explode(F.array(*map(F.lit, ["AUROC", "AUPRC", "MAE"]))))
    flags = M.context_vector(F.col("metric"), F.col("imbalance"))
    return each.select("lang", "metric", *[F.round(v, 9).alias(k) for k, v in flags.items()])


@query(f"SELECT lang, round(greatest(1.0::DOUBLE, count(*) FILTER (WHERE toxic = 0) / greatest(count(*) FILTER (WHERE toxic = 1), 1)::DOUBLE), 9) AS scale_pos_weight FROM ({_D}) GROUP BY 1")
def scale_pos_weight(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return M.positive_weight(df, ["lang"], "toxic").withColumn("scale_pos_weight", F.round("scale_pos_weight", 9))


@query("""
SELECT task, bool_and(abs(y - round_even(y, 0)) < 1e-8 AND round_even(y, 0) IN (0, 1)) AS classification
FROM (SELECT event_type AS task, CASE WHEN event_type = 'click' THEN CAST(event_id % 2 AS DOUBLE) ELSE value END AS y FROM events) GROUP BY 1
""")
def task_type_inference(spark, d):
    y = F.when(F.col("event_type") == "click", (F.col("event_id") % 2).cast("double")).otherwise(F.col("value"))
    return M.is_classification(table(spark, d, "events").select(F.col("event_type").alias("task"), y.alias("y")), ["task"], "y")


def matrix(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"), F.col("embedding").alias("values"))


_L = "WITH l AS (SELECT label AS y, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS idx FROM embeddings)"


@query(f"{_L} SELECT CAST(idx AS INTEGER) AS idx, round(var_pop(x), 9) AS variance FROM l GROUP BY idx HAVING var_pop(x) > 1e-12")
def variance_filter(spark, d):
    return L.variances(matrix(spark, d)).withColumn("variance", F.round("variance", 9))


@query(f"""{_L}, c AS (SELECT idx, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2),
f AS (SELECT idx, sum(n * (m - g) * (m - g)) / (max(k) - 1) / (sum(n * v) / (max(t) - max(k))) AS score FROM (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS g, count(*) OVER w AS k, sum(n) OVER w AS t FROM c WINDOW w AS (PARTITION BY idx)) GROUP BY idx)
SELECT CAST(idx AS INTEGER) AS idx, round(score, 5) AS score FROM f ORDER BY score DESC, idx DESC LIMIT 8""")
def anova_topk(spark, d):
    scores = L.anova_f(matrix(spark, d))
    top = L.top_features(scores, L.variances(matrix(spark, d)), 8)
    return scores.join(top, "idx").select("idx", F.round("score", 5).alias("score"))


@query(f"""{_L}, r AS (SELECT idx, corr(x, y) AS r, count(*) AS n FROM l GROUP BY 1)
SELECT CAST(idx AS INTEGER) AS idx, round(r * r * (n - 2) / (1 - r * r), 5) AS score FROM r ORDER BY r * r * (n - 2) / (1 - r * r) DESC, idx DESC LIMIT 8""")
def regression_topk(spark, d):
    scores = L.regression_f(matrix(spark, d))
    top = L.top_features(scores, L.variances(matrix(spark, d)), 8)
    return scores.join(top, "idx").select("idx", F.round("score", 5).alias("score"))


_U = "(CAST(('0x' || substr(md5('0|' || CAST(grp AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query(f"""
WITH g AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT grp, n, row_number() OVER (PARTITION BY CAST(floor(log2(n)) AS BIGINT) ORDER BY n DESC, {_U}, grp) - 1 AS pos FROM g)
SELECT grp, n, CAST(CASE WHEN pos % 10 < 5 THEN pos % 10 ELSE 9 - pos % 10 END AS INTEGER) AS fold FROM r
""")
def group_folds(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "row_id")
    return K.snake_folds(rows, "o_custkey", 5)


@query(f"SELECT grp, n, CAST(floor({_U} * 5) AS INTEGER) AS fold FROM (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1)")
def hashed_group_folds(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "row_id")
    return K.hashed_folds(rows, "o_custkey", 5)


@query(f"""
WITH RECURSIVE g AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1),
o AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, u, grp) AS pos FROM (SELECT grp, n, {_U} AS u FROM g)),
d AS (SELECT 0::BIGINT AS pos, NULL::BIGINT AS grp, 0::BIGINT AS n, -1::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
      UNION ALL
      SELECT pos, grp, n, slot - 1, list_transform(loads, lambda x, i: CASE WHEN i = slot THEN x + n ELSE x END)
      FROM (SELECT o.pos, o.grp, o.n, d.loads, list_position(d.loads, list_min(d.loads)) AS slot FROM d JOIN o ON o.pos = d.pos + 1))
SELECT grp, n, CAST(fold AS INTEGER) AS fold FROM d WHERE pos > 0
""")
def greedy_group_folds(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "row_id")
    return K.greedy_folds(rows, "o_custkey", 5)


@query(f"""
WITH a AS (SELECT grp, CAST(floor({_U} * 5) AS INTEGER) AS fold FROM (SELECT DISTINCT o_custkey AS grp FROM orders))
SELECT fold, count(*) AS held_out, (SELECT count(*) FROM orders) - count(*) AS train, round(avg(o_totalprice), 4) AS mean FROM orders JOIN a ON o_custkey = grp GROUP BY fold
""")
def fold_masks(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "row_id")
    folded = K.with_folds(rows, "o_custkey", K.hashed_folds(rows, "o_custkey", 5))
    out = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("held_out"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    every = F.sum("held_out").over(Window.partitionBy(F.lit(1)))  # a row for each fold
    return out.select("fold", "held_out", (every - F.col("held_out")).alias("train"), "mean")


@query("""
WITH r AS (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
b AS (SELECT *, max(score) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
i AS (SELECT *, prev IS NULL OR score > prev AS improved FROM b),
s AS (SELECT *, pos - max(CASE WHEN improved THEN pos END) OVER (PARTITION BY conv_id ORDER BY pos) AS stale, max(score) OVER (PARTITION BY conv_id ORDER BY pos) AS best FROM i)
SELECT conv_id, CAST(pos AS INTEGER) AS pos, CAST(score AS INTEGER) AS score, CAST(best AS INTEGER) AS best, improved, stale FROM
(SELECT *, coalesce(max(stale) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM s) WHERE over_ < 2
""")
def best_so_far_patience(spark, d):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, d, "conversations").select("conv_id", pos.alias("pos"), F.length("text").alias("score"))
    kept = E.stopped(E.best_so_far(rows, ["conv_id"], "pos", "score"), ["conv_id"], "pos", 2)
    return kept.select("conv_id", "pos", "score", "best", "improved", "stale")


_RUNS = "WITH r AS (SELECT event_type AS arm, user_id % 20 AS task, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS seed, avg(value) AS score FROM events GROUP BY 1, 2, 3)"


def runs(spark, d):
    df = table(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 20).alias("task"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("seed"), "value")
    return df.groupBy("arm", "task", "seed").agg(F.avg("value").alias("score"))


@query(f"{_RUNS} SELECT arm, task, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, count(*) AS runs FROM r GROUP BY 1, 2")
def run_mean_popsd(spark, d):
    return E.run_mean_sd(runs(spark, d), ["arm", "task"]).select("arm", "task", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "runs")


@query(f"""{_RUNS}, m AS (SELECT arm, task, round(avg(score), 6) AS mean FROM r GROUP BY 1, 2),
k AS (SELECT arm, (rank() OVER w + count(*) OVER w) / 2.0::DOUBLE AS r FROM m WINDOW w AS (PARTITION BY task ORDER BY mean DESC))
SELECT arm, round(avg(r), 6) AS mean_rank, count(*) AS tasks FROM k GROUP BY 1""")
def mean_method_rank(spark, d):
    means = E.run_mean_sd(runs(spark, d), ["arm", "task"]).withColumn("mean", F.round("mean", 6))
    return E.mean_method_rank(means, "task", "arm", "mean").withColumn("mean_rank", F.round("mean_rank", 6))


@query(f"""{_RUNS} SELECT task, round(avg(CASE WHEN arm = 'click' THEN score END), 6) AS click, round(avg(CASE WHEN arm = 'view' THEN score END), 6) AS view FROM r GROUP BY task""")
def method_pivot(spark, d):
    wide = runs(spark, d).groupBy("task").pivot("arm", ["click", "view"]).agg(F.avg("score"))
    return wide.select("task", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@query("""
WITH m AS (SELECT c_mktsegment AS arm, c_nationkey AS task, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2), f AS (SELECT task, v AS ref FROM m WHERE arm = 'BUILDING')
SELECT arm, task, round(CASE WHEN task % 2 = 0 THEN -100 * (v - ref) / ref ELSE 100 * (v - ref) / ref END, 5) + 0.0 AS change,
       CASE WHEN abs(v - ref) <= 1e-9 THEN 'tie' WHEN v > ref THEN 'better' ELSE 'worse' END AS verdict FROM m JOIN f USING (task)
""")
def ablation_delta(spark, d):
    m = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("arm"), F.col("c_nationkey").alias("task")).agg(F.avg("c_acctbal").alias("v"))
    ref = m.where("arm = 'BUILDING'").select("task", F.col("v").alias("ref"))
    change = E.relative_change(F.col("v"), F.col("ref"), F.col("task") % 2 == 0)
    return m.join(ref, "task").select("arm", "task", (F.round(change, 5) + 0.0).alias("change"), E.verdict(F.col("v") - F.col("ref")).alias("verdict"))


@query("SELECT lang, count(*) AS n, count(DISTINCT text) AS distinct_texts, round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE WHEN toxic = 0 THEN 0 END), 9) AS prevalence, min(n_chars) AS least, max(n_chars) AS most FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def dataset_profile(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.xxhash64("text")).alias("distinct_texts"), F.round(F.avg(F.col("toxic").cast("double")), 9).alias("prevalence"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""
SELECT family, bin, count(*) AS n, count(DISTINCT p_brand) AS clusters, count(*) FILTER (WHERE p_retailprice > 1200) AS pos, round(avg(CASE WHEN p_retailprice > 1200 THEN 1.0::DOUBLE ELSE 0 END), 9) AS prevalence
FROM (SELECT *, unnest(['size', 'price', 'name']) AS family, unnest([CASE WHEN p_size < 25 THEN 'low' ELSE 'high' END, CASE WHEN p_retailprice < 1500 THEN 'low' ELSE 'high' END, CASE WHEN length(p_name) < 12 THEN 'low' ELSE 'high' END]) AS bin FROM part) GROUP BY 1, 2
""")
def subgroup_profile(spark, d):
    bin_ = lambda c: F.when(c, "low").otherwise("high")
    families = {"size": F.col("p_size") < 25, "price": F.col("p_retailprice") < 1500, "name": F.length("p_name") < 12}
    long = table(spark, d, "part").select("p_brand", (F.col("p_retailprice") > 1200).alias("pos"), F.inline(F.array(*[F.struct(F.lit(k).alias("family"), bin_(c).alias("bin")) for k, c in families.items()])))
    return long.groupBy("family", "bin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("clusters"), F.sum(F.col("pos").cast("long")).alias("pos"), F.round(F.avg(F.col("pos").cast("double")), 9).alias("prevalence"))


@query("""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS k FROM benchmark),
s AS (SELECT lower(unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS k FROM documents)
SELECT count(*) AS rows, count(DISTINCT s.k) AS keys, count(w.k) AS rows_shared, count(DISTINCT w.k) AS keys_shared FROM s LEFT JOIN w ON s.k = w.k
""")
def overlap_audit(spark, d):
    each = lambda t: table(spark, d, t).select(F.explode(X.words(F.col("text"))).alias("k"))
    return E.overlap_audit(each("documents"), each("benchmark"), "k")


@query("""
WITH s AS (SELECT event_type, user_id AS c, sum(value) AS s, count(value) AS n FROM events GROUP BY 1, 2),
u AS (SELECT *, CAST(('0x' || substr(md5(CAST(b AS VARCHAR) || '|' || CAST(c AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM s CROSS JOIN range(2000) r(b)),
m AS (SELECT event_type, b, sum(s * t) / sum(n * t) AS m FROM (SELECT *, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]::DOUBLE[], lambda x: u >= x)) AS t FROM u) GROUP BY 1, 2)
SELECT event_type, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high
FROM m JOIN (SELECT event_type, sum(s) / sum(n) AS mean FROM s GROUP BY 1) USING (event_type) GROUP BY event_type, mean
""")
def cluster_bootstrap_interval(spark, d):
    out = E.cluster_bootstrap(table(spark, d, "events"), ["event_type"], "user_id", "value", 2000)
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(f"""
WITH e AS (SELECT event_type, user_id AS c, abs(value - floor(value)) - abs(value - floor(value + 0.5)) AS d FROM events),
s AS (SELECT event_type, c, sum(d) AS s, count(d) AS n FROM e WHERE d IS NOT NULL GROUP BY 1, 2),
u AS (SELECT *, CAST(('0x' || substr(md5(CAST(b AS VARCHAR) || '|' || CAST(c AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM s CROSS JOIN range(2000) r(b)),
m AS (SELECT event_type, b, sum(s * t) / sum(n * t) AS m FROM (SELECT *, len(list_filter({E.POISSON}::DOUBLE[], lambda x: u >= x)) AS t FROM u) GROUP BY 1, 2)
SELECT event_type, round(delta, 6) AS delta, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high,
CASE WHEN quantile_cont(m, 0.025) > 0 THEN 'reference' WHEN quantile_cont(m, 0.975) < 0 THEN 'comparator' ELSE 'neither' END AS favours
FROM m JOIN (SELECT event_type, sum(s) / sum(n) AS delta FROM s GROUP BY 1) USING (event_type) GROUP BY event_type, delta
""")
def paired_bootstrap_interval(spark, d):
    """Errors of two roundings of each event's value, by the same resampled users."""
    v = F.col("value")
    arms = table(spark, d, "events").select("event_type", "user_id", F.abs(v - F.floor(v + 0.5)).alias("nearest"), F.abs(v - F.floor(v)).alias("down"))
    out = E.paired_bootstrap(arms, ["event_type"], "user_id", "nearest", "down", lower_is_better=True)
    return out.select("event_type", F.round("delta", 6).alias("delta"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "favours")


@query(f"""{_RUNS}, m AS (SELECT arm, task, avg(score) AS v FROM r GROUP BY 1, 2)
SELECT task, round(a.v - b.v, 6) AS difference, CASE WHEN abs(a.v - b.v) <= 1e-9 THEN 'tie' WHEN a.v > b.v THEN 'better' ELSE 'worse' END AS verdict FROM m a JOIN m b USING (task) WHERE a.arm = 'click' AND b.arm = 'view'""")
def paired_comparison(spark, d):
    m = E.run_mean_sd(runs(spark, d), ["arm", "task"]).select("arm", "task", F.col("mean").alias("v"))
    both = m.where("arm = 'click'").join(m.where("arm = 'view'").select("task", F.col("v").alias("w")), "task")
    diff = F.col("v") - F.col("w")
    return both.select("task", F.round(diff, 6).alias("difference"), E.verdict(diff).alias("verdict"))


@query("""
WITH h AS (SELECT event_type AS study, user_id AS arm, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS epoch, value AS metric FROM events),
b AS (SELECT study, arm, max(metric) AS best, max(CASE WHEN epoch <= 1 THEN metric END) AS b1, max(CASE WHEN epoch <= 2 THEN metric END) AS b2, max(CASE WHEN epoch <= 4 THEN metric END) AS b4 FROM h GROUP BY 1, 2),
r1 AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY b1 DESC NULLS LAST, arm) <= ceil(count(*) OVER (PARTITION BY study) / 2.0) AS k1 FROM b),
r2 AS (SELECT *, k1 AND row_number() OVER (PARTITION BY study, k1 ORDER BY b2 DESC NULLS LAST, arm) <= ceil(count(*) OVER (PARTITION BY study, k1) / 2.0) AS k2 FROM r1),
r4 AS (SELECT *, k2 AND row_number() OVER (PARTITION BY study, k2 ORDER BY b4 DESC NULLS LAST, arm) <= ceil(count(*) OVER (PARTITION BY study, k2) / 2.0) AS k4 FROM r2)
SELECT study, arm, best, CAST(CASE WHEN NOT k1 THEN 1 WHEN NOT k2 THEN 2 WHEN NOT k4 THEN 4 ELSE 0 END AS INTEGER) AS stopped FROM r4
""")
def halved_arms(spark, d):
    """Users as arms of a study for each event type, their values as the metric of their epochs; 0 where none is given up."""
    epoch = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select(F.col("event_type").alias("study"), F.col("user_id").alias("arm"), epoch.alias("epoch"), F.col("value").alias("metric"))
    return H.halved(rows, [1, 2, 4]).withColumn("stopped", F.coalesce("stopped", F.lit(0)))


def _paired(spark, d):
    e = table(spark, d, "embeddings")
    arms = F.inline(F.array(*[F.struct(F.lit(i).alias("task"), F.round(F.get("embedding", F.lit(i)).cast("double"), 2).alias("ref"), F.round(F.get("embedding", F.lit(i + 3)).cast("double"), 2).alias("cmp")) for i in range(3)]))
    return e.select((F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 53).alias("user"), arms)


@query()
def paired_auroc_interval(spark, d):
    """AUROC of two coordinates as scores on the same rows, by the same 2000 resamples of users."""
    return I.paired_metric_interval(_paired(spark, d), ["task"], "user", "ref", "cmp", "auroc")


@query()
def paired_precision_interval(spark, d):
    return I.paired_metric_interval(_paired(spark, d), ["task"], "user", "ref", "cmp", "average_precision")
