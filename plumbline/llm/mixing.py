"""Operator 9 [native]: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target of words by its weight, at most ``max_epochs`` times its size; what a full source cannot take
is shared among the others by weight until none is above. A target of e whole epochs and a rest takes every document e
times; the rest goes to the documents with the smallest exponential keys -ln(u) / quality of the source, u a hash of doc_id and
text, as long as the running sum of sizes, up to the middle of the document, stays within it.

The running sum needs no task that sees a whole source: keys fall into ``buckets`` ranges, (source, bucket) sums give
what lies before each bucket, and only within a bucket are rows sorted. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import whole_row, written

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
EPOCHS = 3


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1] from the first 52 bits of an MD5 of seed, id and the text's MD5; a null id counts as the word null.

    Rows that share an id, or have none, draw apart unless their texts are equal.
    """
    own = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, max_epochs: int = EPOCHS, cycle: int = 3) -> DataFrame:
    """From (source, source_size), a row for each source, adds target and epochs.

    Sources in code point order, null last, weigh 1 .. cycle, repeating. The shares come from one sort by
    cap / weight: the first level that its own source's cap allows holds for all later ones. One row per source meets in
    one task here, never documents.
    """
    named = sizes.withColumn("w", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("double"))
    named = named.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    every, order = Window.partitionBy(F.lit(1)), [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    line = Window.partitionBy(F.lit(1)).orderBy(*order)
    full = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = named.withColumn("level", (F.sum("source_size").over(every) - full) / rest)
    # levels rise until the first that fits and are never below it before, so the least fitting level is that one
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))
    out = levels.withColumn("level", F.min(fits).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.lit(0.0)))
    out = out.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.select("source", "source_size", "target", epochs.alias("epochs"))


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """(doc_id, quality_weight): a document's best label decides; null ids and labels are left out."""
    best = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") > 0, F.lit(good)).otherwise(F.lit(bad)).alias("quality_weight"))


def row_key() -> Column:
    """A hash of doc_id, source and text, by which a mixed row finds its document again."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def mixed_documents(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns. Equal rows are taken alike."""
    copies = mix_sources(docs, weights).groupBy("rid").agg(F.max("copies").alias("copies")).where("copies > 0")
    row = docs.select(whole_row(docs.columns).alias("row"), row_key().alias("rid"))
    times = row.join(copies, "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i"))
    return times.select("row.*")


def mix_sources(docs: DataFrame, weights: DataFrame, buckets: int = 4096, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken and rid, a hash of doc_id, source and text.

    ``weights`` (doc_id, quality_weight), at most one row per doc_id, positive; missing ones count as 1. A null or empty
    text has size 0 and takes 0. Null sources form a source of their own. Rows draw by doc_id and text; ties go by doc_id,
    size and ``rid``, so that only equal rows tie. Other columns are not read. An empty table gives an empty table.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row_key().alias("rid"), uniform(F.col("doc_id").cast("long"), F.col("text"), seed).alias("u"))
    drawn = sized.join(weights, "doc_id", "left").withColumn("key", -F.log("u") / F.coalesce("quality_weight", F.lit(1.0)))
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("int")
    rows, _ = written(drawn.select("doc_id", "source", "size", "rid", "key", bucket.alias("bucket")), "mix-keys")

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("source", "bucket", before.alias("before"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    known = starts.alias("a").join(targets.alias("t"), F.expr("a.source <=> t.source")).select("a.source", "a.bucket", "a.before", "t.source_size", "t.target", "t.epochs")

    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    both = ranked.alias("r").join(known.alias("k"), F.expr("r.source <=> k.source AND r.bucket = k.bucket"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("before") + F.col("within") + F.col("size") / 2 <= rest).cast("long")
    copies = F.least(F.col("epochs") + more, F.lit(EPOCHS))  # a text without words fits even where nothing is left
    return both.select("r.doc_id", "r.source", "r.size", "k.source_size", "k.target", copies.alias("copies"), (F.col("r.size") * copies).alias("taken"), "r.rid")


ORACLE = rf"""
WITH sized AS (
  SELECT d.doc_id, d.source, md5(coalesce(d.text, '')) AS tm, CAST(coalesce(len(regexp_extract_all(d.text, '{WORD}')), 0) AS BIGINT) AS size,
         CASE WHEN l.q IS NULL THEN 1.0 WHEN l.q > 0 THEN 2.0 ELSE 0.5 END AS qw
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l ON d.doc_id = l.doc_id
), drawn AS (
  SELECT *, -ln((CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || tm), 1, 13)) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE) / qw AS k FROM sized
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM drawn GROUP BY source
), s1 AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s0
), s2 AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s1
), s3 AS (
  SELECT source, source_size, least(cap, w * (SELECT lvl FROM s2 WHERE lvl <= cap / w ORDER BY cap / w, lvl LIMIT 1)) AS target FROM s2
), s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s3
), ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM drawn
)
SELECT r.doc_id, r.size, s.source_size, round(s.target, 6) AS target,
       CAST(r.size * (s.epochs + CASE WHEN r.bef + r.size / 2.0 <= s.target - s.epochs * s.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked r JOIN s4 s ON r.source IS NOT DISTINCT FROM s.source
"""
