"""Every registered query against its SQL in DuckDB, and rows for those without SQL."""

import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from plumbline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def value(v):
    if v is None or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return float(v)
    return int(v) if isinstance(v, (int, np.integer)) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(value, r)) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = rows(catalog.QUERIES[name](spark, sf_dir).toPandas()), rows(duck.sql(catalog.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_folds_keep_groups_whole_and_even(spark, sf_dir):
    got = catalog.QUERIES["greedy_group_folds"](spark, sf_dir).toPandas()
    assert got["grp"].is_unique and set(got["fold"]) == set(range(5))
    load = got.groupby("fold")["n"].sum()
    assert load.max() - load.min() <= 8 * got["n"].max()


def test_plateau_rates_fall_only_after_patience(spark):
    from plumbline.operators.sampling import plateau_rates

    df = spark.createDataFrame([(1, i, m) for i, m in enumerate([1.0, 2.0, 2.0, 1.0, 3.0, 0.0, 0.0])], "run long, epoch int, metric double")
    assert plateau_rates(df, 1.0, 0.5, 1).orderBy("epoch").toPandas()["rate"].tolist() == [1, 1, 1, 0.5, 0.5, 0.5, 0.25]


def test_batch_pairs_cover_the_whole_table(spark, duck, sf_dir):
    from plumbline.operators import pairs as P

    label, x = {}, {}
    for i, y, v in duck.sql("SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) FROM embeddings").fetchall():
        label[i], x[i] = int(y >= 5), v
    dealt = []
    for names in (["row_id", "y", "score"], ["row_id", "score"]):
        df = spark.createDataFrame([(i, label[i], x[i]) for i in x], "row_id long, y int, score double").select(*names)
        found = [sorted((r["row_id"], r["_batch"]) for r in P.batches(df.repartition(n), 64, cell_rows).collect()) for n, cell_rows in ((3, 50_000), (7, 50_000), (2, 50))]
        assert found[0] == found[1]
        for rows_ in found:
            assert [i for i, _ in rows_] == sorted(x)
            n = np.bincount([b for _, b in rows_])
            assert (n[:-1] == 64).all() and n[-1] == (len(x) - 1) % 64 + 1
        dealt.append(dict(found[0]))
    got = {(r["pos_id"], r["neg_id"]): r["loss"] for r in catalog.QUERIES["pairwise_margin_batches"](spark, sf_dir).collect()}
    want = {(a, b): np.log1p(np.exp(x[b] - x[a])) for a in x for b in x if label[a] and not label[b] and dealt[0][a] == dealt[0][b]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    got = {r["row_id"]: r["soft_rank"] for r in catalog.QUERIES["soft_rank_batches"](spark, sf_dir).collect()}
    want = {a: 1 + sum(1 / (1 + np.exp(-(x[a] - x[b]) / 0.1)) for b in x if b != a and dealt[1][a] == dealt[1][b]) for a in x}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_presence_shuffles_a_row_for_each_key(spark):
    """Buckets of rows of one key are joined; before the exchange they are bits, not rows of (key, bucket)."""
    from pyspark.sql import functions as F

    from plumbline.functions.scalars import bucket_of
    from plumbline.operators import features as X

    lists = [(1, [f"w{i}" for i in range(700)]), (1, ["a", "a", None]), (2, ["b"]), (2, ["b", "c"]), (3, []), (None, ["d"])]
    df = spark.createDataFrame(lists, "k int, ws array<string>").repartition(3)
    want = {}
    for k, b in df.select("k", F.explode("ws").alias("w")).where("w IS NOT NULL").select("k", bucket_of(F.col("w"), 167)).collect():
        want.setdefault(k, set()).add(b)
    found = X.presence(df, "k", F.col("ws"), 167)
    assert {r["k"]: r["bits"] for r in found.collect()} == {k: sorted(v) for k, v in want.items()}
    dealt = re.findall(r"hashpartitioning\((.*?), \d+", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and all(keys.startswith("k#") and "," not in keys for keys in dealt)


def test_each_pair_of_a_batch_is_looked_at_once(monkeypatch):
    """A term is evaluated n * n times for a batch of n rows, in pieces that give the same losses."""
    from plumbline.operators import pairs as P

    r = np.random.default_rng(4)
    y, s, t = (r.random(300) < 0.4).astype(float), r.normal(size=300), r.normal(size=300)
    whole, seen, sums = P._batch_losses(y, s, t, 0.5, 1.0, (1.0, 2.0)), [], P._sums
    monkeypatch.setattr(P, "PAIRS", 1000)
    monkeypatch.setattr(P, "_sums", lambda a, b, term: sums(a, b, lambda x, z: seen.append(x.size * z.size) or term(x, z)))
    assert np.allclose(P._batch_losses(y, s, t, 0.5, 1.0, (1.0, 2.0)), whole, rtol=0, atol=1e-12)
    assert max(seen) <= 1000 and sum(seen) == 3 * 300 * 300 + int(y.sum() * (1 - y).sum())
    assert P._batch_losses(np.array([1.0]), np.array([2.0]), np.array([0.0]), 0.5, 1.0, (1.0, 1.0))[2:] == (4.0, 4.0)
    assert P._batch_losses(np.array([0.0, 1.0]), np.array([50.0, 0.0]), np.zeros(2), 0.5, 1.0, (1.0, 1.0))[:2] == (None, None)
