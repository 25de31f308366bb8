"""The pipeline's stages keep what they should, and the numbered queries run."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as P
from plumbline.llm import queries as Q
from test_text import WORD, kept, shingles


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        n.append(docs.count())
    assert n[0] >= n[1] > 0.8 * n[0] and n[1] > n[2] > 0.5 * n[1] and n[3] == n[2]
    last = P.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert last.groupby("sequence_id")["length"].sum().max() <= 1024


def clashing(docs):
    """Columns with names that the stages use inside."""
    return docs.withColumns({c: F.lit(c) for c in ("new", "_toxicity", "kept", "marks", "row_key", "copies")})


def values(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def odd(spark, docs, rows):
    """Documents with nulls, copies, repeated ids and rows, long texts, and columns of clashing names."""
    more = [*rows, rows[0], (None, rows[0][1], *rows[0][2:]), rows[-1], (None, None, *rows[1][2:])]
    return clashing(spark.createDataFrame(more, docs.schema).repartition(3)), more


def test_near_duplicate_stage_keeps_one_row_of_each_class(spark, sf_dir, odd):
    docs, data = odd
    out = P.near_duplicate(spark, docs, sf_dir)
    assert out.columns == docs.columns
    sets, root = [shingles(r[1]) for r in data], list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    want = [r[0] for r, s in zip(data, sets, strict=True) if not s]
    for c in {c for c, s in zip(root, sets, strict=True) if s}:
        ids = [r[0] for r, x in zip(data, root, strict=True) if x == c]
        want.append(min((i for i in ids if i is not None), default=None))
    assert sorted(r["doc_id"] is None or r["doc_id"] for r in out.collect()) == sorted(i is None or i for i in want)
    left = set(values(docs))
    assert all(v in left for v in values(out))


def test_substring_stage_cuts_what_the_plain_version_cuts(spark, sf_dir, odd):
    docs, data = odd
    out = P.substring_dedup(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()]
    plain = lambda d, text: str((d, " ".join(WORD.findall(text or ""))))
    assert sorted(plain(d, t) for d, t, _ in got) == sorted(plain(d, k) for d, _, _, k in kept(data))
    same = {(r[0], r[1], r[4]) for r in data}
    cut = [g for g in got if g not in same]
    assert len(cut) == sum(gone > 0 for _, _, gone, _ in kept(data)) and all(n == len(t) for _, t, n in cut)


def test_toxicity_and_mixing_stages(spark, sf_dir, odd):
    from plumbline.llm import mixing as M
    from plumbline.llm import toxicity as T

    docs, data = odd
    model = T.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {(r["doc_id"], r["text"]) for r in T.score_toxicity(docs.select("doc_id", "text"), model).collect() if not r["_toxicity"]["toxic"]}
    out = P.toxicity(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(str((r[0], r[1])) for r in data if (r[0], r[1]) in clean)
    mixed = P.mixing(spark, docs, sf_dir)
    told = M.mix_sources(docs, M.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
    assert mixed.columns == docs.columns and mixed.count() == sum(t["copies"] for t in told) and max(t["copies"] for t in told) <= 3


def test_stages_take_an_empty_table(spark, sf_dir, empty):
    for name, stage in P.STAGES:
        out = stage(spark, clashing(empty), sf_dir)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == clashing(empty).columns


def test_numbered_queries_have_rows(spark, sf_dir):
    assert [k.split("_")[0] for k in sorted(Q.QUERIES, key=lambda k: int(k[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    for name in ("op3_audio", "op10_warc"):
        assert Q.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    a, b = Q.QUERIES[name](spark, sf_dir).toPandas(), con.sql(Q.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else v
    a, b = (sorted((tuple(map(plain, r)) for r in x[cols].itertuples(index=False)), key=repr) for x in (a, b))
    assert a == b
