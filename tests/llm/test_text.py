"""Similarity join, repeats, language, toxicity and mixing against brute force."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components as C
from plumbline.llm import jaccard as J
from plumbline.llm import langid as L
from plumbline.llm import mixing as M
from plumbline.llm import repeats as R
from plumbline.llm import toxicity as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(rows):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    of = [find(i) for i in range(len(rows))]
    least = defaultdict(list)
    for i, c in enumerate(of):
        if rows[i][0] is not None:
            least[c].append(rows[i][0])
    return sorted(((r[0], len(s), min(least[c]) if least[c] else None) for r, s, c in zip(rows, sets, of, strict=True)), key=str)


@pytest.mark.parametrize("mapped", [J.MAPPED, -1])
def test_near_duplicates(docs, rows, empty, monkeypatch, mapped):
    monkeypatch.setattr(J, "MAPPED", mapped)  # -1: the join for maps that are too large to load
    got = [(g["doc_id"], g["n_shingles"], g["component_id"]) for g in J.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == classes(rows)
    if mapped > 0:
        assert J.near_duplicates(empty).count() == 0


def test_near_copies_about_the_threshold(spark):
    """Copies of one unseen text with a word or two changed: some link, some only resemble each other and form blocks."""
    rng = np.random.default_rng(3)
    base, data = [f"b{i}" for i in range(90)], []
    for i in range(240):
        words = list(base)
        for at in rng.integers(0, 90, rng.integers(1, 5)):
            words[at] = f"x{i}"
        data.append((i, " ".join(words)))
    got = [tuple(g) for g in J.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got, key=str) == classes(data)


@pytest.mark.parametrize("mapped", [J.MAPPED, -1])
def test_texts_that_share_an_id(spark, monkeypatch, mapped):
    """Different texts under one doc_id and under null ids each stay with their own set, in the map and in the join."""
    monkeypatch.setattr(J, "MAPPED", mapped)
    rng = np.random.default_rng(5)
    data = []
    for i in range(360):
        words = [f"b{i % 3}.{j}" for j in range(90)]
        for at in rng.integers(0, 90, rng.integers(1, 5)):
            words[at] = f"x{i}"
        data.append((None if i % 4 == 3 else i // 8, " ".join(words)))
    data += [(None, data[3][1]), (0, data[0][1]), (7, None), (None, ""), (7, "few words")]
    got = [tuple(g) for g in J.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got, key=str) == classes(data)


def test_bucket_counts_never_undercount():
    rng = np.random.default_rng(0)
    for n, m, shared in [(5, 9, 3), (500, 600, 450), (90, 4000, 80)]:
        x = np.unique(rng.integers(0, 1 << 63, n + m).astype(np.uint64))
        a, b = x[:n], x[n - shared : n - shared + m]
        assert J.most_shared(J.bucket_counts(a), J.bucket_counts(b)) >= len(np.intersect1d(a, b))
    assert J.most_shared(J.bucket_counts(x[:600]), J.bucket_counts(x[600:1200])) < 510


@pytest.mark.parametrize("small", [C.SMALL, -1])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)  # -1: the steps for many edges
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(200, i) for i in range(201, 240)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in range(200, 240)}}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept(rows):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    words = [WORD.findall(r[1] or "") for r in order]
    for r, w in zip(order, words, strict=True):
        for j in range(len(w) - 19):
            key = ((r[0] is None, r[0] or 0), j)
            seen[tuple(w[j : j + 20])] = min(seen.get(tuple(w[j : j + 20]), key), key)
    for r, w in zip(order, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if seen[tuple(w[j : j + 20])] < ((r[0] is None, r[0] or 0), j):
                gone[j : j + 20] = [True] * 20
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("loaded", "often"), [(R.LOADED, R.OFTEN), (-1, R.OFTEN), (R.LOADED, 2), (-1, 2)])
def test_without_repeats(docs, rows, empty, monkeypatch, loaded, often):
    monkeypatch.setattr(R, "LOADED", loaded)  # -1: anchors by a join, frequent prefixes all as long as a window
    monkeypatch.setattr(R, "OFTEN", often)  # 2: longer prefixes for nearly all
    monkeypatch.setattr(R, "ROWS", 30)  # many small subtrees
    got = R.without_repeats(docs).collect()
    assert sorted((tuple(g)[:4] for g in got), key=str) == kept(rows)
    assert all(sum(s["to"] - s["from"] for s in g["spans"]) == g["n_removed"] for g in got)
    assert R.without_repeats(empty).count() == 0


def test_windows_whose_words_collide_in_half_their_hash(spark):
    """Two words with the same upper half of their hash are different words, within a task and across tasks."""
    import pyarrow as pa

    from plumbline.llm.words import Words

    seen, pair = {}, None
    for j in range(0, 1_000_000, 50_000):
        words = [f"w{k}" for k in range(j, j + 50_000)]
        for word, h in zip(words, (Words(pa.array([" ".join(words)])).hashes >> np.uint64(32)).tolist(), strict=True):
            pair = pair or ((seen[h], word) if h in seen else None)
            seen[h] = word
        if pair:
            break
    line = [f"c{i}" for i in range(30)]
    data = [(i, " ".join([*line[:12], pair[i % 2], *line[13:]])) for i in range(4)] + [(9, " ".join(line))]
    for parts in (1, 5):
        got = R.without_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((tuple(g)[:4] for g in got), key=str) == kept(data)


def test_subtree_nodes():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2, (400, R.WINDOW)).astype(np.uint64)
    words[:, 6:] = 0
    key, start = rng.integers(0, 5, 400), rng.integers(0, 50, 400)
    first = {}
    for w, k, s in zip(words.tolist(), key.tolist(), start.tolist(), strict=True):
        first[tuple(w)] = min(first.get(tuple(w), (k, s)), (k, s))
    assert R.subtree_repeats(words, key, start).tolist() == [first[tuple(w)] != (k, s) for w, k, s in zip(words.tolist(), key.tolist(), start.tolist(), strict=True)]


def test_mixing(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (3, 0, 0), (6, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = M.mix_sources(docs, M.quality_weights(labels)).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    target, left, free = {}, float(sum(size.values())), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(free)}
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        full = [s for s in free if share[s] > 3 * size[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    taken, largest = defaultdict(int), defaultdict(int)
    for g in got:
        assert g["target"] == pytest.approx(target[g["source"]]) and g["source_size"] == size[g["source"]]
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
        largest[g["source"]] = max(largest[g["source"]], g["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert len(got) == len(rows) and M.mix_sources(empty, M.quality_weights(labels)).count() == 0
    again = M.mix_sources(docs.repartition(5), M.quality_weights(labels))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    copies = M.mixed_documents(docs, M.quality_weights(labels))
    assert copies.columns == docs.columns and copies.count() == sum(g["copies"] for g in got)


def test_fit_ordinal_orders_cuts_and_recovers_signs():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 3)) < 0.4).astype(float)
    z = x @ np.array([2.0, -2.0, 0.0]) + rng.logistic(size=3000)
    y = np.digitize(z, [0.5, 2.0])
    w, cuts = T.fit_ordinal(x, y, np.ones(3000), 3)
    assert cuts[0] < cuts[1] and np.abs(cuts - [0.5, 2.0]).max() < 0.4 and np.abs(w - [2, -2, 0]).max() < 0.4


def test_toxicity(spark, docs, empty):
    bad = ["vile", "awful", "nasty"]
    data = [(i, f"w{i % 7} some Plain text {bad[i % 3] + ', ' + bad[(i + 1) % 3].upper() if i % 4 == 0 else 'here'} w{i % 11}", int(i % 4 == 0)) for i in range(400)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (None, "vile nasty awful")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data[:300]] + [(5, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = T.fit_toxicity(texts, labels, least_df=3)
    got = {r["doc_id"]: r["_toxicity"] for r in T.score_toxicity(texts, model).collect()}
    assert all(got[i]["toxic"] == bool(y) for i, _, y in data) and got[None]["toxic"] and not got[900]["toxic"] and not got[901]["toxic"]
    assert all(0 <= s["expected_severity"] <= 2 for s in got.values())
    none = T.fit_toxicity(texts, labels.where("toxic = 0"))
    assert not any(r["_toxicity"]["toxic"] for r in T.score_toxicity(docs, none).collect())
    assert T.score_toxicity(empty, model).count() == 0 and T.score_toxicity(docs, model).drop("_toxicity").columns == docs.columns


def test_language(spark, sf_dir, docs, empty):
    full = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit_languages(full.where(~L.held_out(F.col("doc_id"))), per_lang=60)
    got = full.where(L.held_out(F.col("doc_id"))).select("lang", L.predict_language(model, F.col("text")).alias("p")).collect()
    assert sum(g["lang"] == g["p"]["lang"] for g in got) / len(got) > 0.95
    odd = spark.createDataFrame([(None,), ("",), ("123 !!",), ("the",)], "text string").select(L.predict_language(model, F.col("text")).alias("p")).collect()
    assert [o["p"]["lang"] == "und" for o in odd] == [True, True, True, False] and odd[0]["p"]["score"] == 0
    nothing = L.fit_languages(full.where("false"))
    assert {r["p"]["lang"] for r in docs.select(L.predict_language(nothing, F.col("text")).alias("p")).collect()} == {"und"}
    assert empty.select(L.predict_language(model, F.col("text"))).count() == 0


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOWER))


def test_severity_is_the_plain_cumulative_link(spark, docs, rows):
    """Scores against sums over the distinct words of each text, one document and one grade at a time."""
    import pyarrow as pa

    from plumbline.llm.words import LETTERS, Words

    vocabulary = ["alpha0", "beta", "délta", "one", "x", "theta", "rho17", "two", "eps"] + [f"gamma{i}" for i in range(40)]
    hashes = {w: int(Words(pa.array([w]), lower=True, gap=LETTERS).hashes[0]) for w in vocabulary}
    weight = {w: (i * 7 % 11 - 5) / 4 for i, w in enumerate(vocabulary)}
    ordered = sorted(vocabulary, key=hashes.get)
    model = T.OrdinalModel(np.array([hashes[w] for w in ordered], np.uint64), np.array([weight[w] for w in ordered]), np.array([0.3, 1.1]))
    want = []
    for r in rows:
        z = sum(weight[w] for w in set(plain_words(r[1])) & weight.keys())
        upto = [0.0, *(1 / (1 + np.exp(-(c - z))) for c in model.cuts), 1.0]
        p = [upto[k + 1] - upto[k] for k in range(3)]
        want.append((r[0], round(p[1] + 2 * p[2], 9), int(np.argmax(p)), round(p[1] + p[2], 9)))
    got = [(r["doc_id"], round(r["s"]["expected_severity"], 9), r["s"]["severity_grade"], round(r["s"]["p_toxic"], 9)) for r in docs.select("doc_id", T.severity(model, F.col("text")).alias("s")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({g[1] for g in got}) > 5


def test_ordinal_fit_is_at_the_top_of_the_plain_likelihood():
    """No small step in any weight or cut makes the likelihood, summed row by row, higher."""
    rng = np.random.default_rng(1)
    x = (rng.random((250, 4)) < 0.5).astype(float)
    y = np.digitize(x @ np.array([1.5, -1.0, 0.5, 0.0]) + rng.logistic(size=250), [0.0, 1.5])
    weight = rng.uniform(0.5, 2, 250)
    w, cuts = T.fit_ordinal(x, y, weight, 3, steps=3000)

    def likelihood(w, cuts):
        edges = [-np.inf, *cuts, np.inf]
        cdf = lambda v: 1 / (1 + np.exp(-v))
        each = [weight[i] * np.log(cdf(edges[y[i] + 1] - x[i] @ w) - cdf(edges[y[i]] - x[i] @ w)) for i in range(len(y))]
        return sum(each) - 0.05 * float(w @ w)

    top = likelihood(w, cuts)
    for k in range(6):
        for step in (-0.03, 0.03):
            moved = np.concatenate([w, cuts])
            moved[k] += step
            assert likelihood(moved[:4], moved[4:]) < top


def plain_grams(text):
    """Counts of hashed 1- to 3-grams of a text's bytes: Latin-1 capitals lowered, all other ASCII but letters one symbol."""
    raw, out = list((text or "").encode()), defaultdict(int)
    lead = [i > 0 and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E for i, b in enumerate(raw)]
    b = [v + 32 if up or 65 <= v <= 90 else 32 if v < 128 and not chr(v).isalpha() else v for v, up in zip(raw, lead, strict=True)]
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            code = 0
            for v in b[i : i + n]:
                code = (code * 0x01000193 + v + 1) % 2**32
            out[(code * 0x9E3779B1 % 2**32) >> 20] += 1
    return out


def test_language_is_the_plain_nearest_centroid(spark, rows):
    """Document frequencies, weights and cosines one n-gram at a time; copies, ties, nulls and long texts as any other."""
    learn = [(i, r[1], "ab"[i % 2]) for i, r in enumerate(rows) if r[1] and len(r[1]) < 1500]
    learn += [(900, learn[0][1], "a"), (901, learn[0][1], "b"), (None, "not learnt from", "a"), (902, "no language", None), (903, "12 34", "a")]
    model = L.fit_languages(spark.createDataFrame(learn, "doc_id long, text string, lang string").repartition(3), per_lang=1000)
    used = [plain_grams(t) for i, t, lang in learn if i is not None and lang and any(map(str.isalpha, t))]
    df = defaultdict(int)
    for g in used:
        for k in g:
            df[k] += 1
    assert np.allclose(model.idf, [np.log((1 + len(used)) / (1 + df[k])) + 1 for k in range(L.DIM)], rtol=1e-5)
    assert set(model.langs) == {"a", "b"} and len(model.langs) > 2 and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    texts = [r[1] for r in rows]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4).select("i", L.predict_language(model, F.col("text")).alias("p")).collect()
    for r in got:
        text, p = texts[r["i"]], r["p"]
        if not text or not any(map(str.isalpha, text)):
            assert tuple(p) == ("und", 0.0, False)
            continue
        v = np.zeros(L.DIM)
        for k, n in plain_grams(text).items():
            v[k] = np.log1p(n) * model.idf[k]
        cos = model.centroids.astype(float) @ v / np.linalg.norm(v)
        near = {model.langs[j] for j in np.flatnonzero(cos > cos.max() - 1e-5)}
        assert p["lang"] in near and p["score"] == pytest.approx(min(1.0, cos.max()), abs=1e-5)
    same = defaultdict(set)
    for r in got:
        same[texts[r["i"]]].add(tuple(r["p"]))
    assert all(len(v) == 1 for v in same.values())
