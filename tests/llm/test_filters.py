import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm.filters import LETTERS, Trie, document_masks, filter_audit, heavy_prefixes, text_mask

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    """(part, mask) of each (doc_id, text, part), by comparing all texts."""
    out = []
    for i, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        bits = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t))]
        bits.append(i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        out.append((part or "", sum(b << k for k, b in enumerate(bits))))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}  # a null id has no label
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    told = [(p, m, r[0] in good, r[0] in toxic) for r, (p, m) in zip(rows, failures(rows), strict=True)]
    out = {}
    for part in {p for p, *_ in told}:
        own = [x for x in told if x[0] == part]
        shapley = Counter()
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                failing = [x for x in left if x[1] >> f & 1]
                shapley[f] += len(failing)
                left = [x for x in left if not x[1] >> f & 1]
                redundant = sum(x[1] >> f & 1 for x in own) - len(failing)
                out[part, "".join(LETTERS[x] for x in order), step] = [len(left), len(failing), redundant, sum(x[1] == 1 << f for x in own), sum(x[2] for x in failing), sum(x[3] for x in failing), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


LABELS = [(i * 3, i % 2, i % 5 == 0) for i in range(60)] + [(0, 1, True), (0, None, None), (None, 1, True), (9999, 1, True)]


def label_table(spark):
    return spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in LABELS], "doc_id long, quality int, toxic int")


def test_audit_equals_plain_version(spark, docs, rows):
    want = plain_audit([(r[0], r[1], r[2]) for r in rows], LABELS)
    got = audited(filter_audit(docs, label_table(spark)))
    assert got == want
    assert len(got) == 600 * len({r[2] or "" for r in rows})


@pytest.mark.parametrize("settings", [{"limit": 64}, {"limit": 200, "most": 0}, {"limit": 64, "most": 3}])
def test_masks_do_not_depend_on_how_texts_are_dealt(spark, settings):
    r = random.Random(3)
    starts = ["", "a", "same start of many texts ", "same start of many words ", "x" * 70, "é" * 40]
    rows = [(r.choice([None, *range(200)]), r.choice(starts) + r.choice(["", "b", "end", "z" * r.randrange(30)]), r.choice(["en", None, ""])) for _ in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = Counter()
    for x in document_masks(docs, **settings).collect():
        got[x["part"], x["mask"]] += x["n"]
    assert got == Counter(failures(rows))


def test_one_text_on_a_third_of_the_rows_and_one_id(spark):
    rows = [(7 if i % 3 == 1 else i, "a copy of one text" if i % 3 == 0 else f"own text {i}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    masks = document_masks(docs).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("mask").bitwiseAND(16) != 0, F.col("n"))).alias("e")).collect()[0]
    assert (masks["n"], masks["e"]) == (3000, 999)


def test_prefixes_are_lengthened_until_they_are_light(spark):
    texts = spark.createDataFrame([("shared beginning " + str(i),) for i in range(50)] + [("one text often, " * 3,)] * 50 + [("abc",)] * 50 + [(None,)], "text string")
    heavy, whole = heavy_prefixes(texts, 300)
    assert whole and b"share"[:4] in heavy[4] and b"shared b" in heavy[8] and b"shared beginning" in heavy[16] and 32 not in heavy
    assert not any(p.startswith(b"one ") for level in heavy.values() for p in level)
    assert heavy_prefixes(texts, 300, most=0)[1] is False


def test_trie_holds_least_ids():
    r, trie, want = random.Random(5), Trie(), {}
    for i in range(3000):
        t = bytes(r.choices(b"ab", k=r.randrange(9))) + r.choice([b"", b"tail", b"\xff\x00"])
        n = r.randrange(1000)
        end = trie.insert(t, n)
        want[t] = min(n, want.get(t, n))
        assert end[1] == want[t]
    assert sorted(x[1] for x in trie.terminals()) == sorted(want.values())
    depth = lambda node, path: [(path + node[0], node[1])] * (node[1] is not None) + [x for c in node[2].values() for x in depth(c, path + node[0])]
    assert dict(depth(trie.root, b"")) == want


def test_limits_of_the_filters():
    assert text_mask(b"") == 1
    assert text_mask(" ".join(map(str, range(200))).encode()) == 0
    assert text_mask(" ".join(map(str, range(199))).encode()) == 1
    assert text_mask(b"w\x0bw\x0cw\x1cw w") & 2 == 0  # 4 words, 2 of them distinct
    assert text_mask(("A" * 3 + "é" * 97).encode()) & 4 == 0 and text_mask(("A" * 4 + "é" * 96).encode()) & 4
    assert text_mask(b"a|b") & 8


def test_empty_table_has_no_parts(spark, empty):
    assert filter_audit(empty, label_table(spark)).count() == 0
    assert filter_audit(empty, label_table(spark).limit(0)).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
