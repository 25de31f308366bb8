import itertools
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.operators import graphs as G
from plumbline.operators.boosting import U, mix

TEXTS = ["the cat sat on the mat and the dog sat on the log.", "one", "", None, "a b a b a b! c d\nc d e f g a", " ".join(random.Random(1).choice("abcdefghij") for _ in range(230)), "Ähre ähre x_y 12"]


def plain_graph(words):
    near = {w: set() for w in words}
    for a, b in zip(words, words[1:]):
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def chain(parts):
    out = U(0x9E3779B97F4A7C15)
    for p in parts:
        out = mix(out ^ U(p))
    return int(out)


def plain_environments(words, radius):
    near = plain_graph(words)
    ids, cover, kept = {w: G.word_hash(w) for w in near}, {w: frozenset([w]) for w in near}, {}
    for r in range(radius + 1):
        for i, c in sorted((ids[w], tuple(sorted(cover[w]))) for w in near):
            kept.setdefault(c, i)
        ids = {w: chain([r + 1, ids[w], *sorted(ids[v] for v in near[w])]) for w in near}
        cover = {w: cover[w].union(*(cover[v] for v in near[w])) for w in near}
    return Counter(kept.values())


def plain_paths(words, length):
    near, out = plain_graph(words), Counter()
    for nodes in itertools.permutations(near, length + 1):
        if nodes <= nodes[::-1] and all(b in near[a] for a, b in zip(nodes, nodes[1:])):
            own = [G.word_hash(w) for w in nodes]
            out[min(chain(own), chain(own[::-1]))] += 1
    return out


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_environments_of_the_same_nodes_count_once(radius):
    for text in TEXTS:
        for words in G.pieces(text or ""):
            assert Counter(map(int, G.environments(words, radius))) == plain_environments(words, radius)
    assert len(G.environments(["a", "b"], 3)) == 3  # a, b and the pair


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_paths_are_simple_and_count_once(length):
    for text in TEXTS[:5]:
        for words in G.pieces(text or ""):
            assert Counter(map(int, G.path_hashes(words, length))) == plain_paths(words, length)


def test_pieces_lose_no_word():
    long = " ".join(f"w{i}" for i in range(250))
    assert [len(p) for p in G.pieces(long)] == [100, 100, 50] and list(G.pieces("A b.\nC!")) == [["a", "b"], ["c"]]


def test_counts_by_row(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string").repartition(3)
    for f, presence in ((lambda w: G.environments(w, 2), False), (lambda w: G.path_hashes(w, 3), False), (lambda w: G.pattern_hashes(w, 3), True)):
        got = {(r["row_id"], r["bucket"]): r["n"] for r in G.counted(df, "text", f, 64, presence).collect()}
        want = Counter()
        for i, t in enumerate(TEXTS):
            for words in G.pieces(t or ""):
                want.update((i, int(h % U(64))) for h in f(words))
        assert got == ({k: 1 for k in want} if presence else dict(want))
    assert np.array_equal(G.pattern_hashes([], 3), np.zeros(0, U))


def test_graphs_of_many_pieces_are_looked_at_together(spark, monkeypatch):
    """The calls of a function are far fewer than the pieces, output comes in small batches, and counts stay the same."""
    r = random.Random(3)
    star = " ".join(f"hub w{i}" for i in range(49))
    texts = [*TEXTS, star, *(". ".join(" ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 30))) for _ in range(40)) for _ in range(20))]
    for name, n in (("WORDS", 500), ("WALKS", 300), ("ROWS", 4)):
        monkeypatch.setattr(G, name, n)
    for find, one in ((G.environments_of(2), lambda w: G.environments(w, 2)), (G.paths_of(range(3, 4), False), lambda w: G.path_hashes(w, 3)), (G.paths_of(range(5), True), lambda w: G.pattern_hashes(w, 4))):
        many = [words for t in texts for words in G.pieces(t or "")]
        got, want = Counter(), Counter()
        for piece, h in find(G.Graphs(many)):
            got.update(zip(piece.tolist(), h.tolist(), strict=True))
        for k, words in enumerate(many):
            want.update((k, int(h)) for h in one(words))
        assert got == want
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(2)
    same = [{tuple(x) for x in f.collect()} for f in (G.counted_graphs(df, "text", G.paths_of(range(3, 4), False), 64), G.counted(df, "text", lambda w: G.path_hashes(w, 3), 64))]
    assert same[0] == same[1]
