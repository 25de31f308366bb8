"""Fingerprints of word graphs: circular environments, 4-paths and pattern paths, counted in hashed buckets.

A text is cut into pieces: sentences (at . ! ? and line ends), long ones at every ``PIECE`` words. The nodes of a piece are
its distinct lower-case words, and words that stand side by side are joined by an edge. Rows are independent of each
other, so each task works on its own rows; a piece bounds what a graph can hold, and the graphs of many pieces are looked
at together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import U, mix

PIECE = 100
_WORDS = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?\n]")


def word_hash(word: str) -> int:
    """A stable 64-bit hash: the bytes as digits of a number, mixed."""
    out = 0
    for b in word.encode():
        out = (out * 0x100000001B3 + b + 1) & (1 << 64) - 1
    return int(mix(U(out)))


def pieces(text: str) -> Iterator[list[str]]:
    for sentence in _STOP.split(text.lower()):
        words = _WORDS.findall(sentence)
        for at in range(0, len(words), PIECE):
            yield words[at : at + PIECE]


#: Words whose graphs are held at once, walks that are followed at once, characters of texts and rows whose counts are, known words.
WORDS, WALKS, CHARS, ROWS, KNOWN = 20_000, 200_000, 1 << 20, 256, 200_000


class Graphs:
    """The graphs of many pieces side by side: hashes and pieces of all nodes, and for each node the nodes next to it.

    The nodes of a piece follow one another; those next to node k are ``to[start[k] : start[k + 1]]``.
    """

    def __init__(self, many: list[list[str]], known: dict[str, int] | None = None):
        known = {} if known is None else known
        code, own = {}, []
        at = np.fromiter((code.setdefault(w, len(code)) for words in many for w in words), np.int64)
        for w in code:
            if w not in known:
                known[w] = word_hash(w)
            own.append(known[w])
        piece = np.repeat(np.arange(len(many)), [len(words) for words in many])
        nodes, node = np.unique(piece * max(1, len(code)) + at, return_inverse=True)
        self.piece = nodes // max(1, len(code))
        self.own = np.array(own, U)[nodes % max(1, len(code))]
        side = np.flatnonzero((piece[1:] == piece[:-1]) & (node[1:] != node[:-1]))
        a, b = node[side], node[side + 1]
        n = len(nodes)
        both = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.of, self.to = both // max(1, n), both % max(1, n)
        self.start = np.searchsorted(self.of, np.arange(n + 1))


Found = Iterator[tuple[np.ndarray, np.ndarray]]  # (piece, hash) of some of what was found


def chained(parts: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a matrix of hashes, in order."""
    out = np.full(len(parts), 0x9E3779B97F4A7C15, U)
    for col in parts.T:
        out = mix(out ^ col)
    return out


def environments_of(radius: int) -> Callable[[Graphs], Found]:
    """Identifiers of all environments up to a radius.

    A node's identifier of radius r comes from its own and, sorted, its neighbours' of radius r - 1. Of environments that
    cover the same nodes one counts, that of the smaller radius and then of the smaller identifier. What a node covers
    is a mask of the nodes of its piece, which has at most ``PIECE``.
    """

    def find(g: Graphs) -> Found:
        n, own = len(g.own), g.own
        if not n:
            return
        place = np.arange(n) - np.searchsorted(g.piece, g.piece)
        cover = np.zeros((n, -(-PIECE // 64)), U)
        cover[np.arange(n), place // 64] = U(1) << (place % 64).astype(U)
        many = np.diff(g.start)
        linked = np.flatnonzero(many)
        ids, covers = [], []
        for r in range(radius + 1):
            ids.append(own)
            covers.append(cover)
            if r < radius:
                near = own[g.to][np.lexsort((own[g.to], g.of))]
                turn = mix(np.full(n, mix(U(0x9E3779B97F4A7C15) ^ U(r + 1)), U) ^ own)
                open_, k = linked, 0
                while len(open_):
                    turn[open_] = mix(turn[open_] ^ near[g.start[open_] + k])
                    k += 1
                    open_ = open_[many[open_] > k]
                wider = cover.copy()
                if len(linked):
                    wider[linked] |= np.bitwise_or.reduceat(cover[g.to], g.start[linked])
                own, cover = turn, wider
        ids, covers, piece = np.concatenate(ids), np.concatenate(covers), np.tile(g.piece, radius + 1)
        order = np.lexsort((ids, np.repeat(np.arange(radius + 1), n), *covers.T, piece))
        new = np.concatenate([[True], (piece[order][1:] != piece[order][:-1]) | (covers[order][1:] != covers[order][:-1]).any(axis=1)])
        yield piece[order][new], ids[order][new]

    return find


def paths_of(lengths: range, salted: bool) -> Callable[[Graphs], Found]:
    """A hash for each simple path of so many edges, the same from both ends; each path once. ``salted``: with its length.

    Starts are taken together as far as not over ``WALKS`` walks, counted beforehand, begin there.
    """

    def find(g: Graphs) -> Found:
        n, longest = len(g.own), lengths[-1]
        walks = np.ones(n)
        total = walks
        sums = lambda v: np.concatenate([[0.0], np.cumsum(v[g.to])])
        for _ in range(longest):
            added = sums(walks)
            walks = added[g.start[1:]] - added[g.start[:-1]]
            total = np.maximum(total, walks)
        group = np.cumsum(total) // WALKS
        for first, end in zip(*(np.searchsorted(group, np.unique(group), side) for side in ("left", "right")), strict=True):
            paths = np.arange(first, end)[:, None]
            for length in range(longest + 1):
                if length:
                    last = paths[:, -1]
                    many = g.start[last + 1] - g.start[last]
                    rows = np.repeat(np.arange(len(paths)), many)
                    to = g.to[np.arange(len(rows)) - np.repeat(np.cumsum(many) - many - g.start[last], many)]
                    fresh = (paths[rows] != to[:, None]).all(axis=1)
                    paths = np.column_stack([paths[rows[fresh]], to[fresh]])
                if length in lengths:
                    once = paths[paths[:, 0] < paths[:, -1]] if length else paths
                    hashes = np.minimum(chained(g.own[once]), chained(g.own[once[:, ::-1]]))
                    yield g.piece[once[:, 0]], mix(hashes ^ U(length)) if salted else hashes

    return find


def _of_one(find: Callable[[Graphs], Found], words: list[str]) -> np.ndarray:
    return np.concatenate([np.zeros(0, U), *(h for _, h in find(Graphs([words])))])


def environments(words: list[str], radius: int) -> np.ndarray:
    """Identifiers of all environments of a piece."""
    return _of_one(environments_of(radius), words)


def path_hashes(words: list[str], length: int) -> np.ndarray:
    """Hashes of all paths of a piece with so many edges."""
    return _of_one(paths_of(range(length, length + 1), False), words)


def pattern_hashes(words: list[str], longest: int) -> np.ndarray:
    """Hashes of all paths of 0 to ``longest`` edges of a piece, salted with their length."""
    return _of_one(paths_of(range(longest + 1), True), words)


def counted(df: DataFrame, text: str, hashes: Callable[[list[str]], np.ndarray], buckets: int, presence: bool = False) -> DataFrame:
    """(row_id, bucket, n) of the non-empty buckets of each row's hashes; n is 1 with ``presence``. A null text has none."""
    return _counted(df, text, lambda many, known: ((np.full(len(h), i), h) for i, words in enumerate(many) for h in (hashes(words),)), buckets, presence)


def counted_graphs(df: DataFrame, text: str, find: Callable[[Graphs], Found], buckets: int, presence: bool = False) -> DataFrame:
    """The same of what is found in the graphs of many pieces at a time."""
    return _counted(df, text, lambda many, known: find(Graphs(many, known)), buckets, presence)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _counted(df: DataFrame, text: str, find: Callable[[list[list[str]], dict], Found], buckets: int, presence: bool) -> DataFrame:
    """Pieces are looked at ``WORDS`` words at a time, and rows written after ``ROWS`` rows or ``CHARS`` characters."""

    def counts(texts: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
        """Counts by number of the text * buckets + bucket."""
        parts, many, rows, size = [], [], [], 0

        def flush() -> None:
            for piece, h in find(many, known):
                key, n = np.unique(np.array(rows)[piece] * buckets + (h % U(buckets)).astype(np.int64), return_counts=True)
                parts.append((key, n))
                if sum(len(k) for k, _ in parts) > 2 * buckets * len(texts):
                    parts[:] = [_added(parts)]
            many.clear()
            rows.clear()
            if len(known) > KNOWN:
                known.clear()

        for row, t in enumerate(texts):
            for words in pieces(t):
                many.append(words)
                rows.append(row)
                size += len(words)
                if size >= WORDS:
                    flush()
                    size = 0
        if many:
            flush()
        return _added(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array(batch.column(0).to_pylist(), object)
            texts: list[str] = []
            chars = 0
            for at in range(batch.num_rows):
                texts.append(batch.column(1)[at].as_py() or "")
                chars += len(texts[-1])
                if chars >= CHARS or len(texts) == ROWS or at + 1 == batch.num_rows:
                    key, n = counts(texts, known)
                    own = ids[at + 1 - len(texts) + key // buckets]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(key % buckets), pa.array(np.ones_like(n) if presence else n)], ["row_id", "bucket", "n"])
                    texts, chars = [], 0

    return df.select(F.col("row_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "row_id long, bucket long, n long")
