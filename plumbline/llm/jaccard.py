"""Operator 5: exact n-gram Jaccard join through a token-group matrix.

1. Every text becomes a set of shingle hashes; equal sets share a 64-bit set id, so copies count once from here on.
2. Grouping: sets that share one of a few min-hashes are compared with one set of that min-hash, the pivot. Verified
   links form groups that are one class already; sets without a link that are at least half like a pivot form blocks of
   about ``PAGE`` sets of similar size around it. (This only decides what the groups are; no link depends on it.)
3. The matrix has a cell (token, group) for the union of the members' prefixes. Tokens are ordered by (heavy or not, how
   heavy, hash); of two sets that link, the prefixes of n - ceil(t n) + 1 tokens share one. A cell holds the extreme
   sizes and numbers of tokens left of its members, and is combined before the shuffle.
4. Groups that share a token and whose bounds on the overlap allow a link are candidates, blocks also with themselves. Of
   each pair, the group with fewer members asks the pages of the other one. Counts in hash buckets of the asker's tokens
   and of the page's token union bound the overlap once more; only then tokens are sent, each set once for each page it
   asks. A page is opened if at least t of the asker's tokens lie in its union, and its sets are compared exactly; of the
   links found, those that join what is apart are kept.
5. Components of all links. Links inside classes are not all listed.

Nothing is capped: heavy tokens only change the order, large groups and their askers are split into pages. At most ``HEAVY``
heavy tokens are broadcast; tasks load maps of at most ``MAPPED`` entries, beyond which a join with the rows is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import drop, load_sorted, loadable, written
from .words import Words, mix, slices

SEEDS, HEAVY, MAPPED, PAGE = 4, 200_000, 2_000_000, 64
LOOSE, ROOM = 50, 200_000  # similarity to a pivot that puts a set into its block; tokens of a page
FLUSH = 800_000  # tokens that a task holds before it counts them
LAST = (1 << 63) - 1
U = np.uint64
_ZERO = np.zeros(0, U)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; fewer than k words count as one shingle, none as the empty set."""
    for a, b in slices(texts):
        w = Words(texts.slice(a, b - a), lower=True)
        grams = w.grams(k)
        for j, (f, n) in enumerate(zip(w.first.tolist(), w.counts.tolist(), strict=True)):
            if n >= k:
                yield a + j, np.unique(grams[f : f + n - k + 1])
            elif n:
                yield a + j, mix(np.bitwise_xor.reduce(mix(w.hashes[f : f + n] + np.arange(1, n + 1, dtype=U)))[None] + U(n))
            else:
                yield a + j, _ZERO


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int((mix(mix(tokens + U(0x51ED2701)).sum(dtype=U)[None]) ^ U(len(tokens))).view(np.int64)[0])


def bucket_counts(tokens: np.ndarray) -> bytes | None:
    """How many tokens fall into each of about n / 2 hash buckets, a byte each; None where a byte is too small."""
    buckets = 1 << min(16, max(6, len(tokens).bit_length() - 1))
    counts = np.bincount(((tokens >> U(8)) & U(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def most_shared(a: bytes, b: bytes) -> int:
    """No more than this can two sets share: the sum over buckets of the smaller count, the finer table folded."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in sorted((a, b), key=len))
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two sorted sets share."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row_key): rows of one key have the same id and text but for clashes of the hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text"))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Rows of kind 0: doc_id, n_shingles, sid (null without words), min-hashes and row key; of kind 1: tokens frequent within a task (sid, n)."""
    salts = mix(np.arange(1, SEEDS + 1, dtype=U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "sid", "mins", "counts", "row_key"]
        held, size, seen = [], 0, set()

        def heavy() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held) if held else _ZERO, return_counts=True)
            tokens, n = tokens[n >= 2].view(np.int64), n[n >= 2]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int64)), pa.array(tokens), pa.nulls(len(n), pa.list_(pa.int64())), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.int64())], names)

        for batch in batches:
            n, sids, mins, counts = [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                sids.append(set_id(s) if len(s) else None)
                new = len(s) and sids[-1] not in seen
                mins.append(mix(s[None, :] ^ salts[:, None]).min(axis=1).view(np.int64).tolist() if new else None)
                counts.append(bucket_counts(s) if new else None)
                if new:
                    seen.add(sids[-1])
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(sids, pa.int64()), pa.array(mins, pa.list_(pa.int64())), pa.array(counts, pa.binary()), batch.column(2)], names)
            if size > FLUSH:
                yield heavy()
                size = 0
        yield heavy()

    return _rows(docs).mapInArrow(run, "kind int, doc_id long, n long, sid long, mins array<long>, counts binary, row_key long")


def routed(docs: DataFrame, sets: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """(key, part, asks, one, sid, tokens) for each route (sid, key, part, asks, one), all of a (key, part) in one run, askers last.

    A set's tokens are computed from the row that stands for it and sent once for each route, in one shuffle. Rows that
    share id and text can send a set twice.
    """
    place = F.col("part") * 4 + F.col("one").cast("int") * 2 + F.col("asks").cast("int")
    table, folder = written(routes.join(sets.select("sid", "row_key"), "sid").select("row_key", "sid", "key", place.alias("place")), "jaccard-routes")
    rows = _rows(docs).select("row_key", "text")
    loaded = loadable(folder) and table.count() <= MAPPED
    if loaded:
        rows = rows.select("row_key", "text", F.lit(None).cast("array<struct<sid:long,key:long,place:long>>").alias("given"))
    else:
        rows = rows.join(table.groupBy("row_key").agg(F.collect_list(F.struct("sid", "key", "place")).alias("given")), "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out, size = set(), [], 0

        def full() -> pa.RecordBatch:
            key, place, sid, tokens = zip(*out, strict=True)
            at = np.array(place, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at >> 2), pa.array((at & 1) > 0), pa.array((at & 2) > 0), pa.array(sid, pa.int64()), pa.array(tokens, pa.binary())], ["key", "part", "asks", "one", "sid", "tokens"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if loaded:
                known, sids, to, places = load_sorted(folder, ("row_key", "sid", "key", "place"))
                lo, hi = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                hits = np.flatnonzero(hi > lo)
            else:
                hits = np.arange(len(keys))
            hits = np.array([h for h in hits.tolist() if keys[h] not in seen and not seen.add(keys[h])], np.int64)
            for j, s in shingle_sets(batch.column(1).take(pa.array(hits)), k):
                h = hits[j]
                if loaded:
                    ways = zip(to[lo[h] : hi[h]].tolist(), places[lo[h] : hi[h]].tolist(), sids[lo[h] : hi[h]].tolist(), strict=True)
                else:
                    ways = [(g["key"], g["place"], g["sid"]) for g in batch.column(2)[int(h)].as_py()]
                tokens = s.tobytes()
                for way in ways:
                    out.append((*way, tokens))
                    size += len(tokens)
                    if size > 1 << 22:
                        yield full()
                        out, size = [], 0
        if out:
            yield full()

    sent = rows.mapInArrow(run, "key long, part long, asks boolean, one boolean, sid long, tokens binary")
    return sent.repartition("key", "part").sortWithinPartitions("key", "part", "asks")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, bool, int, np.ndarray]]:
    """(new, asks, one, sid, tokens) of the rows of :func:`routed`; ``new`` at the first row of a (key, part)."""
    last = None
    for batch in batches:
        key, part, asks, one, sid = (c.to_pylist() for c in batch.columns[:5])
        for j, tokens in enumerate(batch.column(5)):
            new, last = (key[j], part[j]) != last, (key[j], part[j])
            yield new, asks[j], one[j], sid[j], np.frombuffer(tokens.as_buffer(), U)


def seed_pairs(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked): sets a and a pivot b of one of their min-hashes, where they are alike by ``LOOSE`` percent or link."""
    each = sets.select("sid", "n", F.posexplode("mins").alias("i", "m"))
    first = F.min(F.struct(F.xxhash64("sid", "i").alias("o"), "sid", "n"))  # an order of its own for each min-hash, so that a set has several pivots
    pivot = each.groupBy("i", "m").agg(first.alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "m", "p")
    near = F.least("n", F.col("p.n")) * 100 >= F.greatest("n", F.col("p.n")) * percent
    pairs, at = written(each.join(pivot, ["i", "m"]).where((F.col("sid") != F.col("p.sid")) & near).select(F.col("sid").alias("a"), F.col("p.sid").alias("b"), "n").distinct(), "seed-pairs")
    parts = pairs.groupBy("b").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    asks = pairs.join(parts, "b").select(F.col("a").alias("sid"), F.col("b").alias("key"), F.pmod(F.xxhash64("a"), "parts").alias("part"), F.lit(True).alias("asks"), F.lit(True).alias("one"))
    own = parts.select(F.col("b").alias("sid"), F.col("b").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), F.lit(True).alias("one"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pivot, b = [], _ZERO, 0
        for _, asking, _, sid, tokens in runs(batches):
            if not asking:
                pivot, b = tokens, sid
                continue
            c, n = in_common(tokens, pivot), len(tokens) + len(pivot)
            if 100 * c >= min(LOOSE, percent) * (n - c):
                out.append((sid, b, 100 * c >= percent * (n - c)))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

    out, _ = written(routed(docs, sets, asks.unionByName(own), k).mapInArrow(run, "a long, b long, linked boolean"), "seed-links")
    drop(docs.sparkSession, at)
    return out


def _parts(c: Column, n: Column) -> Column:
    """Into how many pages c sets of n tokens together go."""
    return F.ceil(F.greatest(c / PAGE, n / ROOM))


def blocks(alike: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sid, gid) of sets in no group: each joins the pivot that most of them are like, by size and in pages."""
    near = alike.where(~F.col("linked"))
    near = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), "b")).distinct()
    near = near.join(groups.select(F.col("sid").alias("a")), "a", "left_anti")
    degree = near.groupBy("b").agg(F.count(F.lit(1)).alias("d"))
    own = near.join(degree, "b").groupBy("a").agg(F.max(F.struct("d", "b")).alias("p")).select(F.col("a").alias("sid"), F.col("p.b").alias("b"))
    own = own.join(sizes, "sid").withColumn("s", F.floor(8 * F.log2("n")))
    parts = own.groupBy("b", "s").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    block = F.xxhash64("b", "s", F.pmod(F.xxhash64("sid"), "parts"))
    placed = own.join(parts, ["b", "s"]).select("sid", block.alias("gid"))
    return placed.join(placed.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gid"), "gid").select("sid", "gid")


def _order(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tokens by (weight class, hash); those that aren't heavy come first."""
    ids, weight = heavy
    if not len(ids):
        return tokens
    at = np.minimum(np.searchsorted(ids, tokens), len(ids) - 1)
    rank = np.where(ids[at] == tokens, weight[at], 0)
    return tokens[np.argsort(rank, kind="stable")] if rank.any() else tokens


def matrix_cells(docs: DataFrame, sets: DataFrame, groups: DataFrame, heavy: tuple[np.ndarray, np.ndarray], k: int, percent: int, buckets: int) -> DataFrame:
    """Packed cells of the token-group matrix by token bucket.

    A cell has its token (48 bits of it), group, least size of the members with the token in their prefix, how much
    larger the largest is, and the most tokens that a member has left from there on.
    """
    table, folder = written(groups.select("sid", "gid"), "jaccard-map")
    loaded = loadable(folder) and table.count() <= MAPPED
    rows = _rows(docs).select("row_key", "text")
    if loaded:
        rows = rows.select("text", F.lit(None).cast("long").alias("gid"))
    else:  # only the rows that stand for a set
        rows = rows.join(sets.select("sid", "row_key").join(table, "sid", "left").select("row_key", "gid"), "row_key").select("text", "gid")
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def cells() -> pa.RecordBatch:
            token, gid, n, left = (np.concatenate([h[c] for h in held]) for c in range(4))
            held.clear()
            order = np.lexsort((gid, token))
            token, gid, n, left = token[order], gid[order], n[order], left[order]
            first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])]))
            lo, hi, most = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), np.maximum.reduceat(left, first)
            token, gid = token[first], gid[first]
            bucket = ((token >> U(40)) * U(buckets) >> U(24)).astype(np.int64)
            used, at = np.unique(bucket, return_index=True)
            ends = np.append(at[1:], len(bucket))
            packed = [_pack(*(x[i:j] for x in (token >> U(16), gid, lo, hi - lo, most))) for i, j in zip(at, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array((ends - at).astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "n", "cells"])

        for batch in batches:
            given = batch.column(1).to_pylist()
            ids, values = load_sorted(folder, ("sid", "gid")) if loaded else (_ZERO.view(np.int64),) * 2
            for j, s in shingle_sets(batch.column(0), k):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                n, gid = len(s), given[j]
                if loaded and (at := int(np.searchsorted(ids, sid))) < len(ids) and ids[at] == sid:
                    gid = values[at]
                prefix = n - -(-percent * n // 100) + 1
                held.append((_order(s, sent.value)[:prefix].copy(), np.full(prefix, sid if gid is None else gid, np.int64), np.full(prefix, n, np.int32), n - np.arange(prefix, dtype=np.int32)))
                total += prefix
                if total > FLUSH // 2:
                    yield cells()
                    total = 0
        if held:
            yield cells()

    return rows.mapInArrow(run, "bucket int, n int, cells binary")


_PLANES = (("<u8", 8), ("<i8", 1), ("<u4", 4), ("<u4", 4), ("<u4", 4))


def _pack(token: np.ndarray, *more: np.ndarray) -> bytes:
    """Cells of one bucket, sorted by token, column by column and byte plane by byte plane, compressed."""
    import zstandard

    cols = [np.diff(token, prepend=U(0)), *more]
    return zstandard.compress(b"".join(c.astype(kind).view(np.uint8).reshape(-1, planes).T.tobytes() if planes > 1 else c.astype(kind).tobytes() for c, (kind, planes) in zip(cols, _PLANES, strict=True)), 1)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(data), 0, []
    for kind, planes in _PLANES:
        size = np.dtype(kind).itemsize * n
        part = np.frombuffer(raw, np.uint8, size, at)
        out.append(np.ascontiguousarray(part.reshape(planes, n).T).view(kind).reshape(-1) if planes > 1 else part.view(kind))
        at += size
    out[0] = np.cumsum(out[0], dtype=U)
    return out


def candidate_groups(cells: DataFrame, percent: int, block: int = 1_000_000) -> DataFrame:
    """Pairs (g, h), g < h, of groups that share a cell token whose bounds allow a link.

    Sets of n and m tokens link only if they share need = p (n + m) / (100 + p), and at their first common token they
    can share no more than either has left. So a cell reaches partners between p n / 100 and a largest size only; with
    the cells of a token in order of size these are a range, and no others are looked at. For groups the bounds take
    the members' extremes.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x, n) for x, n in zip(pdf["cells"], pdf["n"], strict=True)]
        token, gid, lo, more, left = (np.concatenate(c) for c in zip(*parts, strict=True))
        lo, left = lo.astype(np.int64), left.astype(np.int64)
        hi = lo + more
        order = np.lexsort((gid, token))
        token, gid = token[order], gid[order]
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])]))
        token, gid, lo, hi, left = token[first], gid[first], np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first), np.maximum.reduceat(left[order], first)
        number = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
        order = np.lexsort((lo, number))
        number, gid, lo, hi, left = number[order], gid[order], lo[order], hi[order], left[order]
        room = int(hi.max(initial=0)) + 2
        place = number * room + lo
        cap = np.minimum(left * (100 + percent) // percent - lo, lo)
        least = np.maximum(percent * lo // 100 - int((hi - lo).max(initial=0)), 0)
        at = np.searchsorted(place, number * room + least, side="left")
        to = np.minimum(np.searchsorted(place, number * room + np.maximum(cap, -1), side="right"), np.arange(len(place)))
        reach = np.maximum(to - at, 0)
        found, ends = [np.zeros((0, 2), np.int64)], np.cumsum(reach)
        k = 0
        while k < len(reach):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + block, side="right")))
            x = np.repeat(np.arange(k, stop), reach[k:stop])
            y = np.arange(len(x)) - np.repeat(np.cumsum(reach[k:stop]) - reach[k:stop], reach[k:stop]) + np.repeat(at[k:stop], reach[k:stop])
            need = -(-percent * (lo[x] + lo[y]) // (100 + percent))
            ok = (gid[x] != gid[y]) & (np.minimum(left[x], left[y]) >= need) & (100 * hi[y] >= percent * lo[x]) & (100 * hi[x] >= percent * lo[y])
            g, h = gid[x[ok]], gid[y[ok]]
            found = [np.unique(np.concatenate([*found, np.stack([np.minimum(g, h), np.maximum(g, h)], axis=1)]), axis=0)]
            k = stop
        return pd.DataFrame(found[0], columns=["g", "h"])

    return cells.groupBy("bucket").applyInPandas(run, "g long, h long").distinct()


def page_bounds(members: DataFrame) -> DataFrame:
    """(page, lo, hi, union) of rows (page, n, counts): sizes of the members and, in each hash bucket, the largest count.

    No member shares more with a set than the sum of the smaller counts. ``union`` is null where a member has no counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, page, lo, hi, most = [], None, 0, 0, None

        def close() -> None:
            if page is not None:
                out.append((page, lo, hi, most.astype(np.uint8).tobytes() if most is not None and most.max() < 256 else None))

        for batch in batches:
            for p, n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = None if counts is None else np.frombuffer(counts, np.uint8).astype(np.int64)
                if p != page:
                    close()
                    page, lo, hi, most = p, n, n, table
                    continue
                lo, hi = min(lo, n), max(hi, n)
                if most is not None and table is not None:
                    width = min(len(most), len(table))
                    most = np.maximum(most.reshape(-1, width).sum(axis=0), table.reshape(-1, width).sum(axis=0))
                else:
                    most = None
        close()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], ["page", "lo", "hi", "union"])

    dealt = members.where("c > 1").select("page", "n", "counts").repartition("page").sortWithinPartitions("page")
    many = dealt.mapInArrow(run, "page long, lo long, hi long, union binary")
    return many.unionByName(members.where("c = 1").select("page", F.col("n").alias("lo"), F.col("n").alias("hi"), F.col("counts").alias("union")))


def bounded(asked: DataFrame, sets: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """The rows (q, page) whose sizes and bucket counts allow that set q links with a member of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, a, lo, b in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                need = percent * (n + max(lo, -(-percent * n // 100)))
                ok.append(a is None or b is None or (100 + percent) * most_shared(a, b) >= need)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["q", "page"]).filter(pa.array(ok, pa.bool_()))

    sized = asked.join(sets.select(F.col("sid").alias("q"), "n", "counts"), "q").join(bounds, "page")
    sized = sized.where((F.col("hi") * 100 >= F.col("n") * percent) & (F.col("lo") * percent <= F.col("n") * 100))
    return sized.select("q", "page", "n", "counts", "lo", "union").mapInArrow(run, "q long, page long")


def open_groups(docs: DataFrame, sets: DataFrame, asked: DataFrame, pages: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between sets q and members of pages they ask: rows (q, page) and (page, sid, one).

    ``one`` tells pages whose members are one class; the others' members also ask their own page. A page's askers come in
    parts of about a page; each part gets the members and gives the links that join what was apart there.
    """
    sized = asked.join(sets.select(F.col("sid").alias("q"), "n"), "q")
    parts = sized.groupBy("page").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    asks = asked.join(parts, "page").select(F.col("q").alias("sid"), F.col("page").alias("key"), F.pmod(F.xxhash64("q"), "parts").alias("part"), F.lit(True).alias("asks"), F.lit(False).alias("one"))
    held = pages.join(parts, "page", "left").where("parts IS NOT NULL OR NOT one")
    held = held.select("sid", F.col("page").alias("key"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(False).alias("asks"), "one")

    def found(q: int, tokens: np.ndarray, page: dict) -> Iterator[tuple[int, int]]:
        if "union" not in page:
            page["count"] = np.array([len(t) for t in page["tokens"]])
            union, owner = np.concatenate(page["tokens"]), np.repeat(np.arange(len(page["sids"])), page["count"])
            order = np.argsort(union, kind="stable")
            page["union"], page["owner"] = union[order], owner[order]
        union, count, root = page["union"], page["count"], page["root"]

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        at = np.searchsorted(union, tokens, side="left")
        width = np.searchsorted(union, tokens, side="right") - at
        if 100 * np.count_nonzero(width) < percent * len(tokens):
            return
        places = np.repeat(at - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        shared = np.bincount(page["owner"][places], minlength=len(count))
        for j in np.flatnonzero(100 * shared >= percent * (len(tokens) + count - shared)).tolist():
            a, b = top(q), top(page["sids"][j])
            if a != b:
                root[max(a, b)] = min(a, b)
                yield q, page["sids"][j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, page = [], {}

        def close() -> None:
            if page and not page["one"] and len(page["sids"]) > 1:
                for q, tokens in zip(page["sids"], page["tokens"], strict=True):
                    out.extend(found(q, tokens, page))

        for new, asking, one, sid, tokens in runs(batches):
            if new:
                close()
                page = {"sids": [], "tokens": [], "one": one, "root": {}}
            if asking:
                out.extend(found(sid, tokens, page))
            elif sid not in page["root"]:
                page["sids"].append(sid)
                page["tokens"].append(tokens)
                page["root"][sid] = page["sids"][0] if one else sid
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    return routed(docs, sets, asks.unionByName(held), k).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id of its class of linked documents).

    A null text or one without words is an empty set: no shingles, linked with nothing, its own class. Fewer than k words
    form one shingle. Equal texts of one word or more link. Null doc_ids are rows like others but name no class: alone
    they get null. Repeated doc_ids are separate rows of which each gets the class of its own text. Other columns are
    not read; an empty table gives an empty table.
    """
    rows = classes(docs, k, percent)
    return rows.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def classes(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, row_key, n_shingles, class (null without words) and the class's component_id and least row key ``head``.

    ``head`` is the row key of the class's row with the least doc_id (null last, ties by key).
    """
    spark = docs.sparkSession
    told, at_told = written(describe(docs, k), "jaccard-rows")
    known = told.where("kind = 0").drop("kind")
    heavy, at_heavy = written(told.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "sid").limit(HEAVY), "jaccard-heavy")
    heavy = heavy.toPandas()  # the written table has the rows of all tasks cut to HEAVY
    drop(spark, at_heavy)
    ids = heavy["sid"].to_numpy(np.int64).view(U)
    at = np.argsort(ids)
    weight = np.log2(np.maximum(heavy["n"].to_numpy(np.float64), 2)).astype(np.int64)
    heavy = (ids[at], weight[at])

    row = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("doc_id").isNull().alias("x"), F.col("row_key").alias("row_key")))
    some = lambda c: F.first(c, ignorenulls=True).alias(c)
    sets = known.where("sid IS NOT NULL").groupBy("sid").agg(row.alias("row"), some("n"), some("mins"), some("counts"))
    sets, _ = written(sets.select("sid", "row", F.col("row.row_key").alias("row_key"), "n", "mins", "counts"), "jaccard-sets")
    alike = seed_pairs(docs, sets, k, percent)
    seeds = alike.where("linked").select("a", "b")
    verified, at_verified = written(components(seeds).select(F.col("node").alias("sid"), F.col("root").alias("gid")), "jaccard-groups")
    loose, at_loose = written(blocks(alike, verified, sets.select("sid", "n")), "jaccard-blocks")
    groups = verified.withColumn("one", F.lit(True)).unionByName(loose.withColumn("one", F.lit(False)))
    buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs, at_pairs = written(candidate_groups(matrix_cells(docs, sets, groups, heavy, k, percent, buckets), percent), "jaccard-candidates")

    # members and pages of the groups that take part; a group that is not listed is a single set
    part = pairs.select(F.col("g").alias("gid")).unionByName(pairs.select(F.col("h").alias("gid"))).unionByName(loose.select("gid")).distinct()
    counts = groups.join(sets.select("sid", "n"), "sid").groupBy("gid").agg(F.count(F.lit(1)).alias("c"), _parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    sized = part.join(counts, "gid", "left").select("gid", F.coalesce("c", F.lit(1)).alias("c"), "parts")
    members = sized.join(groups, "gid", "left").select("gid", "c", "parts", F.coalesce("one", F.lit(True)).alias("one"), F.coalesce("sid", "gid").alias("sid"))
    page = F.when(F.col("one") & (F.col("parts") > 1), F.xxhash64("gid", F.pmod(F.xxhash64("sid"), "parts"))).otherwise(F.col("gid"))
    members, at_members = written(members.withColumn("page", page).join(sets.select("sid", "n", "counts"), "sid"), "jaccard-members")
    two = pairs.join(sized.select(F.col("gid").alias("g"), F.col("c").alias("cg")), "g").join(sized.select(F.col("gid").alias("h"), F.col("c").alias("ch")), "h")
    few = F.col("cg") <= F.col("ch")
    asks = two.select(F.when(few, F.col("g")).otherwise(F.col("h")).alias("gid"), F.when(few, F.col("h")).otherwise(F.col("g")).alias("other"))
    asked = asks.join(members.select("gid", F.col("sid").alias("q")), "gid").join(members.select(F.col("gid").alias("other"), "page").distinct(), "other").select("q", "page")
    asked, at_asked = written(bounded(asked, sets, page_bounds(members), percent), "jaccard-asked")
    more, _ = written(open_groups(docs, sets, asked, members.select("page", "sid", "one"), k, percent), "jaccard-links")
    drop(spark, at_verified, at_loose, at_pairs, at_members, at_asked)

    roots = components(seeds.unionByName(more)).select(F.col("node").alias("sid"), "root")
    least = sets.select("sid", "row").join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "row")
    named = least.join(least.groupBy("root").agg(F.min("row").alias("top")), "root").select("sid", F.col("root").alias("class"), F.when(~F.col("top.x"), F.col("top.d")).alias("component_id"), F.col("top.row_key").alias("head"))
    return known.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "sid").join(named, "sid", "left").drop("sid")
