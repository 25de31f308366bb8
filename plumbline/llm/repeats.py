"""Operator 6: repeated passages across documents through prefix-partitioned suffix trees of words.

A window is ``WINDOW`` words of one document. Suffixes that may begin a repeated window are split by prefixes of variable
length into groups that fit in memory. In each group the suffixes, cut at the window's depth, are brought into the order
of a suffix tree; the common prefixes of neighbours, compared word by word, give its internal nodes. A node as deep as a
window is a repeat, all but its first leaf (doc_id, start) are marked, and runs of marked windows of a document are the
maximal passages that it repeats.

1. Each window has an anchor, its least-hashed run of ``ANCHOR`` words: equal windows have equal anchors in equal places.
   Anchors are counted over all documents; a window whose anchor occurs once cannot repeat.
2. An anchor is the shortest prefix: the suffixes that reach it go to its group, as one item with the text around it.
   Where more than ``OFTEN`` suffixes share it, each goes by the words from its own start to the anchor's end (``ANCHOR``
   to ``WINDOW`` words); these prefixes are counted in turn, and one that is still too frequent is extended to the whole
   window. Prefixes are dealt into buckets of about ``BUCKET`` bytes, counted beforehand.
3. Of suffixes that already meet in one flush of a task under one such node, only the first leaf goes on, so a passage
   that many documents share is sent at most once by a flush: its group has a leaf for each flush, not for each copy.
4. The marks return to the documents by a row key, and each word that a marked window covers goes.

Tables of at most ``LOADED`` anchors or prefixes are read by tasks from the shared folder. Beyond that anchors come by a
join, and frequent prefixes are all extended to the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import drop, load_sorted, loadable, whole_row, written
from .words import Words, mix, slices

WINDOW, ANCHOR, OFTEN, LOADED = 20, 10, 2000, 4_000_000
BUCKET, ROWS = 6 << 20, 40_000  # bytes of the items of a bucket; suffixes whose subtrees are built at once
SHIFTS = WINDOW - ANCHOR + 1
SPAN = 2 * WINDOW - ANCHOR  # words around an anchor that its windows can reach
U = np.uint64
_STEP = U(0xC2B2AE3D27D4EB4F)


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, anchor position, anchor hash) of each window; ties of hashes go to the left."""
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    if len(doc) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U)
    start = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
    grams = w.grams(ANCHOR)
    best, at = grams[start], start.copy()
    for j in range(1, SHIFTS):
        other = grams[start + j]
        less = other < best
        best = np.where(less, other, best)
        at[less] = start[less] + j
    return start, doc[start], at, best


def _keyed(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text): rows with equal id and text share the key, and so the result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(h, n): the anchors that occur more than once, by documents and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for a, b in slices(batch.column(0)):
                _, _, at, h = _windows(Words(batch.column(0).slice(a, b - a)))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                held.append(h[first])
                size += len(first)
                if size > 1_000_000:
                    yield flush()
                    size = 0
        yield flush()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def _prefixes(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the ``length`` words from each start."""
    out, run = np.zeros(len(start), U), np.zeros(len(start), U)
    for j in range(WINDOW):
        run = run * _STEP + words[start + j]
        out = np.where(length == j + 1, run, out)
    return mix(out + length.astype(U))


def _hits(w: Words, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, text, anchor position, anchor hash, count) of the windows whose anchor is known to repeat."""
    start, doc, at, h = _windows(w)
    if not len(start) or not len(known):
        return start[:0], doc[:0], at[:0], h[:0], np.zeros(0, np.int64)
    where = np.minimum(np.searchsorted(known, h.view(np.int64)), len(known) - 1)
    hit = np.flatnonzero(known[where] == h.view(np.int64))
    return start[hit], doc[hit], at[hit], h[hit], n[where[hit]]


def _looked_up(docs: DataFrame, counts: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """Rows (rid, doc_id, text, known) and whether tasks load the repeated anchors; else ``known`` has those of the row."""
    if loadable(folder) and counts.count() <= LOADED:
        return _keyed(docs).select("rid", "doc_id", "text", F.lit(None).cast("array<struct<h: long, n: long>>").alias("known")), True
    return _keyed(docs).join(_anchors_of(docs, counts), "rid", "left").select("rid", "doc_id", "text", "known"), False


def _known(loaded: bool, folder: str, given: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    if loaded:
        return tuple(load_sorted(folder, ("h", "n")))
    pairs = sorted({(p["h"], p["n"]) for k in range(a, b) for p in given[k].as_py() or ()})
    return np.array([h for h, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int64)


def frequent_prefixes(docs: DataFrame, counts: DataFrame, folder: str) -> DataFrame:
    """(h, n): prefixes up to the anchor's end that more than ``OFTEN`` suffixes with a frequent anchor share."""
    rows, loaded = _looked_up(docs, counts.where(F.col("n") > OFTEN), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for a, b in slices(batch.column(2)):
                w = Words(batch.column(2).slice(a, b - a))
                start, _, at, _, n = _hits(w, *_known(loaded, folder, batch.column(3), a, b))
                often = np.flatnonzero(n > OFTEN)
                held.append(_prefixes(w.hashes, start[often], at[often] - start[often] + ANCHOR))
                size += len(often)
                if size > 500_000:
                    yield flush()
                    size = 0
        yield flush()

    return rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN)


def _packed(rows: dict[str, np.ndarray], words: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with the bytes of its items."""
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(order))
    cols = [pa.array([x[order[i:j]].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()) for x in (*rows.values(), words)]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *cols], ["bucket", *rows, "words"])


def repeat_candidates(docs: DataFrame, counts: DataFrame, folder: str, deep: str | None, buckets: int) -> DataFrame:
    """Packed items by bucket: row key, document order, anchor start, mask of windows to look up, and words around the anchor.

    Items without words are settled: their mask tells the windows that are not the first leaf of their node in a flush.
    ``deep`` is the folder of the prefixes to be extended to the whole window, None where all are.
    """
    rows, loaded = _looked_up(docs, counts, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            wh, key, start, occ, shift, prefix, rid, pos, count, anchor = (np.concatenate([h[k] for h in held]) for k in range(10))
            context = np.concatenate([h[10] for h in held])
            held.clear()
            later = marked(context, occ, shift, wh, key, start)
            m = len(rid)
            done = np.bincount(occ[later], (1 << shift)[later], m).astype("<u2")
            open_ = np.bincount(occ[~later], (1 << shift)[~later], m).astype("<u2")
            order_key = np.zeros(m, np.int64)
            order_key[occ] = key
            took = np.flatnonzero(done)
            if len(took):
                yield _packed({"rid": rid[took], "key": order_key[took], "pos": pos[took], "mask": done[took]}, np.zeros((len(took), 0), "<u8"), (rid[took].view(U) % U(buckets)).astype(np.int64))
            few = np.flatnonzero((open_ > 0) & (count <= OFTEN))
            if len(few):
                yield _packed({"rid": rid[few], "key": order_key[few], "pos": pos[few], "mask": open_[few]}, context[few], ((anchor[few] >> U(32)) % U(buckets)).astype(np.int64))
            many = np.flatnonzero(~later & (count[occ] > OFTEN))
            for part in np.array_split(many, -(-len(many) // ROWS)) if len(many) else ():
                o = occ[part]
                yield _packed({"rid": rid[o], "key": order_key[o], "pos": pos[o], "mask": (1 << shift[part]).astype("<u2")}, context[o], ((prefix[part] >> U(32)) % U(buckets)).astype(np.int64))

        for batch in batches:
            rids, ids = batch.column(0).to_numpy(), batch.column(1).fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(2)):
                w = Words(batch.column(2).slice(a, b - a))
                start, doc, at, h, n = _hits(w, *_known(loaded, folder, batch.column(3), a, b))
                if not len(start):
                    continue
                whole = _prefixes(w.hashes, start, np.full(len(start), WINDOW))
                prefix = whole.copy()
                often = np.flatnonzero(n > OFTEN) if deep else np.zeros(0, np.int64)
                if len(often):
                    own = _prefixes(w.hashes, start[often], at[often] - start[often] + ANCHOR)
                    further = load_sorted(deep, ("h",))[0]
                    place = np.searchsorted(further, own.view(np.int64))
                    short = further[np.minimum(place, len(further) - 1)] != own.view(np.int64) if len(further) else np.ones(len(own), bool)
                    prefix[often[short]] = own[short]
                new = np.concatenate([[True], at[1:] != at[:-1]])
                occ, first = np.cumsum(new) - 1 + base, np.flatnonzero(new)
                around = w.hashes[np.clip(at[first][:, None] + np.arange(ANCHOR - WINDOW, WINDOW), 0, len(w.hashes) - 1)]
                held.append((whole, ids[a:b][doc], start - w.first[doc], occ, at - start, prefix, rids[a:b][doc[first]], (at - w.first[doc])[first], n[first], h[first], around))
                base += len(first)
                size += len(first)
                if size > 50_000:
                    yield from flush()
                    size = base = 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "bucket int, rid binary, key binary, pos binary, mask binary, words binary")


def _anchors_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(rid, known): the repeated anchors of each row, where they are too many to be loaded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for a, b in slices(batch.column(1)):
                _, doc, at, h = _windows(Words(batch.column(1).slice(a, b - a)))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(rids[a:b][doc[first]]), pa.array(h[first].view(np.int64))], ["rid", "h"])

    each = _keyed(docs).select("rid", "text").mapInArrow(run, "rid long, h long").distinct()
    return each.join(counts, "h").groupBy("rid").agg(F.collect_list(F.struct("h", "n")).alias("known"))


def subtree_repeats(words: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mask of the suffixes (rows of WINDOW words) that are not the first leaf, by (key, start), of a deep internal node.

    Rows with an equal prefix are brought together, as the leaves of a suffix tree are; where the common prefix of
    neighbours, word by word, is as deep as a window they hang below one internal node. Leaves with an equal
    (key, start) stand for one place.
    """
    out = np.zeros(len(words), bool)
    if len(words) < 2:
        return out
    keys = []
    for depth in (ANCHOR, WINDOW):
        run = np.zeros(len(words), U)
        for j in range(depth):
            run = run * _STEP + words[:, j].astype(U)
        keys.append(run)
    order = np.lexsort(keys[::-1])
    depth = np.cumprod(words[order][1:] == words[order][:-1], axis=1).sum(axis=1)
    node = np.concatenate([[0], np.cumsum(depth < words.shape[1])])
    leaf = np.lexsort((start[order], key[order], node))
    order, node = order[leaf], node[leaf]
    new = np.concatenate([[True], node[1:] != node[:-1]])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out[order] = (key[order] != key[lead]) | (start[order] != start[lead])
    return out


def marked(context: np.ndarray, item: np.ndarray, shift: np.ndarray, prefix: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mask of the suffixes that :func:`subtree_repeats` marks; suffixes of different ``prefix`` are in different subtrees.

    A suffix starts ``shift`` words before the anchor of its item. Subtrees are built ``ROWS`` suffixes at a time, those
    of one prefix together; a suffix alone with its prefix has none.
    """
    out = np.zeros(len(item), bool)
    order = np.argsort(prefix, kind="stable")
    same = prefix[order][1:] == prefix[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    edges = np.flatnonzero(np.concatenate([[True], prefix[order][1:] != prefix[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    at = 0
    while at < len(order):
        to = int(edges[max(np.searchsorted(edges, at + ROWS, side="right") - 1, np.searchsorted(edges, at, side="right"))])
        own = order[at:to]
        words = context[item[own][:, None], (WINDOW - ANCHOR - shift[own])[:, None] + np.arange(WINDOW)]
        out[own] = subtree_repeats(words, key[own], start[own])
        at = to
    return out


def repeat_marks(packed: DataFrame) -> DataFrame:
    """(rid, pos, mask): the windows around the anchor at word ``pos`` that repeat; bit a is the window a words before it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for settled in (True, False):
            part = pdf[(pdf["words"].str.len() == 0) == settled]
            cat = lambda c, kind, part=part: np.frombuffer(b"".join(part[c]), kind)
            rid, order, pos, mask = cat("rid", "<i8"), cat("key", "<i8"), cat("pos", "<i8"), cat("mask", "<u2")
            if not settled and len(rid):
                around = cat("words", "<u8").reshape(-1, SPAN)
                item, shift = np.nonzero((mask[:, None] >> np.arange(SHIFTS, dtype=np.uint16)) & 1)
                whole = _prefixes(around.reshape(-1), item * SPAN + WINDOW - ANCHOR - shift, np.full(len(item), WINDOW))
                again = marked(around, item, shift, whole, order[item], pos[item] - shift)
                mask = np.bincount(item[again], (1 << shift)[again], len(rid)).astype(np.int64)
            out.append(pd.DataFrame({"rid": rid, "pos": pos.astype(np.int32), "mask": mask.astype(np.int32)})[mask > 0])
        return pd.concat(out)

    return packed.groupBy("bucket").applyInPandas(run, "rid long, pos int, mask int").groupBy("rid", "pos").agg(F.bit_or("mask").alias("mask"))


def without_repeats(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space), spans.

    ``spans`` are the maximal repeated passages that were removed, as word ranges (from, to), in order. With ``carry``, a struct column ``row`` holds the named columns as they were.

    A null or empty text has no words; texts shorter than a window lose none. Documents are ordered by doc_id, null last;
    rows with one doc_id are one document for that order, and equal starts in them count as one place, so exact repeats
    of a row keep what the row keeps. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    counts, folder = written(anchor_counts(docs), "repeat-anchors")
    total = counts.agg(F.sum("n").alias("items"), F.max("n").alias("most")).collect()[0]
    deep = None
    if (total["most"] or 0) > OFTEN:
        prefixes, deep = written(frequent_prefixes(docs, counts, folder), "repeat-prefixes")
        deep = deep if loadable(deep) and prefixes.count() <= LOADED else None
    buckets = max(1, -(-(total["items"] or 0) * (8 * SPAN + 26) // BUCKET))
    marks = repeat_marks(repeat_candidates(docs, counts, folder, deep, buckets))
    each, _ = written(marks.groupBy("rid").agg(F.collect_list(F.struct("pos", "mask")).alias("marks")), "repeat-marks")
    drop(spark, folder, *([deep] if deep else []))

    ranges = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                n, gone, kept, spans = [], [], [], []
                for text, found in zip(batch.column(1).slice(at, 500).to_pylist(), batch.column(2).slice(at, 500), strict=True):
                    words = (text or "").encode().split()
                    n.append(len(words))
                    if found.is_valid and len(found):
                        pos, mask = found.values.field(0).to_numpy(), found.values.field(1).to_numpy()
                        item, shift = np.nonzero((mask[:, None] >> np.arange(SHIFTS)) & 1)
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, pos[item] - shift, 1)
                        np.add.at(edge, pos[item] - shift + WINDOW, -1)
                        cover = np.cumsum(edge)[:-1] > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
                        spans.append([{"from": int(a), "to": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                        keep = np.flatnonzero(~cover).tolist()
                        gone.append(len(words) - len(keep))
                        words = [words[k] for k in keep]
                    else:
                        gone.append(0)
                        spans.append([])
                    kept.append(b" ".join(words))
                more = [c.slice(at, 500) for c in batch.columns[3:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, ranges), *more], ["doc_id", "n_words", "n_removed", "kept", "spans", *["row"] * len(more)])

    rows = [whole_row(carry).alias("row")] if carry else []
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rows).withColumn("rid", F.xxhash64("doc_id", "text"))
    joined = keyed.join(each, "rid", "left").select("doc_id", "text", "marks", *(["row"] if carry else []))
    schema = T.StructType([*T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept string, spans array<struct<from: long, to: long>>").fields, *joined.schema.fields[3:]])
    return joined.mapInArrow(run, schema)
