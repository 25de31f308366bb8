"""Operator 2: cost-balanced packing of token sequences.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n^2`` (feed-forward and attention). Documents
are cut into full pieces of ``capacity`` tokens, each a sequence of its own, and a rest. Rests are packed in groups of
about ``group`` documents, dealt by a hash of the row, so that one task holds a bounded number of lengths and never a
text: in descending order each goes to the lowest-cost sequence of its group that has room for it. A rest that fits
nowhere is cut: the lowest-cost sequences with room take what they can. A group opens just as many sequences as its
tokens need, so it leaves less than one sequence of padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import written
from .tokens import encode_texts

LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def pack_group(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece; every token of every item lies in exactly one.

    Items of no tokens give no piece; ties go to the earlier item and the earlier sequence.
    """
    out, seq = [], 0
    for k in np.flatnonzero(sizes >= capacity):
        for start in range(0, int(sizes[k]) - capacity + 1, capacity):
            out.append((int(k), start, capacity, seq, 0))
            seq += 1
    rest = sizes % capacity
    n = -(-int(rest.sum()) // capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)

    def place(k: int, start: int, length: int, at: int) -> None:
        out.append((k, start, length, seq + at, capacity - int(room[at])))
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length

    for k in np.lexsort((np.arange(len(rest)), -rest)):
        left, start = int(rest[k]), int(sizes[k] - rest[k])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            at = int(np.argmin(fits))
            if room[at] < left:
                at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            length = min(left, int(room[at]))
            place(int(k), start, length, at)
            start, left = start + length, left - length
    return out


def pack_lengths(rows: DataFrame, capacity: int = 1024, group: int = 4096) -> DataFrame:
    """From (row, n_tokens), row unique and not null: (row, start, length, sequence_id, offset) for each piece."""
    groups = max(1, -(-rows.count() // group))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        out = pd.DataFrame(pack_group(pdf["n_tokens"].to_numpy(), capacity), columns=["row", "start", "length", "sequence_id", "offset"], dtype="int64")
        out["row"] = pdf["row"].to_numpy()[out["row"].to_numpy()]
        out["sequence_id"] += int(key[0]) << 32
        return out

    dealt = rows.select("row", "n_tokens", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(run, "row long, start long, length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """Packed pieces with their ids: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null text is a document of just the end id. Null and repeated doc_ids are packed like others (rows, not ids, are
    the unit). Columns besides doc_id and text are not read. An empty table gives an empty table.
    """
    coded = encode_texts(docs, tokenizer_path, end_id).withColumn("row", F.monotonically_increasing_id())
    ids, _ = written(coded, "pack-ids")
    pieces = pack_lengths(ids.select("row", "n_tokens"), capacity)
    lists = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cols = [[] for _ in names]
                for doc, total, raw, own in zip(*(c.slice(at, 500).to_pylist() for c in batch.columns), strict=True):
                    all_ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * total else "<u4").astype("<u4").tobytes()
                    for p in own:
                        a, n = p["start"], p["length"]
                        for c, v in zip(cols, (doc, a, n, all_ids[4 * a : 4 * (a + n)], total, p["sequence_id"], p["offset"]), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    both = ids.join(lists, "row").select("doc_id", "n_tokens", "ids", "pieces")
    return both.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
