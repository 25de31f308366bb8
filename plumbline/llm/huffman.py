"""Operator 1: token-id files coded with a canonical, length-limited Huffman code from global counts.

``write_token_files`` counts all ids once, fits one code (package-merge, at most ``max_len`` bits), range-partitions the
documents by doc_id and lets each task write its files. A file holds whole documents, up to about ``file_tokens`` ids,
and stands alone: the code lengths (the canonical code follows from them), a document table, a bit offset for each
block of ``block`` ids, the bit stream and a CRC-32 of all before it. ``read_token_files`` reads the files with Spark's
binaryFile source and decodes all blocks of a file side by side through one table of 2^max_len entries; any block can be
decoded from its checkpoint alone.

Size bounds: the counts that reach the driver and the code that goes to the tasks have one entry for each id of the
vocabulary; the manifest has one row for each file and stays a table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import drop, put, shared_dir, written
from .tokens import encode_texts, encoder

MAGIC = b"HUFIDS01"
HEAD = struct.Struct("<8sBIIQQI")  # magic, max_len, block, documents, ids, bits, bytes of the packed code lengths


def code_lengths(counts: np.ndarray, max_len: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_len`` bits for the symbols with a count (package-merge); 0 for the others.

    One used symbol gets one bit; none gives all zeros. Raises ValueError if 2^max_len codes are too few.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_len:
        raise ValueError(f"{len(used)} symbols don't fit codes of {max_len} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    row, from_leaf = leaf, [np.ones(len(leaf), bool)]
    for _ in range(max_len - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        from_leaf.append(at < len(leaf))
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for flags in reversed(from_leaf):
        leaves = int(flags[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol), as unsigned 64-bit integers."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        width = lengths[order].astype(np.int64)
        top = int(width[-1])
        share = np.left_shift(np.int64(1), top - width)  # each code's share of 2^top
        codes[order] = ((np.cumsum(share) - share) >> (top - width)).astype(np.uint64)
    return codes


def pack_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, max_len: int, block: int) -> bytes:
    """One file image from whole documents. A null doc_id is kept as null."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    starts, bits = ends - width, int(ends[-1]) if len(ends) else 0
    words = np.zeros(bits // 32 + 2, np.uint64)
    if len(ids):
        at, value = starts >> 5, codes[ids] << (64 - width - (starts & 31)).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
        words[at[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
    packed = zlib.compress(lengths.tobytes())
    body = b"".join([
        HEAD.pack(MAGIC, max_len, block, len(doc_ids), len(ids), bits, len(packed)), struct.pack("<I", len(lengths)), packed,
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), sizes.astype("<u4").tobytes(),
        starts[::block].astype("<u8").tobytes(), words.astype(">u4").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_table(lengths: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each value of the next ``max_len`` bits."""
    symbols, widths = np.zeros(1 << max_len, np.uint32), np.zeros(1 << max_len, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.left_shift(np.int64(1), max_len - lengths[order].astype(np.int64))
    filled = int(span.sum())
    symbols[:filled], widths[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbols, widths


def decode_blocks(words: np.ndarray, marks: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray], max_len: int) -> np.ndarray:
    """Decode blocks from their bit offsets, one id of each at a time; rows of the result are blocks."""
    symbols, widths = table
    out = np.zeros((int(sizes.max(initial=0)), len(marks)), np.uint32)
    bit, mask, room = marks.astype(np.int64), np.uint64((1 << max_len) - 1), 64 - max_len
    for k in range(len(out)):
        at = bit >> 5
        window = ((words[at] << np.uint64(32)) | words[at + 1]) >> (room - (bit & 31)).astype(np.uint64) & mask
        out[k] = symbols[window]
        bit = np.where(sizes > k + 1, bit + widths[window], bit)
    return out.T


_TABLES: dict[bytes, tuple] = {}


def unpack_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids) of a file image; ValueError if its magic, lengths or checksum are wrong."""
    if len(data) < HEAD.size + 8 or data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("wrong checksum")
    _, max_len, block, n_docs, n_ids, bits, n_packed = HEAD.unpack_from(data)
    at = HEAD.size + 4
    packed = data[at : at + n_packed]
    at += n_packed
    if packed not in _TABLES:
        _TABLES.clear()
        _TABLES[packed] = decode_table(np.frombuffer(zlib.decompress(packed), np.uint8), max_len)
    null = np.frombuffer(data, np.uint8, n_docs, at)
    doc_ids = np.frombuffer(data, "<i8", n_docs, at := at + n_docs)
    sizes = np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs).astype(np.int64)
    blocks = -(-n_ids // block)
    marks = np.frombuffer(data, "<u8", blocks, at := at + 4 * n_docs)
    words = np.frombuffer(data, ">u4", bits // 32 + 2, at + 8 * blocks).astype(np.uint64)
    per = np.full(blocks, block, np.int64)
    if blocks:
        per[-1] = n_ids - block * (blocks - 1)
    ids = decode_blocks(words, marks, per, _TABLES[packed], max_len).reshape(-1)[:n_ids]
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], sizes, ids


def id_counts(ids: DataFrame, vocab: int, wide: bool) -> np.ndarray:
    """Counts of all ids of the table; what is shuffled and collected has at most a row for each id and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4" if wide else "<u2")
            total += np.bincount(own, minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    out = np.zeros(vocab, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_token_files(ids: DataFrame, vocab: int, folder: str, max_len: int = 18, block: int = 512, file_tokens: int = 2_000_000) -> DataFrame:
    """Write the rows (doc_id, n_tokens, ids) in ascending doc_id order as files in ``folder``; returns the manifest.

    Null doc_ids come first; equal doc_ids lie together, by their ids. The manifest (part, seq, name, docs, n_tokens) is
    a table in the shared folder: a row for each file, whose order is that of (part, seq). No rows: no files.
    """
    wide = vocab > 1 << 16
    lengths = code_lengths(id_counts(ids, vocab, wide), max_len)
    codes = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, docs, sizes, held, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, n
            name = f"part-{part:06d}-{seq:06d}.huf"
            data = pack_file(docs, np.array(sizes, np.int64), np.frombuffer(b"".join(held), "<u4" if wide else "<u2"), lengths, codes, max_len, block)
            put(f"{folder}/{name}", data)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "docs": len(docs), "n_tokens": n}], schema)
            docs.clear(), sizes.clear(), held.clear()
            seq, n = seq + 1, 0
            return row

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            for d, k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs.append(d), sizes.append(k), held.append(x)
                n += k
                if n >= file_tokens:
                    yield flush()
        if docs:
            yield flush()

    rows = ids.select("doc_id", "n_tokens", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return written(rows.mapInArrow(run, "part int, seq int, name string, docs long, n_tokens long"), "huffman-manifest")[0]


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, sizes, ids = unpack_file(data)
                ends = np.cumsum(sizes)
                if int(ends[-1]) != len(ids):
                    raise ValueError(f"{name}: the documents' lengths don't add up")
                raw = ids.astype("<u4").tobytes()
                for at in range(0, len(docs), 500):
                    span = list(zip((ends - sizes)[at : at + 500].tolist(), ends[at : at + 500].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(span)), pa.array(docs[at : at + 500], pa.int64()), pa.array([a for a, _ in span], pa.int64()), pa.array([b - a for a, b in span], pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in span], pa.binary())], ["name", "doc_id", "at", "n_tokens", "ids"])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = manifest.select("name", before.alias("base"))
    files = spark.read.format("binaryFile").load(f"{folder}/*.huf") if manifest.take(1) else spark.createDataFrame([], "path string, content binary")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "name string, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(base, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Tokenise, write the coded files, read them back: doc_id, start, n_tokens, ids. See the functions above for edge cases.

    The tokenizer tells how wide its ids are. The files stay in the shared folder: the result reads them.
    """
    spark, own = docs.sparkSession, encoder(tokenizer_path)
    vocab = 1 << 16 if own.width == 2 else max((1 << 16) + 1, end_id + 1, *own.tok.get_vocab(with_added_tokens=True).values(), 0) + 1
    ids, at = written(encode_texts(docs, tokenizer_path, end_id), "token-ids")
    folder = shared_dir(spark, "huffman")
    manifest = write_token_files(ids, vocab, folder)
    drop(spark, at)
    return read_token_files(spark, folder, manifest)
