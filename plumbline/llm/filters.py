"""Operator 13: audit of how document filters interact, duplicates found in radix text tries.

Five filters judge a whole text: A, under 200 words; B, under half of its words distinct; C, over 3 % capitals A-Z; D, one
of the characters ``#$%&*|``; E, a smaller doc_id has the same text. A to D are known where a text is read. For E texts
are dealt by ranges, each the texts that start with one prefix: prefixes whose texts are too many bytes are lengthened,
in counted steps over all documents, until each range fits in memory. A task inserts whole texts in a compressed trie, an
edge being a run of bytes, whose terminals hold the least id; then it walks the trie and tells which entries are copies.
A text counts once for each task that reads it, with its least id there, before it is sent: all rows of a greater id are
copies already, so a text that a third of all rows share is an entry for each task, not for each row.

Then only masks of five bits are left; they are summed by part, mask and labels, and all orders of the filters are read
off those sums. A null text counts as empty and equals other empty ones. A null id is neither a copy nor the reason for
one; rows that repeat an id are documents of their own, and not copies of each other.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits 1, 2, 4, 8 for the failures A, B, C, D of a UTF-8 text."""
    words = text.split()  # of bytes: at 0x20 and 0x09-0x0D
    n, points = len(words), len(text.decode())
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return (n < 200) + 2 * (100 * len(set(words)) < 50 * n) + 4 * (100 * capitals > 3 * points) + 8 * signs


class Trie:
    """A compressed trie of byte strings. A node is [edge, least id or None, children by first byte, number of its entries]."""

    def __init__(self) -> None:
        self.root: list = [b"", None, {}, None]

    def insert(self, text: bytes, least: int) -> list:
        """The terminal of ``text``, which keeps the least of the ids it was given."""
        node, at = self.root, 0
        while at < len(text):
            child = node[2].get(text[at])
            if child is None:
                child = node[2][text[at]] = [text[at:], None, {}, None]
                node = child
                break
            edge = child[0]
            if text.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            lo, hi = 1, min(len(edge), len(text) - at)  # the first byte is equal, not all of the edge is
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if text.startswith(edge[:mid], at) else (lo, mid - 1)
            upper = node[2][text[at]] = [edge[:lo], None, {edge[lo]: child}, None]
            child[0] = edge[lo:]
            node, at = upper, at + lo
        if node[1] is None or least < node[1]:
            node[1] = least
        return node

    def terminals(self) -> Iterator[list]:
        """All nodes that end a text."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[1] is not None:
                yield node
            stack.extend(node[2].values())


_ENTRY = "key binary, text binary, doc_id long, part string, mask int, n long"
_TOLD = "doc_id long, part string, mask int, n long"
STEP, FLUSH = 4, 8 << 20


def _prefix(text: bytes, heavy: dict[int, frozenset[bytes]]) -> bytes:
    """The shortest of the counted prefixes that is not heavy."""
    size = STEP
    while size in heavy and text[:size] in heavy[size]:
        size *= 2
    return text[:size]


def heavy_prefixes(texts: DataFrame, limit: int, most: int = 1_000_000) -> tuple[dict[int, frozenset[bytes]], bool]:
    """Prefixes of 4, 8, 16, ... bytes that start over ``limit`` bytes of texts, and whether they are all.

    Texts no longer than a prefix, and a prefix that starts one text only, are not told apart by more bytes and not
    lengthened. A level has at most all bytes / ``limit`` such prefixes; from ``most`` on, no more are looked for.
    """
    spark, heavy, size, known = texts.sparkSession, {}, STEP, 0
    rows = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    while True:
        own = rows.where(F.octet_length("t") > size)
        if size > STEP:
            above = spark.createDataFrame([(bytearray(p),) for p in heavy[size // 2]], "p binary")
            own = own.join(F.broadcast(above), F.substring("t", 1, size // 2) == F.col("p"), "left_semi")  # at most ``most`` prefixes
        h = F.xxhash64("t")
        sums = own.groupBy(F.substring("t", 1, size).alias("p")).agg(F.sum(F.octet_length("t")).alias("n"), F.min(h).alias("a"), F.max(h).alias("b"))
        found = [bytes(r["p"]) for r in sums.where((F.col("n") > limit) & (F.col("a") != F.col("b"))).select("p").limit(most + 1).collect()]
        if not found:
            return heavy, True
        known += len(found)
        if known > most:
            return heavy, False
        heavy[size] = frozenset(found)
        size *= 2


def document_masks(docs: DataFrame, part: str = "lang", limit: int | None = None, most: int = 1_000_000) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail which filters, bits 1 to 16 for A to E.

    ``limit``: bytes of texts that a range may have, by default what spreads all over four ranges for each shuffle
    partition, between 64 KB and 32 MB. Where there are more than ``most`` heavy prefixes, texts are also split by a hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    limit = limit or min(32 << 20, max(64 << 10, total // (4 * parts)))
    heavy, all_found = heavy_prefixes(rows, limit, most)
    sent = spark.sparkContext.broadcast(heavy)  # at most ``most`` prefixes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local: dict[bytes, list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            out: list[tuple] = []
            settled: Counter[tuple] = Counter()  # these take no text along
            for text, (mask, least, counts) in local.items():
                key = _prefix(text, sent.value)
                for (i, p), n in counts.items():
                    if i is None or i > least:
                        settled[i, p, mask | (0 if i is None else 16)] += n
                    else:
                        out.append((key, text, i, p, mask, n))
            out += [(None, None, *told, n) for told, n in settled.items()]
            local.clear()
            return _batch(out, _ENTRY)

        for batch in batches:
            for i, p, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                entry = local.get(raw)
                if entry is None:
                    entry = local[raw] = [text_mask(raw), None, {}]
                    held += len(raw) + 300
                if i is not None and (entry[1] is None or i < entry[1]):
                    entry[1] = i
                if (i, p) not in entry[2]:
                    entry[2][i, p] = 0
                    held += 150
                entry[2][i, p] += 1
                if held > FLUSH:
                    yield flush()
                    held = 0
        yield flush()

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            sure = []
            for _, text, i, p, mask, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    sure.append((i, p, mask, n))
                    continue
                end = trie.insert(text, i)
                if end[3] is None:
                    end[3] = []
                end[3].append((i, p, mask, n))
            yield _batch(sure, _TOLD)
        out = []
        for end in trie.terminals():
            out += [(i, p, mask | 16 * (i > end[1]), n) for i, p, mask, n in end[3]]
            if len(out) > 50_000:
                yield _batch(out, _TOLD)
                out = []
        yield _batch(out, _TOLD)

    entries = rows.mapInArrow(read, _ENTRY)
    deal: list[Column] = [F.when(F.col("text").isNull(), F.xxhash64("doc_id", "part", "mask").cast("string").cast("binary")).otherwise(F.col("key"))]
    if not all_found:
        deal.append(F.pmod(F.xxhash64("text"), F.lit(max(1, total // limit))))
    dealt = entries.repartition(max(parts, min(4 * parts, -(-total // limit))), *deal)
    return dealt.mapInArrow(tries, _TOLD).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


_TYPES = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(cols, fields, strict=True)], [name for name, _ in fields])


def mask_sums(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows, and those whose id has a label quality = 1 or toxic = 1; a label of several decides once."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    own = masks.join(told, "doc_id", "left")
    lost = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0)))
    return own.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good").alias("good"), lost("toxic").alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", **settings) -> DataFrame:
    """One row for each part, order of the five filters and step, zeros included; an empty table has no parts.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley are counts of documents of the part. In the
    120 orders a document that fails f filters is removed by each of them 120 / f times: shapley adds these up.
    """
    sums = mask_sums(document_masks(docs, part, **settings), labels)
    steps = []
    for order in itertools.permutations(range(5)):
        gone = 0
        for step, f in enumerate(order, 1):
            steps.append(f"struct('{''.join(LETTERS[x] for x in order)}' AS filter_order, {step} AS step, {1 << f} AS bit, {gone} AS gone)")
            gone |= 1 << f
    each = sums.withColumn("s", F.explode(F.expr(f"array({', '.join(steps)})"))).select("part", "s.*", "mask", "n", "good", "toxic")
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("gone")) != 0
    count = lambda hit, what="n": F.sum(F.when(hit, F.col(what)).otherwise(F.lit(0))).cast("long")
    share = (F.lit(120) / F.bit_count("mask")).cast("long") * F.col("n")
    return each.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~before).alias("kept"), count(fails & ~before).alias("removed"), count(fails & before).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~before, "good").alias("good_lost"), count(fails & ~before, "toxic").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )


ORACLE = r"""
WITH t AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS x, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d
), m AS (SELECT x, min(doc_id) AS least FROM t GROUP BY x),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t.x) - length(regexp_replace(t.x, '[A-Z]', '', 'g'))) > 3 * length(t.x) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t.x, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN m.least < t.doc_id THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN m ON m.x = t.x LEFT JOIN l ON l.doc_id = t.doc_id
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, mask),
p AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM p a, p b, p c, p d, p e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x
), s AS (
  SELECT filter_order, step, letter, 1 << (ascii(letter) - 65) AS bit, CAST(coalesce(sum(1 << (ascii(letter) - 65)) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS gone
  FROM (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step))
), r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & gone <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
