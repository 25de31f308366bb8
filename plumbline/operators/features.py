"""Text fingerprints and feature blocks: hashed count and presence vectors, stand-ins for chemical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket_of, is_finite
from .orderstats import exact_percentile
from .ranks import joined_back

WORD = r"[^\x20\x09-\x0D]+"

def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def with_words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ws): the words as a column of their own, so that functions over their positions don't split the text again."""
    return df.select(key, F.inline(F.array(F.struct(words(F.col(text)).alias("ws")))))


def grams(ws: Column, n: int) -> Column:
    """Word n-grams joined by one space; the order n plays the part of a radius."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))


def skip_pairs(ws: Column, gap: int) -> Column:
    """Pairs of words ``gap`` apart."""
    return F.when(F.size(ws) > gap, F.transform(F.sequence(F.lit(1), F.size(ws) - gap), lambda i: F.concat(F.element_at(ws, i), F.lit(f"~{gap}~"), F.element_at(ws, i + gap)))).otherwise(F.array().cast("array<string>"))


def hashed_counts(df: DataFrame, key: str, tokens: Column, width: int) -> DataFrame:
    """Sparse counts (key, bucket, n) of hashed tokens."""
    each = df.select(key, F.explode(tokens).alias("token"))
    return each.select(key, bucket_of(F.col("token"), width).alias("bucket")).groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))


def dense(counts: DataFrame, key: str, width: int, presence: bool = False) -> DataFrame:
    """(key, values): an array of ``width`` floats from sparse counts; rows without counts have to be added by the caller."""
    packed = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "n"))).alias("m"))
    value = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("float")
    return packed.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(value(i) > 0, F.lit(1.0).cast("float")).otherwise(F.lit(0.0).cast("float")) if presence else value(i)).alias("values"))


def presence(df: DataFrame, key: str, tokens: Column, width: int) -> DataFrame:
    """(key, bits): the buckets that a key's tokens fall into, ascending; keys without tokens have to be added by the caller.

    Each task joins the buckets of its tokens into longs of 64 bits, so that what is shuffled is a row for each key.
    """
    each = df.select(key, F.explode(F.array_distinct(tokens)).alias("token")).select(key, bucket_of(F.col("token"), width).alias("_b"))
    cells = range(-(-width // 64))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_b", F.lit(64)).cast("int"))
    got = each.groupBy(key).agg(*[F.bit_or(F.when(F.floor(F.col("_b") / 64) == k, mask).otherwise(F.lit(0).cast("long"))).alias(f"_m{k}") for k in cells])
    on = lambda k: lambda i: F.call_function("getbit", F.col(f"_m{k}"), i - 64 * k) == 1
    parts = [F.filter(F.sequence(F.lit(64 * k), F.lit(min(width, 64 * k + 64) - 1)), on(k)) for k in cells]
    return got.select(key, F.concat(*parts).alias("bits"))


def text_descriptors(text: Column) -> list[Column]:
    """Named descriptors in a fixed order."""
    n = F.length(text)
    return [
        n.alias("n_chars"), F.size(words(text)).alias("n_words"), F.size(F.array_distinct(words(text))).alias("n_distinct"),
        F.regexp_count(text, F.lit("[0-9]")).alias("n_digits"), F.regexp_count(text, F.lit("[A-Z]")).alias("n_upper"), F.regexp_count(text, F.lit("\n")).alias("n_lines"),
    ]


def column_names(blocks: DataFrame) -> DataFrame:
    """(name, idx): prefix.i for each column of the blocks (pos, prefix, width), numbered in the order of pos."""
    start = F.sum("width").over(Window.partitionBy(F.lit(1)).orderBy("pos")) - F.col("width")  # a row for each block
    each = blocks.withColumn("_start", start).where("width > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)))
    return each.select(F.concat_ws(".", "prefix", F.col("_i").cast("string")).alias("name"), (F.col("_start") + F.col("_i")).cast("int").alias("idx"))


def parse_profile(block: Column, family: Column) -> list[Column]:
    """profile, candidate and base_prediction from the names of a feature block and its family.

    The block's prefix says whether an embedding goes first; its candidate is the family without the version prefix.
    """
    bare = F.regexp_replace(block, "^(embed_chem_|chem_)", "")
    return [
        F.regexp_replace(bare, "_base_pred$", "").alias("profile"),
        F.when(F.startswith(block, F.lit("embed_chem_")), F.regexp_replace(family, "^xl_v4_", "")).alias("candidate"),
        F.endswith(bare, F.lit("_base_pred")).alias("base_prediction"),
    ]


# Fixed values of the recorded profiles: blocks in order with their widths, and the blocks of the embedding candidates.
CORE = [("morgan_count_r2", 1024), ("avalon_count", 1024), ("erg", 315), ("rdkit", 200)]
STANDARD = {
    "core_maccs_fcfp": [("maccs", 167), ("fcfp_count_r2", 1024)],
    "core_pair_torsion": [("atom_pair_count", 1024), ("torsion_count", 1024)],
    "core_path": [("rdkit_path", 1024)],
    "wide_chem": [("maccs", 167), ("morgan_count_r3", 1024), ("fcfp_count_r2", 1024), ("atom_pair_count", 1024), ("torsion_count", 1024), ("rdkit_path", 1024)],
}
XL_MORGAN = [("morgan_count_r1", 2048), ("morgan_count_r2", 2048), ("morgan_count_r3", 2048), ("fcfp_count_r2", 2048), ("fcfp_count_r3", 2048)]
XL_TOPOLOGY = [("atom_pair_count", 2048), ("torsion_count", 2048), ("rdkit_path", 2048), ("layered", 2048), ("pattern", 2048)]
SINGLE = {"descriptors": 3, "morgan1024": 0, "avalon1024": 1, "erg": 2}
CANDIDATES = {
    "chemberta": "C", "kpgt": "K", "ept": "E", "chemberta_kpgt": "CK", "chemberta_ept": "CE", "kpgt_ept": "KE", "chemberta_kpgt_ept_gated": "CKE",
}
MASKS = {"all": "CKE", "chemberta": "C", "kpgt": "K", "ept": "E", "chemberta_kpgt": "CK", "ept_kpgt": "KE", "chemberta_ept": "CE"}


def profile_blocks(profile: str) -> list[tuple[str, int]]:
    """The blocks (prefix, width) of a profile in order; an unknown profile is an error."""
    if profile == "core":
        return CORE
    if profile in SINGLE:
        return [CORE[SINGLE[profile]]]
    if profile in STANDARD:
        return CORE + STANDARD[profile]
    large = {"xl_morgan_family": XL_MORGAN, "xl_topology_family": XL_TOPOLOGY, "xl_full_chemical_prior": XL_MORGAN + XL_TOPOLOGY}
    if profile not in large:
        raise ValueError(f"unknown profile {profile}")
    return CORE + [(f"xl.{p}", n) for p, n in [("maccs", 167), *large[profile]]]


def assembled(blocks: dict[str, Column], order: list[str], embedding: Column | None = None, base: Column | None = None) -> Column:
    """One array: the embedding first, the blocks in order, the base prediction last; a missing block is an error."""
    if missing := [b for b in order if b not in blocks]:
        raise ValueError(f"missing blocks: {missing}")
    parts = [embedding] if embedding is not None else []
    parts += [blocks[b] for b in order]
    return F.concat(*parts, *([F.array(base.cast("float"))] if base is not None else []))


def candidate_blocks(candidate: str) -> list[str]:
    """The embedding blocks of a candidate in order; an unknown one is an error."""
    if candidate not in CANDIDATES:
        raise ValueError(f"unknown candidate {candidate}")
    return list(CANDIDATES[candidate])


def modality_mask(name: str) -> tuple[bool, bool, bool]:
    """Which of the blocks C, K, E a named mask leaves on; an unknown name is an error."""
    if name not in MASKS:
        raise ValueError(f"unknown modalities {name}")
    return tuple(b in MASKS[name] for b in "CKE")


def masked_blocks(blocks: list[tuple[Column, int]], on: tuple[bool, ...]) -> Column:
    """All blocks (array, width) in one array, zeros where a block is off; all off is an error."""
    if not any(on):
        raise ValueError("at least one modality must be on")
    return F.concat(*[x if o else F.array_repeat(F.lit(0.0).cast("float"), n) for (x, n), o in zip(blocks, on, strict=True)])


def token_classes(ws: Column) -> Column:
    """The class of each word: digits (d), upper case first (U), letters (l), others (o)."""
    kind = lambda w: F.when(w.rlike("^[0-9]+$"), "d").when(w.rlike("^[A-Z]"), "U").when(w.rlike("^[a-z]+$"), "l").otherwise("o")
    return F.transform(ws, kind)


def group_key(key: Column, raw: Column) -> Column:
    """A group key; rows without one are groups of their own, by their raw value."""
    return F.coalesce(key, F.concat(F.lit("invalid::"), raw))


def clip_and_standardize(df: DataFrame, values: str, train: Column, q: float = 0.999, bounds: tuple[float, float] = (50.0, 1e4)) -> DataFrame:
    """Clip values at the training rows' absolute ``q`` percentile, held within ``bounds``, then standardise each column.

    Mean and population deviation come from training rows only; deviations below 1e-6 count as 1. Long output: row_id,
    idx, z. What is broadcast is one limit and a row for each column.
    """
    long = df.select("row_id", train.alias("_train"), F.posexplode(values).alias("idx", "x")).withColumn("x", F.col("x").cast("double"))
    limit = high_percentile(long.where("_train").select(F.abs("x").alias("x")), "x", q)
    limit = limit.select(F.least(F.lit(bounds[1]), F.greatest(F.lit(bounds[0]), F.col("p"))).alias("_limit"))
    cut = long.crossJoin(F.broadcast(limit)).withColumn("x", F.greatest(-F.col("_limit"), F.least(F.col("_limit"), F.col("x"))))  # one row
    mean = cut.where("_train").groupBy("idx").agg(F.avg("x").alias("_m"))
    both = cut.join(F.broadcast(mean), "idx")
    sd = both.where("_train").groupBy("idx").agg(F.sqrt(F.avg((F.col("x") - F.col("_m")) ** 2)).alias("_s"))
    out = both.join(F.broadcast(sd), "idx")
    return out.select("row_id", "idx", ((F.col("x") - F.col("_m")) / F.when(F.col("_s") < 1e-6, 1.0).otherwise(F.col("_s"))).alias("z"))


def high_percentile(df: DataFrame, x: str, q: float) -> DataFrame:
    """One row ``p``: the exact, interpolated ``q`` percentile of a column; null where there are no values."""
    return exact_percentile(df, x, [], q).agg(F.max("p").alias("p"))


def median_impute(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Nulls and NaN become the exact median of the keys' other values; a column without any stays null.

    The medians are found by refined histograms and joined back to the rows.
    """
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), clean[c].cast("double").alias("x")) for c in cols]))
    found = exact_percentile(df.select(*keys, cells.alias("_c")).select(*keys, F.col("_c.col").alias("_col"), F.col("_c.x").alias("_x")), "_x", [*keys, "_col"], 0.5)
    medians = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_col") == c, F.col("p"))).alias(f"_m_{c}") for c in cols])
    out = joined_back(df, medians, keys)
    return out.withColumns({c: F.coalesce(clean[c], F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def standardized_labels(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Adds label_mean, label_std (population, + 1e-8, of the finite labels; 0 and 1 where there are none) and z."""
    y = F.when(is_finite(F.col(label)), F.col(label))
    stats = df.groupBy(*keys).agg(F.coalesce(F.avg(y), F.lit(0.0)).alias("label_mean"), F.coalesce(F.stddev_pop(y) + 1e-8, F.lit(1.0)).alias("label_std"))
    return joined_back(df, stats, keys).withColumn("z", (F.col(label) - F.col("label_mean")) / F.col("label_std"))
