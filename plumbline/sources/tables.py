"""Reading and writing keyed tables.

Writers never overwrite. Hashes are SHA-256 over file contents or over rows in key order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import loadable, task_files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; scans read only the columns and row groups a query needs."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header and a declared schema; a null in a required column fails the query that reads it."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df


def split_union(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of several splits with a ``split`` column; columns are matched by name."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Task records, one multi-line JSON file each, with the file's name as ``task``."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.withColumn("task", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def lookup_one(registry: DataFrame, **keys: object) -> DataFrame:
    """The single record with these values; none or several is an error when the result is read."""
    hit = registry.where(F.lit(True))
    for k, v in keys.items():
        hit = hit.where(F.col(k).eqNullSafe(F.lit(v)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*[F.col(k) for k in keys]))
    found = hit.withColumn("_n", n)
    return found.where(F.assert_true(F.col("_n") == 1, F.lit(f"not exactly one record for {keys}")).isNull()).drop("_n")


_PLAIN = "/:@"  # other characters of a path are escaped in a URI


def _hashed(batches: Iterator[pa.RecordBatch], piece: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the files (path, length), a piece in memory at a time."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            store, at = task_files(quote(path, safe=_PLAIN))
            digest, data = hashlib.sha256(), bytearray(piece)
            with store.open_input_file(at) as file:
                while n := file.readinto(data):
                    digest.update(memoryview(data)[:n])
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["path", "length", "sha256"])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, size and SHA-256 of each entry that a pattern of a folder names, such as ``folder/*.parquet``.

    A file is hashed by its content. An entry that is a folder has the size of all files below it, and the SHA-256 of their
    names and SHA-256, in order of their names. Tasks read files piece by piece where Python can open them; in other stores a
    file is one binaryFile row, so that it must be below 2 GB and is held in memory.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    inner = F.split(F.substring(F.col("path"), len(root) + 2, 1 << 30), "/", 2)  # entry, and the name below it
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if loadable(quote(root, safe=_PLAIN)):
        files = files.select("path", "length").mapInArrow(_hashed, "path string, length long, sha256 string")
    else:
        files = files.withColumn("sha256", F.sha2("content", 256))
    each = files.select(inner[0].alias("name"), F.get(inner, F.lit(1)).alias("below"), F.col("length").alias("size"), "sha256")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "below", "sha256"))), "\n")  # a line for each file of a table
    whole = F.when(F.max("below").isNull(), F.max("sha256")).otherwise(F.sha2(lines.cast("binary"), 256))
    return each.groupBy("name").agg(F.sum("size").alias("size"), whole.alias("sha256"))


def manifest_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (name, fault) of a manifest (name, size, sha256) that the files don't match: missing, size or hash."""
    f = files.select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"))
    fault = F.when(F.col("_size").isNull(), "missing").when(F.col("size") != F.col("_size"), "size").when(F.col("sha256") != F.col("_sha256"), "hash")
    return manifest.join(f, "name", "left").select("name", fault.alias("fault")).where("fault IS NOT NULL")


def write_new(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a table where nothing is yet."""
    df.write.mode("errorifexists").format(form).option("header", True).save(path)


def table_digest(df: DataFrame) -> DataFrame:
    """One row (content, rows): a hash of all rows in any order, with how often each occurs."""
    each = df.select(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("h"))
    sums = each.agg(F.coalesce(F.sum("h"), F.lit(0)).alias("h"), F.count(F.lit(1)).alias("rows"))
    return sums.select(F.sha2(F.concat_ws("|", "h", "rows").cast("binary"), 256).alias("content"), "rows")


def write_features(df: DataFrame, path: str, names: list[str], inputs: DataFrame | None = None) -> None:
    """A feature table (row_id, values, and y if it has one) and beside it one row of names, width, content hash and the hash of its inputs."""
    columns = ["row_id", "values", *(["y"] if "y" in df.columns else [])]
    write_new(df.select(*columns), f"{path}/matrix")
    row = table_digest(df.select(*columns)).select("content", "rows", F.lit(len(names)).alias("width"), F.array(*map(F.lit, names)).alias("names"), F.lit("y" in df.columns).alias("has_y"))
    if inputs is not None:
        row = row.join(F.broadcast(table_digest(inputs).select(F.col("content").alias("inputs"))), F.lit(True))  # one row
    write_new(row, f"{path}/schema", "json")


def check_features(spark: SparkSession, path: str, inputs: DataFrame | None = None) -> DataFrame:
    """The matrix of :func:`write_features`; ValueError where its rows, or the inputs, are not those of its schema."""
    record, df = spark.read.json(f"{path}/schema").collect()[0], spark.read.parquet(f"{path}/matrix")
    if table_digest(df).collect()[0]["content"] != record["content"]:
        raise ValueError(f"the matrix of {path} differs from its schema")
    if inputs is not None and table_digest(inputs).collect()[0]["content"] != record["inputs"]:
        raise ValueError(f"{path} was made from other inputs")
    return df


def split_blocks(spark: SparkSession, folder: str, name: str, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """One block's tables <split>_<name>.parquet of all splits with a ``split`` column; ValueError names those that are missing."""
    found, missing = {}, []
    for s in splits:
        try:
            found[s] = spark.read.parquet(f"{folder}/{s}_{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(f"{s}_{name}.parquet")
    if missing:
        raise ValueError(f"missing under {folder}: {missing}")
    return split_union(found)


def write_history(history: DataFrame, meta: dict, path: str) -> None:
    """A run's epochs as JSON lines in their order, and its settings and metrics as one JSON record; nothing is overwritten."""
    write_new(history.orderBy("epoch").coalesce(1), f"{path}/history", "json")  # a row for each epoch
    row = history.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string")
    write_new(row.coalesce(1), f"{path}/meta", "text")
