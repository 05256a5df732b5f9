"""File sources and sinks: JSON collections, append-only logs, directory scans, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_collection(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files that hold a JSON array, or an object of records by id."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", T.ArrayType(schema))
    mapped = F.map_values(F.from_json("value", T.MapType(T.StringType(), schema)))
    is_list = F.rlike(F.ltrim("value"), F.lit(r"^\["))
    return whole.select(F.explode(F.when(is_list, listed).otherwise(mapped)).alias("r")).select("r.*")


def read_log(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """A log of JSON lines; bad lines are dropped, or fatal if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_snapshot(rows: DataFrame, path: str, version: int) -> str:
    """A new version beside the old ones: readers see all of it or none (its success marker)."""
    target = f"{path}/version={version:012d}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version, by default the latest."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).drop("version")


def scan_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 512 * 1024, preview: int = 24 * 1024) -> DataFrame:
    """Files below a folder with size and the beginning of their text; larger files are listed without it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.when(F.col("length") <= max_bytes, F.decode(F.substring("content", 1, preview), "UTF-8"))
    return files.select("path", "length", "modificationTime", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension"), text.alias("preview"))


def gauges(rows: DataFrame, prefix: str) -> DataFrame:
    """Columns ``name, value`` as lines of a metrics text."""
    return rows.select(F.concat_ws(" ", F.concat(F.lit(prefix + "_"), "name"), F.col("value").cast("string")).alias("line"))


def last_rows(rows: DataFrame, key: str, position: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key by position."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return rows.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")
