"""Readers and writers of files: JSON lines, CSV folders of differing columns, saved pages, versioned tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema, so that nothing is read twice to infer one. Lines that aren't JSON become rows of nulls."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv_folders(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """CSV files with a header and differing columns, in the order of their paths, as text.

    ``columns`` stay columns, missing ones empty; all others go into the map ``extras``. ``origin`` is the folder or file.
    """

    def one(path: str) -> DataFrame:
        df = spark.read.option("header", True).csv(path)
        known = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
        other = [c for c in df.columns if c not in columns]
        pairs = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in other]
        extras = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
        return df.select(*known, extras.alias("extras"), F.lit(path).alias("origin"))

    return reduce(DataFrame.unionByName, map(one, sorted(paths)))


def write_csv(df: DataFrame, path: str, preferred: list[str]) -> None:
    """CSV with a header: preferred columns first, the others by name."""
    order = [c for c in preferred if c in df.columns] + sorted(c for c in df.columns if c not in preferred)
    df.select(*order).write.mode("overwrite").option("header", True).csv(path)


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below ``path`` whose name matches."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def saved_pages(files: DataFrame) -> DataFrame:
    """(path, source, downloaded, body) of saved pages: header lines, a rule of three dashes, the body."""
    text = F.decode("content", "UTF-8")
    head, body = F.regexp_extract(text, r"(?s)^(.*?)\n---\n", 1), F.regexp_replace(text, r"(?s)^.*?\n---\n", "")
    return files.select("path", F.regexp_extract(head, r"(?m)^Source:\s*(\S+)", 1).alias("source"), F.regexp_extract(head, r"(?m)^Downloaded:\s*(\S+)", 1).alias("downloaded"), F.trim(body).alias("body"))


def publish(df: DataFrame, root: str) -> str:
    """Writes a new version beside the others and then names it the current one; readers never see a half-written table.

    An empty table isn't published: the version before stays current.
    """
    spark, version = df.sparkSession, f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    if spark.read.schema(df.schema).parquet(version).isEmpty():
        return current(spark, root)
    number = 1 + max((n for n, _ in _named(spark, root)), default=0)
    # A folder of its own for each number: where two writers take the same one, the second fails instead of hiding the first.
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("error").json(f"{root}/current/{number:012d}")
    return version


def _named(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of the versions named so far: a row for each publishing."""
    found = read_or_none(spark, f"{root}/current", "number long, version string")
    return [] if found is None else [(r.number, r.version) for r in found.orderBy(F.desc("number")).limit(1).collect()]


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON lines of all folders below ``path``, None if it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def current(spark: SparkSession, root: str) -> str:
    """The path of the version with the greatest number."""
    return _named(spark, root)[0][1]


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
