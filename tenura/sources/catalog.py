"""Named raw tables, schema checks, layer tables and keyed lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.config import SCHEMAS
from tenura.errors import DataError

# Accepted Spark types per declared type.
_TYPES = {"string": {"string"}, "bool": {"boolean"}, "int64": {"bigint", "int", "smallint", "tinyint"},
          "float64": {"double", "float"}}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system of the path itself, so object stores and HDFS work as local files do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_raw(spark: SparkSession, name: str, paths: Mapping[str, str]) -> DataFrame:
    if name not in paths:
        raise DataError(f"unknown table {name!r}; known: {sorted(paths)}")
    if not path_exists(spark, paths[name]):
        raise DataError(f"no data for table {name!r} at {paths[name]}")
    return spark.read.parquet(paths[name])


def schema_problems(df: DataFrame, columns: Mapping[str, str]) -> list[str]:
    """Missing columns and wrong types, all of them; extra columns are fine. Reads no data."""
    have = dict(df.dtypes)
    found = [f"missing column {c}" for c in columns if c not in have]
    for c, declared in columns.items():
        if c in have and have[c] not in _TYPES.get(declared, {declared}):
            if declared == "float64" and have[c] in _TYPES["int64"]:
                continue  # a widening Spark makes without loss of meaning
            found.append(f"column {c} is {have[c]}, declared {declared}")
    return found


def validate_schema(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    problems = schema_problems(df, columns)
    if problems:
        raise DataError("; ".join(problems))
    return df


def load_bronze(spark: SparkSession, name: str, paths: Mapping[str, str], schemas: Mapping = SCHEMAS) -> DataFrame:
    return validate_schema(load_raw(spark, name, paths), schemas[name])


def first_existing(spark: SparkSession, name: str, folders: Sequence[str]) -> DataFrame:
    """The table from the first folder that has it, decided per table."""
    for folder in folders:
        for path in (f"{folder}/{name}", f"{folder}/{name}.parquet"):
            if path_exists(spark, path):
                return spark.read.parquet(path)
    raise DataError(f"table {name!r} is in none of {list(folders)}")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """At most one row of a keyed table; the key test reaches the file scan."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def lookup_one(df: DataFrame, key: str, value):
    row = lookup(df, key, value).first()
    if row is None:
        raise DataError(f"{key}={value!r} not found")
    return row


def lookup_many(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def write_layer(df: DataFrame, path: str, partition_by: Sequence[str] = (), append: bool = False) -> None:
    """Bronze appends, silver and gold are replaced; pass date or location columns to partition by."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before work that is heavy per row, such as regular
    expressions over long texts. A table with enough files or row groups is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
