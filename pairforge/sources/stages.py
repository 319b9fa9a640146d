"""Relational sources and stages that are written once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Explicit schemas of the relational tables.
PRINTS = "print_id long, iso_id string, region string, is_erroneous boolean"
Z_LONG = "print_id long, position int, z double"
REGIONS = "region string, disp_count int"


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read by `parts` tasks that share the range of `column`."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.options(**options).load()


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stage_path(folder: str, name: str, **parameters: object) -> str:
    """The parameters are part of the path, so other parameters are another stage; so are other inputs, if their fingerprint is one of them."""
    return "/".join([folder.rstrip("/"), name, *(f"{k}={v}" for k, v in sorted(parameters.items()))])


def fingerprint(*tables: DataFrame) -> str:
    """What tells inputs apart: their schemas, and the paths, sizes and times of their files; of tables without files (a database, rows of the session) the number of rows and the sum of
    their hashes, which costs one pass. A filter or another query over the same files does not count: give tables as they were read."""
    spark, out = tables[0].sparkSession, hashlib.sha256()
    for df in tables:
        out.update(df.schema.json().encode())
        files = df.inputFiles()
        for name in sorted(files):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
            out.update(f"{name}:{status.getLen()}:{status.getModificationTime()};".encode())
        if not files:
            own = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)").alias("h"))
            out.update(str(own.agg(F.count("*"), F.sum("h")).first()).encode())
    return out.hexdigest()[:16]


def load_or_compute(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What is stored at path; made and stored there first if nothing is. What a failed attempt left there is overwritten."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
