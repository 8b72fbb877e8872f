"""Tables in buckets by a hash of their key: a merge rewrites the buckets that it changes and leaves the files of all others."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
BUCKET = "bucket"


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, target: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The table's rows, or those of some buckets, whose folders alone are read; empty where there is no table."""
    system, at = file_system(spark, target)
    if not system.exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {BUCKET} int").parquet(target)
    return (rows if only is None else rows.filter(F.col(BUCKET).isin(only))).drop(BUCKET)


def merge(spark: SparkSession, target: str, schema: str, key: str, changed: DataFrame, gone: DataFrame, work: str, buckets: int = BUCKETS) -> list[int]:
    """Puts changed rows in (a row whose key is there already is replaced) and takes the keys of gone out. Gives the buckets that were written.

    New buckets are written to work first and then renamed into place, one by one: a reader finds each bucket as it was or as it is.
    A merge that breaks off leaves whole buckets, and running it again completes it.
    """
    keys = changed.select(key).unionByName(gone.select(key)).distinct()
    touched = sorted(r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().collect())  # buckets at most
    if not touched:
        return []
    kept = read_buckets(spark, target, schema, touched).join(keys, key, "left_anti")
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    rows = kept.select(*columns).unionByName(changed.select(*columns)).withColumn(BUCKET, bucket_of(F.col(key), buckets))
    fresh = f"{work.rstrip('/')}/merge-{uuid.uuid4().hex}"
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(fresh)
    system, there = file_system(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system.mkdirs(there)
    for b in touched:
        new, now, old = path(f"{fresh}/{BUCKET}={b}"), path(f"{target}/{BUCKET}={b}"), path(f"{fresh}/old-{b}")
        if system.exists(now):
            system.rename(now, old)
        if system.exists(new):
            system.rename(new, now)
    system.delete(path(fresh), True)
    return touched
