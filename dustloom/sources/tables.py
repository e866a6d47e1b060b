"""Tables that grow file by file: buckets in numbered versions, a log of what is valid, and merges that touch their buckets alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustloom.session import written

LOG = "bucket string, number long, version string"


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _rows(log: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the newest version of each bucket in log, with bucket and version."""
    newest = log.groupBy("bucket").agg(F.max_by("version", "number").alias("version"))
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.StringType()), T.StructField("version", T.StringType())])
    return log.sparkSession.read.schema(whole).parquet(f"{path}/rows").join(newest, ["bucket", "version"])


def read_merged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as of now; empty before the first merge."""
    log = _log(spark, path)
    return spark.createDataFrame([], schema) if log.isEmpty() else _rows(log, path, schema).select(*schema.names)


def merge_into(new: DataFrame, path: str, bucket: Column, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Adds rows to a table so that it is what merge makes of all rows that were ever added.

    bucket is of the rows' keys, so that what merge puts together lies in one bucket, and holds for merge's rows too, which have
    the columns of new. merge(merge(a) and b) must be merge(a and b). Only buckets that new has rows of are read and written
    again, as a new version; it becomes valid when it is in the log, which is one small file written last. So readers
    keep what they began to read, and a merge that failed on the way is as if it had not been. One job writes at a time.
    """
    spark = new.sparkSession
    log = _log(spark, path)
    number, version = (log.agg(F.max("number")).first()[0] or 0) + 1, uuid.uuid4().hex
    name = F.coalesce(bucket.cast("string"), F.lit("-")).alias("bucket")
    touched = written(new.select(name).distinct(), "touched")
    every = new if number == 1 else _rows(log.join(touched, "bucket", "left_semi"), path, new.schema).select(*new.columns).unionByName(new)
    out = merge(every).select(*new.columns, name, F.lit(version).alias("version"))
    out.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/rows")
    touched.select("bucket", F.lit(number).cast("long").alias("number"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/log")
