"""Tables written between the steps of one operator.

They cut lineage: a lost executor costs a reread, not the steps before. They go
to the shared folder that ``spark.checkpoint.dir`` names; where it is unset and all
of Spark is one local process (tests), a temporary folder takes its place. On a
cluster it must be set. The tables stay until the folder's owner clears it, as a
result is read lazily.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder for intermediate tables, as a URI or path that Spark can write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="spark-statloom-"))
    return _FALLBACK[0]


def folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below root()."""
    return f"{root(spark)}/statloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
