"""Sessions, and the package on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; conf keys use __ for dots."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("statloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of a running session, once, so that functions can import it there."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        made = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "statloom_pkg.zip")
        with zipfile.ZipFile(made, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        sc.addPyFile(made)
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that `spark.checkpoint.dir` names, which all executors reach; a temporary one in local mode without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/statloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """df written to a new folder in the shared one and read back, so that a lost executor costs a reread.

    large: rows of megabytes, of which writer and reader hold some and not a hundred or more.
    """
    path = shared_folder(df.sparkSession, name)
    how = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)} if large else {}
    df.write.options(**how).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
