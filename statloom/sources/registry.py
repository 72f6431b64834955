"""Versions of fitted parameters: tables, Spark ML pipelines and boosted models, entered together by one write.

A version's files are written to a folder of its own that nothing refers to; then one row enters it in the manifest, a
single file that a rename makes visible. A reader goes by the manifest alone, so what was written in part, or by an attempt that
failed, is never read. Models that weren't chosen can be kept in an archive, which readers leave out unless they ask.
A version holds the fingerprint of the data that it was fitted on.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting

_ENTRY = "version string, at timestamp, path string, tables array<string>, models array<struct<name:string,kind:string,archived:boolean>>, facts map<string,long>"


@dataclass
class Version:
    """What a version holds; tables are read lazily."""

    name: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, object] = field(default_factory=dict)
    facts: dict[str, int] = field(default_factory=dict)


def fingerprint(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Row counts of the tables by name: one aggregate each, a number each in the driver."""
    return {name: df.count() for name, df in sorted(tables.items())}


def _write(spark: SparkSession, model: object, path: str) -> str:
    if isinstance(model, boosting.Boosted):
        spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.parquet(path)
        return "boosted"
    model.write().save(path)
    return "pipeline"


def _read(spark: SparkSession, kind: str, path: str) -> object:
    return boosting.Boosted.from_json(spark.read.parquet(path).first()["model"]) if kind == "boosted" else PipelineModel.load(path)


def save(spark: SparkSession, folder: str, version: str, tables: Mapping[str, DataFrame], models: Mapping[str, object] | None = None, archived: Sequence[str] = (), facts: Mapping[str, int] | None = None) -> None:
    """Enter a version; a version saved again replaces its former entry. archived: names of models that go to the archive."""
    path = f"{folder}/versions/{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/tables/{name}")
    made = [(name, _write(spark, model, f"{path}/{'archive' if name in archived else 'models'}/{name}"), name in archived) for name, model in (models or {}).items()]
    entry = spark.createDataFrame([(version, None, path, list(tables), made, dict(facts or {}))], _ENTRY).withColumn("at", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, the newest entry of each version."""
    m = spark.read.schema(_ENTRY).parquet(f"{folder}/manifest")
    return m.groupBy("version").agg(F.max_by(F.struct(*m.columns), F.struct("at", "path")).alias("e")).select("e.*")


def load(spark: SparkSession, folder: str, version: str | None = None, facts: Mapping[str, int] | None = None, archive: bool = False) -> Version:
    """A version: the named one, or the newest, of those fitted on data with the fingerprint `facts` where it is given.

    ValueError where there is none.
    """
    m = entries(spark, folder)
    if version is not None:
        m = m.where(F.col("version") == version)
    rows = m.orderBy(F.desc("at"), F.desc("version")).collect()  # a row a version
    rows = [r for r in rows if facts is None or r["facts"] == dict(facts)]
    if not rows:
        raise ValueError(f"{folder}: no version {version or ''} of these facts")
    r = rows[0]
    tables = {n: spark.read.parquet(f"{r['path']}/tables/{n}") for n in r["tables"]}
    models = {x["name"]: _read(spark, x["kind"], f"{r['path']}/{'archive' if x['archived'] else 'models'}/{x['name']}") for x in r["models"] if archive or not x["archived"]}
    return Version(r["version"], tables, models, dict(r["facts"]))
