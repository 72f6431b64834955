"""Connected components by label propagation with shortcuts.

Every node starts with the smallest id among itself and its neighbours; each round takes
the neighbours' smallest label and then the label's own label. Rounds are cut from their
lineage by a reliable checkpoint where the session names a folder for it.
"""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage. A session without a checkpoint folder gets one where all of Spark is one local process."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the nodes of edges (a, b) whose component has a smaller id."""
    both = _cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root"))
    seen = None
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("n"))
        step = label.join(near, "id", "left").select("id", F.least("root", F.coalesce("n", "root")).alias("r"))
        jump = step.select(F.col("id").alias("r"), F.col("r").alias("rr"))
        label = _cut(step.join(jump, "r", "left").select("id", F.least("r", F.coalesce("rr", "r")).alias("root")))
        state = label.agg(F.sum(F.col("root").cast("decimal(38,0)")), F.count("*")).first()
        if state == seen:
            return label.where("root < id")
        seen = state


def sides(meetings: DataFrame, seed: int, least: int = 3, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """(season, team, side): "seed" for the teams linked with the seed team, "other" for the rest; meetings is (season, a, b), both ways.

    Teams that met `least` times are linked, over any number of links. Where that takes in fewer than a share `low` of a
    season's teams, or more than `high`, half of the teams join the seed one after the other, by their mean number of games
    against those that joined already. A season's table has a row a pair of teams, so it is small.
    """

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        games = frame.pivot_table(index="a", columns="b", values="n", aggfunc="sum", fill_value=0)
        teams = sorted(set(frame["a"]))
        games = games.reindex(index=teams, columns=teams, fill_value=0)
        linked = games >= least
        own, size = {seed}, 0
        while len(own) > size:
            size = len(own)
            own |= {t for t in teams if linked.loc[t, [x for x in teams if x in own]].any()}
        if not low * len(teams) <= len(own) <= high * len(teams):
            own = {seed}
            while len(own) < len(teams) // 2:
                rest = games.loc[[t for t in teams if t not in own], [t for t in teams if t in own]]
                own.add(rest.mean(axis=1).idxmax() if rest.shape[1] else rest.index[0])
        season = frame["season"].iloc[0]
        return pd.DataFrame({"season": season, "team": teams, "side": ["seed" if t in own else "other" for t in teams]})

    pairs = meetings.groupBy("season", "a", "b").agg(F.count("*").alias("n"))
    return pairs.groupBy("season").applyInPandas(split, "season long, team long, side string")
