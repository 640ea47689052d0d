"""Counterfactual replay of logged turns: what would another threshold, or another k, have kept and lost?

Only what was injected has an outcome; what a policy would have added counts as unknown. Candidates are ranked once by
a window over their turn; a grid of policies then is a join with a few rows, and all counts are one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _counts(cells: DataFrame, key: str, turns: DataFrame) -> DataFrame:
    inj, out, would = F.col("injected"), F.col("outcome"), F.col("would")
    agg = cells.groupBy(key).agg(
        F.count_if(inj & (out == "referenced") & would).alias("kept_ref"), F.count_if(inj & (out == "referenced") & ~would).alias("lost_ref"),
        F.count_if(inj & (out == "ignored") & would).alias("kept_ign"), F.count_if(inj & (out == "ignored") & ~would).alias("cut_ign"),
        F.count_if(~inj & would).alias("unknown"), F.coalesce(F.sum(F.when(would, F.col("tokens"))), F.lit(0)).alias("tokens_kept"))
    return agg.crossJoin(F.broadcast(turns)).withColumn("tok_per_turn", F.round(F.col("tokens_kept") / F.greatest("n_turns", F.lit(1)), 6)).drop("n_turns", "tokens_kept")


def _turns(c: DataFrame) -> DataFrame:
    return c.select("session_id", "line_no").distinct().agg(F.count("*").alias("n_turns"))


def _ranked(c: DataFrame) -> DataFrame:
    return c.withColumn("rank", F.row_number().over(W.partitionBy("session_id", "line_no").orderBy(F.desc("score"), "memory_id")))


def replay_threshold(c: DataFrame, k: int, current: float) -> DataFrame:
    """One row of counts for each threshold 0.05 .. 0.95 and the current one.

    Scores descend with rank, so the first k above a threshold are those of rank k at most.
    """
    grid = c.sparkSession.createDataFrame([(t,) for t in sorted({round(0.05 * i, 2) for i in range(1, 20)} | {round(current, 2)})], "theta double")
    cells = _ranked(c).crossJoin(F.broadcast(grid)).withColumn("would", (F.col("score") >= F.col("theta")) & (F.col("rank") <= k))
    return _counts(cells, "theta", _turns(c))


def recommend_threshold(rows: DataFrame, current: float) -> DataFrame:
    """The highest threshold that loses nothing that was referenced, else the current one."""
    return rows.agg(F.coalesce(F.max(F.when(F.col("lost_ref") == 0, F.col("theta"))), F.lit(float(current))).alias("theta"))


def replay_k(c: DataFrame, theta: float, current: int) -> DataFrame:
    """One row of counts for each k from 1 to one above the current."""
    grid = c.sparkSession.range(1, current + 2).select(F.col("id").alias("k"))
    cells = _ranked(c).crossJoin(F.broadcast(grid)).withColumn("would", (F.col("score") >= theta) & (F.col("rank") <= F.col("k")))
    return _counts(cells, "k", _turns(c))


def recommend_k(rows: DataFrame, current: int) -> DataFrame:
    """The lowest k up to the current one that loses nothing that was referenced, else the current one."""
    return rows.agg(F.coalesce(F.min(F.when((F.col("lost_ref") == 0) & (F.col("k") <= current), F.col("k"))), F.lit(current).cast("long")).alias("k"))


def attributed(c: DataFrame) -> DataFrame:
    """How many injections have an outcome: the evidence that tuning needs enough of."""
    return c.agg(F.count_if(F.col("injected") & F.col("outcome").isNotNull()).alias("n"))
