"""Lifecycle of facts: the cold tier, size caps, uselessness, permanent deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.operators.ranking import quarantined
from factlake.shared import settled

SUPERSEDED_DAYS, QUARANTINED_DAYS, MIN_AGE_DAYS, KEEP, BATCH = 90, 60, 30, "keep", 25


def before(now: str, days: int) -> Column:
    """The instant so many days before now."""
    return F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))


def steady(v: DataFrame, stats: DataFrame, now: str, superseded_days: int = SUPERSEDED_DAYS, quarantined_days: int = QUARANTINED_DAYS) -> DataFrame:
    """(id, reason) of what moves to the cold tier in any case: versions long superseded, facts long quarantined."""
    old = v.where(F.col("superseded_at") < before(now, superseded_days)).select("id", F.lit("superseded").alias("reason"))
    stale = stats.where(quarantined() & F.coalesce(F.col("last_referenced") < before(now, quarantined_days), F.lit(True))).select(F.col("memory_id").alias("id"), F.lit("quarantined").alias("reason"))
    bad = v.select("id").join(stale, "id")
    return old.unionByName(bad).groupBy("id").agg(F.max("reason").alias("reason"))


def useless_first(live: DataFrame, stats: DataFrame, now: str, min_days: int = MIN_AGE_DAYS, keep: str = KEEP) -> DataFrame:
    """(id, recorded_at, ..., bytes) of facts that may be archived under pressure, with their sort keys.

    Old enough, without the keep tag, not referenced of late. Proven useless facts come first, then fewer references,
    more ignored, more injected, older.
    """
    age = before(now, min_days)
    own = live.where((F.col("recorded_at") < age) & ~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), keep))
    x = own.join(stats.select(F.col("memory_id").alias("id"), "injected", "referenced", "ignored", "last_referenced"), "id", "left")
    x = x.where(F.col("last_referenced").isNull() | (F.col("last_referenced") < age))
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("injected", "referenced", "ignored")}
    return x.select("id", "recorded_at", F.when((n["injected"] > 0) & (n["referenced"] == 0), 0).otherwise(1).cast("long").alias("proven"), *[c.alias(k) for k, c in n.items()], F.octet_length("text").cast("long").alias("bytes"))


ORDER = ("proven", "referenced", "ignored DESC", "injected DESC", "recorded_at", "id")


def _order() -> list[Column]:
    return [F.expr(o.split()[0]).desc() if o.endswith("DESC") else F.col(o).asc() for o in ORDER]


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates with their place in the order of uselessness, and the bytes up to there."""
    return _placed(candidates, _order())[0]


def _placed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in that order and ``freed``, the bytes up to there; and the parts' totals.

    The running sums are two-level: rows are range-partitioned and settled once, each part is summed on its own, and the
    parts' totals, one row each, are added up; no task holds all rows.
    """
    parts = settled(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    w = W.partitionBy("part").orderBy(*order)
    own = parts.withColumn("sum_in", F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("n_in", F.row_number().over(w))
    totals = parts.groupBy("part").agg(F.sum("bytes").alias("b"), F.count("*").alias("c"))
    t = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offset = totals.select("part", F.coalesce(F.sum("b").over(t), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(t), F.lit(0)).alias("c0"))
    x = own.join(F.broadcast(offset), "part").withColumn("place", F.col("n_in") + F.col("c0")).withColumn("freed", F.col("sum_in") + F.col("b0"))
    return x.drop("part", "sum_in", "n_in", "b0", "c0"), totals


def _upto(df: DataFrame, order: list[Column], over, batch: int) -> DataFrame:
    """Rows in order until their bytes reach what is over (of the total of bytes), rounded up to whole batches; none if nothing is over."""
    x, totals = _placed(df, order)
    bound = totals.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.sum("c").alias("t")).select(over(F.col("b")).alias("over"), "t")
    need = x.crossJoin(F.broadcast(bound)).where(F.col("freed") >= F.col("over")).agg(F.min("place").alias("m"))
    last = need.crossJoin(bound).select((F.ceil(F.coalesce("m", "t") / batch) * batch).alias("last"), "over")
    return x.crossJoin(F.broadcast(last)).where((F.col("place") <= F.col("last")) & (F.col("over") > 0)).drop("last", "over")


def pressure(candidates: DataFrame, over_bytes: int, batch: int = BATCH) -> DataFrame:
    """The least useful facts whose bytes bring a tier that is over its cap by so much below it, in whole batches."""
    return _upto(candidates, _order(), lambda total: F.lit(over_bytes), batch)


def purge_fifo(cold: DataFrame, cap_bytes: int, batch: int = BATCH) -> DataFrame:
    """Archived rows (id, archived_at, bytes) that are deleted for good, oldest first, until the tier fits; none for cap 0."""
    if cap_bytes <= 0:
        return cold.limit(0)
    return _upto(cold, [F.col("archived_at").asc(), F.col("id").asc()], lambda total: total - F.lit(cap_bytes), batch).drop("place", "freed")


def move(src: DataFrame, dst: DataFrame, ids: DataFrame, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tiers after the ids' rows have moved; archiving stamps them, restoring drops the stamp."""
    gone = src.join(ids.select("id").distinct(), "id", "left_semi")
    gone = gone.withColumn("archived_at", F.lit(now).cast("timestamp")) if now else gone.drop("archived_at")
    rest = dst.join(gone.select("id"), "id", "left_anti")
    return src.join(ids.select("id").distinct(), "id", "left_anti"), rest.unionByName(gone, allowMissingColumns=True)
