"""Evidence on facts: reinforced ranking, quarantine, cost report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.functions import text as X

BOOST, QUARANTINE = 0.10, 3
CHRONIC_MIN, CHRONIC_RATE, CHRONIC_PENALTY = 8, 0.10, 0.20


def quarantined(q: int = QUARANTINE) -> Column:
    """Contradicted often enough, and more often than referenced."""
    return (F.col("contradicted") >= q) & (F.col("contradicted") > F.col("referenced"))


def reinforced(score: Column) -> Column:
    """A score moved by its fact's evidence within narrow bounds; facts that are always ignored sink."""
    moved = score + BOOST * (F.col("referenced") - F.col("contradicted")) / F.greatest(F.col("injected"), F.lit(3))
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))
    chronic = (F.col("injected") >= CHRONIC_MIN) & (F.col("referenced") / F.col("injected") < CHRONIC_RATE)
    return F.when(chronic, F.greatest(F.lit(0.0), s - CHRONIC_PENALTY)).otherwise(s)


def adjust(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """Hits (qid, id, score, rank) with scores moved by stats (memory_id, ...), quarantined facts dropped, ranked anew."""
    joined = hits.join(stats.select(F.col("memory_id").alias("id"), "injected", "referenced", "contradicted"), "id", "left")
    kept = joined.where(F.col("injected").isNull() | ~quarantined())
    s = F.round(F.when(F.col("injected").isNull(), F.col("score")).otherwise(reinforced(F.col("score"))), 6)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return kept.withColumn("score", s).withColumn("rank", F.row_number().over(w)).select("qid", "id", "score", "rank")


def injected(pool: DataFrame, k: int, theta: float) -> DataFrame:
    """The first k of a ranked pool (qid, id, score, rank) that reach the threshold; none for k of 0 or less."""
    w = W.partitionBy("qid").orderBy("rank")
    return pool.where(F.col("score") >= theta).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def context(hits: DataFrame, clip: int) -> DataFrame:
    """(qid, context) of hits (qid, rank, score, text): clipped facts under one heading."""
    line = F.concat(F.lit("- "), X.clip(F.col("text"), clip), F.format_string("  (relevance %.2f)", "score"))
    return hits.groupBy("qid").agg(F.concat(F.lit("Relevant memory:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n")).alias("context"))


def verdict() -> Column:
    """What a fact's cost has bought."""
    return F.when(quarantined(), "quarantined").when(F.col("referenced") > 0, "valuable").when(F.col("injected") >= 3, "wasteful").otherwise("watching")


def roi(stats: DataFrame, texts: DataFrame | None = None, top: int = 12) -> DataFrame:
    """The facts that cost most tokens, with verdict and reference rate."""
    best = stats.orderBy(F.desc("tokens"), "memory_id").limit(top)
    out = best.select("memory_id", "injected", "referenced", "ignored", "contradicted", "tokens", F.round(F.col("referenced") / F.greatest("injected", F.lit(1)), 6).alias("ref_rate"), verdict().alias("verdict"))
    if texts is None:
        return out
    return out.join(texts.select(F.col("id").alias("memory_id"), F.left("text", F.lit(60)).alias("label")), "memory_id", "left").withColumn("label", F.coalesce("label", F.col("memory_id").cast("string")))


def roi_totals(stats: DataFrame) -> DataFrame:
    """Totals over all facts, whatever the report shows."""
    return stats.agg(F.count("*").alias("facts"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("injected", "referenced", "ignored", "contradicted", "tokens")]).withColumn(
        "ref_rate", F.round(F.col("referenced") / F.greatest("injected", F.lit(1)), 6))
