"""The topic manifest: what a store knows, within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_TOPICS, FULL_BELOW, BUDGET = 100, 300, 200
INTRO = "Topics in long-term memory (recall one with a focused query for details):"


def topics(live: DataFrame, most: int = MAX_TOPICS) -> DataFrame:
    """(topic, n, first_seq, rank): topics and tags by frequency, ties by first appearance. Needs (topic, tags, first_seq)."""
    each = live.select("first_seq", F.posexplode(F.concat(F.array("topic"), F.coalesce("tags", F.array().cast("array<string>")))).alias("pos", "topic")).where("topic IS NOT NULL AND topic <> ''")
    counts = each.groupBy("topic").agg(F.count("*").alias("n"), F.min(F.struct("first_seq", "pos")).alias("f"))
    best = counts.orderBy(F.desc("n"), "f", "topic").limit(most)  # a few rows from here on
    return best.select("topic", "n", F.col("f.first_seq").alias("first_seq"), F.row_number().over(W.orderBy(F.desc("n"), "f", "topic")).alias("rank"))


def budgeted(ranked: DataFrame, fixed: int, budget: int = BUDGET) -> DataFrame:
    """The prefix of topics whose joined length fits the budget in tokens; the first always stays."""
    upto = F.sum(F.length("topic") + 2).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) - 2
    return ranked.withColumn("tokens", F.greatest(F.lit(1), F.floor(upto / 4)).cast("long")).where((F.col("rank") == 1) | (F.col("tokens") + fixed <= budget))


def render(live: DataFrame, n_live: int, most: int = MAX_TOPICS, full_below: int = FULL_BELOW, budget: int = BUDGET) -> str:
    """The manifest's text; blank for an empty store."""
    if not n_live:
        return ""
    head = f"# Memory index — {n_live} stored" + (" (summarized)" if n_live >= full_below else "")
    ranked = topics(live, most).cache()
    shown = [r["topic"] for r in budgeted(ranked, max(1, len(f"{head}\n{INTRO}\n") // 4), budget).orderBy("rank").collect()]
    more = ranked.count() - len(shown)
    ranked.unpersist()
    return f"{head}\n{INTRO}\n{', '.join(shown)}" + (f"  (+{more} more)" if more else "") if shown else ""


class Cache:
    """Manifest texts by store revision: an unchanged store isn't scanned again."""

    def __init__(self) -> None:
        self.held: dict[str, str] = {}

    def get(self, revision: str, make) -> str:
        if revision not in self.held:
            self.held = {revision: make()}
        return self.held[revision]
