"""Housekeeping: log rotation with exact cursor repair, pruning, backups, the ordered run of all steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rotate(log: DataFrame, cutoff: str) -> DataFrame:
    """Lines (line_no, ts) with ``keep``: those with a readable time at or after the cutoff."""
    return log.withColumn("keep", F.coalesce(F.col("ts") >= F.lit(cutoff).cast("timestamp"), F.lit(False)))


def rebase(cursors: DataFrame, dropped: DataFrame) -> DataFrame:
    """Cursors (session_id, log_line) moved back by the dropped lines (line_no) before them."""
    d = dropped.select("line_no").distinct()
    # whole blocks of lines before a cursor's by a running sum over blocks, the rest within its own block
    block = 4096
    lines = cursors.select("log_line").distinct().withColumn("blk", F.floor(F.col("log_line") / block))
    per = d.groupBy(F.floor(F.col("line_no") / block).alias("blk")).agg(F.count("*").alias("c")).unionByName(lines.select("blk", F.lit(0).cast("long").alias("c")))
    per = per.groupBy("blk").agg(F.sum("c").alias("c"))
    prior = per.select("blk", F.coalesce(F.sum("c").over(W.orderBy("blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("prior"))
    inside = lines.join(d.withColumn("blk", F.floor(F.col("line_no") / block)), "blk").where("line_no < log_line").groupBy("log_line").agg(F.count("*").alias("inside"))
    out = cursors.withColumn("blk", F.floor(F.col("log_line") / block)).join(prior, "blk", "left").join(inside, "log_line", "left")
    return out.select("session_id", (F.col("log_line") - F.coalesce("prior", F.lit(0)) - F.coalesce("inside", F.lit(0))).cast("long").alias("log_line"))


def prune(candidates: DataFrame, keep: int, order: str = "ingest_seq") -> DataFrame:
    """The newest rows. The bound is a quantile-free top-n, so nothing is sorted as a whole."""
    return candidates.orderBy(F.desc(order)).limit(keep)


def backups_to_drop(backups: DataFrame, keep: int = 5) -> DataFrame:
    """Backups (name, made_at) beyond the newest few."""
    return backups.withColumn("n", F.row_number().over(W.orderBy(F.desc("made_at"), F.desc("name")))).where(F.col("n") > keep).drop("n")


def status(health: DataFrame, cold: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: counts of the store (live, versions), of the cold tier (id) and of the log's candidates by outcome."""
    c = F.col("injected") & F.col("outcome").isNotNull()
    log = candidates.agg(F.count("*").alias("candidates"), F.count_if("injected").alias("injected"), *[F.count_if(c & (F.col("outcome") == o)).alias(o) for o in ("referenced", "ignored", "contradicted")])
    return health.select("live", "versions").crossJoin(cold.agg(F.count("*").alias("archived"))).crossJoin(log)


def needs_backup(fingerprint: str, last: str | None) -> bool:
    """Whether the store has changed since its last backup."""
    return fingerprint != last


def run(steps: list[tuple[str, Callable[[], str]]]) -> list[tuple[str, str, str]]:
    """(name, status, detail) of steps in order; one that fails doesn't stop the rest."""
    out = []
    for name, step in steps:
        try:
            out.append((name, "ok", step()))
        except Exception as e:  # noqa: BLE001 - a step's failure is its result
            out.append((name, "failed", str(e)[:200]))
    return out


def auto_tune(attributed: int, theta: float, best_theta: float, k: int, best_k: int, least: int = 20) -> dict:
    """Settings to write, in one go, given enough evidence; none otherwise."""
    if attributed < least:
        return {}
    return {**({"threshold": best_theta} if best_theta != theta else {}), **({"k": best_k} if best_k != k else {})}
