"""The outcome loop: which injected facts did an assistant use, ignore, or have corrected?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.functions import text as X

MIN_OVERLAP, FRACTION = 3, 0.15


def turn_index(lines: DataFrame, session: str = "session_id", order: str = "line_no") -> DataFrame:
    """(session_id, idx, role, text): spoken turns of users and assistants, numbered from 0 in each session."""
    own = lines.where(F.col("role").isin("user", "assistant") & (X.strip(F.coalesce("text", F.lit(""))) != ""))
    return own.select(F.col(session).alias("session_id"), (F.row_number().over(W.partitionBy(session).orderBy(order)) - 1).alias("idx"), "role", "text")


def ingest(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Candidates of retrieval-log records, one for each (session_id, line_no, memory_id), none that is known already."""
    flat = log.select("session_id", "line_no", "ts", "query", F.inline("candidates")).where("id IS NOT NULL AND score IS NOT NULL")
    w = W.partitionBy("session_id", "line_no", "id").orderBy(F.desc("score"))
    new = flat.withColumn("n", F.row_number().over(w)).where("n = 1").select("session_id", "line_no", F.col("id").alias("memory_id"), "query", "score", F.col("injected").cast("boolean").alias("injected"), F.col("tokens").cast("long").alias("tokens"), "ts", F.lit(None).cast("string").alias("outcome"))
    return new if existing is None else new.join(existing.select("session_id", "line_no", "memory_id"), ["session_id", "line_no", "memory_id"], "left_anti")


def prompt_turn(pending: DataFrame, turns: DataFrame) -> DataFrame:
    """pending (session_id, query, ...) with ``prompt_turn``: the first user turn that starts with the query, -1 if none does."""
    needle = pending.select("session_id", "query").distinct().withColumn("needle", X.collapse(F.coalesce("query", F.lit(""))))
    said = turns.where("role = 'user'").select("session_id", "idx", X.collapse(F.col("text")).alias("said"))
    found = needle.where("needle <> ''").join(said, "session_id").where(F.col("said").startswith(F.col("needle"))).groupBy("session_id", "query").agg(F.min("idx").alias("prompt_turn"))
    return pending.join(found, ["session_id", "query"], "left").withColumn("prompt_turn", F.coalesce("prompt_turn", F.lit(-1)).cast("long"))


def outcomes(pending: DataFrame, turns: DataFrame, texts: DataFrame, min_overlap: int = MIN_OVERLAP, fraction: float = FRACTION) -> DataFrame:
    """Injections (session_id, line_no, memory_id, query) with prompt_turn and outcome: referenced or ignored.

    A fact is referenced if enough of its distinctive words occur in what the assistant said after the prompt.
    """
    own = prompt_turn(pending, turns).join(texts.select(F.col("id").alias("memory_id"), X.distinctive(F.col("text")).alias("marks")), "memory_id", "left")
    wanted = own.select("session_id", "line_no", "memory_id", "prompt_turn", F.explode("marks").alias("w"))
    # of each word only the last time that the assistant said it matters
    last = turns.where("role = 'assistant'").select("session_id", "idx", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("w")).groupBy("session_id", "w").agg(F.max("idx").alias("last"))
    hit = wanted.join(last, ["session_id", "w"]).where(F.col("last") > F.col("prompt_turn")).groupBy("session_id", "line_no", "memory_id").agg(F.count("*").alias("hits"))
    n = F.coalesce(F.size("marks"), F.lit(0))
    n = F.when(F.col("marks").isNull(), 0).otherwise(n)
    need = F.greatest(F.lit(min_overlap), F.ceil(fraction * n))
    return own.join(hit, ["session_id", "line_no", "memory_id"], "left").withColumn("outcome", F.when((n > 0) & (F.coalesce("hits", F.lit(0)) >= need), "referenced").otherwise("ignored")).drop("hits", "marks")


def contradictions(done: DataFrame, turns: DataFrame, patterns: tuple[str, ...] = X.CORRECTION) -> DataFrame:
    """``done`` with referenced facts flipped to contradicted where the next user turn after the answer corrects it.

    ``settled`` is false while there is no such turn yet; then the fact is looked at again later.
    """
    users = turns.where("role = 'user'").select("session_id", "idx", X.any_match(F.col("text"), patterns).alias("corrects"))
    after = done.select("session_id", "prompt_turn").distinct().join(users, "session_id").where(F.col("idx") > F.greatest("prompt_turn", F.lit(-1)) + 1)
    after = after.groupBy("session_id", "prompt_turn").agg(F.min_by("corrects", "idx").alias("corrects"))
    out = done.join(after, ["session_id", "prompt_turn"], "left")
    flip = (F.col("outcome") == "referenced") & F.coalesce("corrects", F.lit(False))
    return out.withColumn("settled", (F.col("outcome") != "referenced") | F.col("corrects").isNotNull()).withColumn("outcome", F.when(flip, "contradicted").otherwise(F.col("outcome"))).drop("corrects")


def stats(candidates: DataFrame) -> DataFrame:
    """Counters of each fact, derived from the candidates and never stored as truth. Carries last_* if there is a ts."""
    c = F.col("injected") & F.col("outcome").isNotNull()
    n = lambda x: F.count_if(c & (F.col("outcome") == x)).alias(x)
    more = [F.max(F.when(c, F.col("ts"))).alias("last_injected"), F.max(F.when(c & (F.col("outcome") == "referenced"), F.col("ts"))).alias("last_referenced")] if "ts" in candidates.columns else []
    return candidates.groupBy("memory_id").agg(F.count_if(c).alias("injected"), n("referenced"), n("ignored"), n("contradicted"), F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).alias("tokens"), *more).where("injected > 0")


def report(candidates: DataFrame) -> DataFrame:
    """Injections by outcome."""
    return candidates.where("injected AND outcome IS NOT NULL").groupBy("outcome").agg(F.count("*").alias("n"))
