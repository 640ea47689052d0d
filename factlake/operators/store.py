"""Versioned facts: idempotent upsert, supersession, revival, lineage, as-of reads.

A store is its event log. The state follows in closed form from windows over a source's events, so a batch of any size
is folded at once, without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.functions import text as X

#: Sources that hold many facts side by side, so none of theirs supersedes another.
GENERIC = ("", "mcp:remember")


def events(df: DataFrame) -> DataFrame:
    """Store events with their fact's id; blank texts aren't stored. Needs (seq, source, text, ts) and carries the rest."""
    own = df.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("text", X.strip(F.col("text"))).where("text IS NOT NULL AND text <> ''")
    return own.withColumn("id", X.memory_id(F.col("source"), F.col("text")))


def versions(ev: DataFrame) -> DataFrame:
    """The state of all versions after all events: one row for each id.

    A fact is closed by the first new fact of its source after its own last event; a repeat of a known fact refreshes or
    revives it and closes nobody. Generic sources close nothing, and as these are the large ones they are grouped by id
    alone: no window holds them.
    """
    extra = [c for c in ev.columns if c not in ("seq", "source", "text", "ts", "id")]
    rows = ev.groupBy("source", "id").agg(
        F.first("text").alias("text"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("ts", "seq").alias("recorded_at"),
        F.max_by("ts", "seq").alias("last_ts"), F.count("*").alias("n_events"), *[F.max_by(c, "seq").alias(c) for c in extra])
    generic = F.col("source").isin(*GENERIC)
    specific = rows.where(~generic)
    # all points of a source: where each fact begins, and where its last event lies
    points = specific.select("source", "id", F.explode(F.array(F.struct(F.col("first_seq").alias("seq"), F.col("recorded_at").alias("new_ts")), F.struct(F.col("last_seq").alias("seq"), F.lit(None).cast("timestamp").alias("new_ts")))).alias("p"))
    points = points.groupBy("source", "id", F.col("p.seq").alias("seq")).agg(F.max("p.new_ts").alias("new_ts"))
    w = W.partitionBy("source").orderBy(F.desc("seq"))
    marked = points.withColumn("closed", F.min("new_ts").over(w.rowsBetween(W.unboundedPreceding, -1)))
    first = specific.groupBy("source").agg(F.min_by("id", "first_seq").alias("lineage"))
    closed = specific.join(marked.select("source", "id", F.col("seq").alias("last_seq"), F.col("closed").alias("superseded_at")), ["source", "id", "last_seq"], "left").join(first, "source")
    open_ = rows.where(generic).withColumn("superseded_at", F.lit(None).cast("timestamp")).withColumn("lineage", F.col("id"))
    out = closed.unionByName(open_)
    return out.withColumn("updated_at", F.coalesce("superseded_at", "last_ts")).drop("last_ts")


def classified(ev: DataFrame) -> DataFrame:
    """Events with what each did: stored, revived, restated (metadata changed) or repeated.

    Generic sources, the large ones, revive nothing and are looked at fact by fact: no window holds such a source.
    """
    w = W.partitionBy("source").orderBy("seq")
    own = W.partitionBy("source", "id").orderBy("seq")
    generic = F.col("source").isin(*GENERIC)
    changed = ~F.col("metadata").eqNullSafe(F.lag("metadata").over(own)) if "metadata" in ev.columns else F.lit(False)
    x = ev.withColumn("is_new", F.row_number().over(own) == 1).withColumn("changed", changed)
    s = x.where(~generic).withColumn("news", F.sum(F.when(F.col("is_new"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    s = s.withColumn("closed", F.col("news") > F.lag("news").over(own)).drop("news")
    x = s.unionByName(x.where(generic).withColumn("closed", F.lit(False)))
    return x.withColumn("event", F.when(F.col("is_new"), "stored").when(F.col("closed"), "revived").when(F.col("changed"), "restated").otherwise("repeated")).drop("is_new", "closed", "changed")


def live(v: DataFrame) -> DataFrame:
    """Versions that hold now."""
    return v.where("superseded_at IS NULL")


def at(v: DataFrame, instant: Column | str) -> DataFrame:
    """Versions that held at an instant. Over stored versions both bounds are pushed to the scan; over folded events they are filters after it."""
    t = F.lit(instant).cast("timestamp") if isinstance(instant, str) else instant
    return v.where((F.col("recorded_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t)))


def fetch(hot: DataFrame, ids: DataFrame, cold: DataFrame | None = None) -> DataFrame:
    """(id, text) of known ids, from the hot tier first."""
    found = hot.join(ids.select("id").distinct(), "id", "left_semi").select("id", "text")
    if cold is None:
        return found
    more = cold.join(ids.select("id").distinct(), "id", "left_semi").join(found, "id", "left_anti").select("id", "text")
    return found.unionByName(more)


def health(v: DataFrame) -> DataFrame:
    """Counts and the revision by which caches are keyed, in one scan."""
    return v.agg(F.count_if(F.col("superseded_at").isNull()).alias("live"), F.count("*").alias("versions"), F.max("updated_at").alias("latest")).withColumn(
        "revision", F.concat_ws(":", F.col("live").cast("string"), F.date_format("latest", "yyyy-MM-dd HH:mm:ss")))


def diff_now(then: DataFrame, v: DataFrame) -> DataFrame:
    """What became of versions that held then: unchanged, changed or retired, with the fact that holds now."""
    now = live(v).select("lineage", F.col("id").alias("now_id"), F.col("recorded_at").alias("r"))
    now = now.groupBy("lineage").agg(F.max_by("now_id", F.struct("r", "now_id")).alias("now_id"))
    return then.join(now, "lineage", "left").withColumn("change", F.when(F.col("now_id").isNull(), "retired").when(F.col("now_id") == F.col("id"), "unchanged").otherwise("changed"))


def from_v1(old: DataFrame) -> DataFrame:
    """Rows of the first schema (created_at, no lineage) as versions."""
    return old.select("id", F.col("id").alias("lineage"), "text", "metadata", "source", F.col("created_at").alias("valid_from"), F.col("created_at").alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at"), "updated_at")


def capture(facts: DataFrame, session: str, most: int = 8) -> DataFrame:
    """Extracted (pos, text, topic, tags) as store events keyed by topic; a topic that comes again in the batch is numbered."""
    kept = facts.where(F.length("text") >= 20)
    kept = kept.withColumn("rank", F.row_number().over(W.orderBy("pos"))).where(F.col("rank") <= most)  # a reply holds few facts
    n = F.row_number().over(W.partitionBy("topic").orderBy("pos"))
    kept = kept.withColumn("topic", X.slug(F.coalesce("topic", F.lit("")))).withColumn("n", n)
    name = F.when(F.col("n") == 1, F.col("topic")).otherwise(F.concat_ws("-", "topic", F.col("n").cast("string")))
    return kept.select(F.col("pos").alias("seq"), F.concat(F.lit(f"session:{session}:"), name).alias("source"), "text", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("auto-capture"))).alias("tags"), name.alias("topic"))
