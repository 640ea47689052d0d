"""The driver's tables seen as the engine's: store events, turns, prompts, retrieval log, evidence. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.functions import text as X
from factlake.operators import ledger, store

NOW = "2024-02-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts that are stored one a minute; one source in twenty is generic."""
    d = table(spark, sf_dir, "documents")
    own = d.select(F.col("doc_id").alias("seq"), F.when(F.col("source") == "src0", "mcp:remember").otherwise(F.col("source")).alias("source"), "text",
                   (F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 60)).alias("ts"), F.col("lang").alias("topic"), F.array("source", "lang").alias("tags"))
    return store.events(own)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.versions(store_events(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.turn_index(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def benchmark_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def log_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged candidates: a user is a session, a week a turn, fifty facts, a pool of twelve in each turn."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    week = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / (168 * 3600)).cast("long")
    e = e.select("event_id", "event_type", "ts", F.col("user_id").alias("session_id"), week.alias("line_no"), (F.col("event_id") % 50).alias("memory_id"), F.round(F.col("value") / (F.col("value") + 10), 4).alias("score"), (10 + F.col("event_id") % 40).alias("tokens"))
    one = e.withColumn("n", F.row_number().over(W.partitionBy("session_id", "line_no", "memory_id").orderBy("event_id"))).where("n = 1")
    top = one.withColumn("rank", F.row_number().over(W.partitionBy("session_id", "line_no").orderBy(F.desc("score"), "memory_id"))).where("rank <= 12")
    t = F.col("event_type")
    outcome = (F.when(t.isin("view", "signup"), None).when((t == "error") & (F.col("memory_id") < 10), "contradicted").when((t == "purchase") & (F.col("score") >= 0.5) & (F.col("rank") <= 5), "referenced").otherwise("ignored"))
    return top.select("event_id", "session_id", "line_no", "memory_id", "score", "tokens", "ts", "rank", (t != "view").alias("injected"), outcome.alias("outcome"))


def injections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pending injections and the facts' texts: what an assistant said is a fact that some prompts of its session got."""
    t = turns(spark, sf_dir)
    facts = t.where("role = 'assistant'").select((F.col("session_id") * 1000 + F.col("idx")).alias("id"), "session_id", F.col("idx").alias("fact_idx"), "text")
    prompts = t.where("role = 'user'").select("session_id", F.col("idx").alias("line_no"), F.left("text", F.lit(500)).alias("query"))
    pending = prompts.join(facts.select("session_id", "fact_idx", F.col("id").alias("memory_id")), "session_id").where("fact_idx % 3 = line_no % 3 OR abs(fact_idx - line_no) = 1")
    return pending.select("session_id", "line_no", "memory_id", "query"), facts.select("id", "text")


_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
TOK = _TOK.format

STORE_SQL = r"""
store_events AS (SELECT seq, source, txt AS text, ts, topic, tags, substr(sha256(concat(source, chr(0), txt)), 1, 24) AS id FROM
  (SELECT doc_id AS seq, CASE WHEN source = 'src0' THEN 'mcp:remember' ELSE coalesce(source, '') END AS source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS txt,
     TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, lang AS topic, [source, lang] AS tags FROM documents) WHERE txt <> ''),
grouped AS (SELECT source, id, any_value(text) AS text, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(ts, seq) AS recorded_at, arg_max(ts, seq) AS last_ts,
     count(*) AS n_events, arg_max(topic, seq) AS topic, arg_max(tags, seq) AS tags FROM store_events GROUP BY source, id),
memories AS (SELECT g.*, CASE WHEN source IN ('', 'mcp:remember') THEN id ELSE (SELECT arg_min(h.id, h.first_seq) FROM grouped h WHERE h.source = g.source) END AS lineage,
     CASE WHEN source IN ('', 'mcp:remember') THEN NULL ELSE (SELECT min(h.recorded_at) FROM grouped h WHERE h.source = g.source AND h.first_seq > g.last_seq) END AS superseded_at FROM grouped g),
versions AS (SELECT *, coalesce(superseded_at, last_ts) AS updated_at FROM memories)
"""

TURNS_SQL = r"""
turns AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text FROM conversations
  WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
"""

LOG_SQL = """
raw_log AS (SELECT event_id, event_type, ts, user_id AS session_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / (168 * 3600)) AS BIGINT) AS line_no,
     event_id % 50 AS memory_id, round(value / (value + 10), 4) AS score, 10 + event_id % 40 AS tokens FROM events),
one_log AS (SELECT * FROM raw_log QUALIFY row_number() OVER (PARTITION BY session_id, line_no, memory_id ORDER BY event_id) = 1),
top_log AS (SELECT *, row_number() OVER (PARTITION BY session_id, line_no ORDER BY score DESC, memory_id) AS rank FROM one_log QUALIFY rank <= 12),
log AS (SELECT event_id, session_id, line_no, memory_id, score, tokens, ts, rank, event_type <> 'view' AS injected,
     CASE WHEN event_type IN ('view', 'signup') THEN NULL WHEN event_type = 'error' AND memory_id < 10 THEN 'contradicted'
          WHEN event_type = 'purchase' AND score >= 0.5 AND rank <= 5 THEN 'referenced' ELSE 'ignored' END AS outcome FROM top_log),
stats AS (SELECT memory_id, count(*) FILTER (injected AND outcome IS NOT NULL) AS injected, count(*) FILTER (injected AND outcome = 'referenced') AS referenced,
     count(*) FILTER (injected AND outcome = 'ignored') AS ignored, count(*) FILTER (injected AND outcome = 'contradicted') AS contradicted,
     coalesce(CAST(sum(tokens) FILTER (injected AND outcome IS NOT NULL) AS BIGINT), 0) AS tokens,
     max(ts) FILTER (injected AND outcome IS NOT NULL) AS last_injected, max(ts) FILTER (injected AND outcome = 'referenced') AS last_referenced
     FROM log GROUP BY memory_id HAVING count(*) FILTER (injected AND outcome IS NOT NULL) > 0)
"""

INJECTION_SQL = TURNS_SQL + r""",
facts AS (SELECT session_id * 1000 + idx AS id, session_id, idx AS fact_idx, text FROM turns WHERE role = 'assistant'),
pending AS (SELECT p.session_id, p.idx AS line_no, f.id AS memory_id, left(p.text, 500) AS query FROM turns p JOIN facts f USING (session_id)
  WHERE p.role = 'user' AND (f.fact_idx % 3 = p.idx % 3 OR abs(f.fact_idx - p.idx) = 1)),
needles AS (SELECT DISTINCT session_id, query, left(regexp_replace(regexp_replace(query, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 200) AS needle FROM pending),
located AS (SELECT n.session_id, n.query, min(t.idx) AS prompt_turn FROM needles n JOIN turns t ON t.session_id = n.session_id AND t.role = 'user' AND n.needle <> ''
  AND starts_with(left(regexp_replace(regexp_replace(t.text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 200), n.needle) GROUP BY ALL),
placed AS (SELECT p.*, coalesce(l.prompt_turn, -1) AS prompt_turn FROM pending p LEFT JOIN located l USING (session_id, query))
"""
