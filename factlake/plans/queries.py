"""The engine's queries over the driver's tables, and the SQL that DuckDB runs against each.

Doubles are rounded to six digits before they rank anything and in results; all ties are broken; times are text in
results; ``now`` is a constant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.functions import text as X
from factlake.operators import archival, ledger, lexical, maintenance, manifest, provenance, ranking, store, tuning, vector
from factlake.plans import views as V
from factlake.plans.views import INJECTION_SQL, LOG_SQL, NOW, STORE_SQL, TOK, TURNS_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AS_OF, THETA, K, KEY = "2024-01-01 06:00:00", 0.35, 12, b"factlake test key"
PHRASE = "the thing that was in the answer"
CORRECTS = (r"^\s*th",)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def when(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _when(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# text ------------------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, {TOK('text')} AS t FROM documents)")
def tokenize(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_FIRST = "list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda x: list_position({0}, x[1]) = x[2]), lambda x: x[1])"
_MARKS = r"list_filter({0}, lambda t: NOT list_contains(" + _STOP + r", t) AND (length(t) >= 5 OR regexp_matches(t, '\p{{N}}')))[1:48]"


@query(f"WITH a AS (SELECT conv_id, turn, {TOK('text')} AS t FROM conversations), b AS (SELECT conv_id, turn, {_FIRST.format('t')} AS d FROM a) "
       f"SELECT conv_id, turn, len(m) AS n_marks, array_to_string(m, ' ') AS marks FROM (SELECT conv_id, turn, {_MARKS.format('d')} AS m FROM b)")
def distinctive_tokens(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", X.distinctive(F.col("text")).alias("m"))
    return t.select("conv_id", "turn", F.size("m").cast("long").alias("n_marks"), F.array_join("m", " ").alias("marks"))


def _any(col: str, patterns) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({col}, '(?i){joined}')"


@query(f"SELECT conv_id, turn, CASE WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN true WHEN {_any('text', X.PRIOR_WORK)} THEN false ELSE {_any('text', X.SMALL_TALK)} END AS skip FROM conversations WHERE role = 'user'")
def tier1_gate(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", X.skip_retrieval(F.col("text")).alias("skip"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(left(text, 200), '\s+\S*$', '') || ' … (cut; recall it for the rest)' END AS clipped, "
       r"CAST(greatest(1, floor(least(length(text), 200) / 4)) AS BIGINT) AS tokens FROM documents")
def clip_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clip(F.col("text"), 200).alias("clipped"), X.tokens_estimate(F.col("text"), 200).alias("tokens"))


_SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), ''), 'fact')"


@query(f"WITH s AS (SELECT doc_id, source, {_SLUG.format('left(text, 6)')} AS slug FROM documents) SELECT doc_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS topic FROM (SELECT *, row_number() OVER (PARTITION BY source, slug ORDER BY doc_id) AS n FROM s)")
def slug_topics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", X.slug(F.left("text", F.lit(6))).alias("slug"))
    n = F.row_number().over(W.partitionBy("source", "slug").orderBy("doc_id"))
    return d.withColumn("n", n).select("doc_id", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("n").cast("string"))).alias("topic"))


@query("SELECT doc_id, sha256(concat(text, chr(0), '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}')) AS payload_hash FROM documents")
def payload_hash(spark, sf):
    meta = X.canonical(F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")))
    return table(spark, sf, "documents").select("doc_id", X.payload_hash(F.col("text"), meta).alias("payload_hash"))


# versioned store ---------------------------------------------------------------------------------------------------

@query(f"WITH {STORE_SQL} SELECT id, lineage, source, {_when('recorded_at')} AS recorded_at, {_when('superseded_at')} AS superseded_at, {_when('updated_at')} AS updated_at, n_events, topic FROM versions")
def store_versions(spark, sf):
    return V.memories(spark, sf).select("id", "lineage", "source", when("recorded_at").alias("recorded_at"), when("superseded_at").alias("superseded_at"), when("updated_at").alias("updated_at"), "n_events", "topic")


@query(f"WITH {STORE_SQL} SELECT id, source, text FROM versions WHERE superseded_at IS NULL")
def live_memories(spark, sf):
    return store.live(V.memories(spark, sf)).select("id", "source", "text")


@query(f"WITH {STORE_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY seq) = 1 AS is_new FROM store_events), n AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY source ORDER BY seq) AS news FROM e), "
       "s AS (SELECT *, lag(news) OVER (PARTITION BY source, id ORDER BY seq) AS seen FROM n) SELECT seq, id, CASE WHEN is_new THEN 'stored' WHEN source NOT IN ('', 'mcp:remember') AND news > seen THEN 'revived' ELSE 'repeated' END AS event FROM s")
def event_classes(spark, sf):
    return store.classified(V.store_events(spark, sf)).select("seq", "id", "event")


@query(f"WITH {STORE_SQL}, a AS (SELECT count(*) FILTER (superseded_at IS NULL) AS live, count(*) AS versions, max(updated_at) AS latest FROM versions) SELECT live, versions, {_when('latest')} AS latest, live || ':' || {_when('latest')} AS revision FROM a")
def health(spark, sf):
    return store.health(V.memories(spark, sf)).withColumn("latest", when("latest"))


@query(f"WITH {STORE_SQL} SELECT id, text FROM versions WHERE id IN (SELECT id FROM store_events WHERE seq % 37 = 0)")
def fetch_ids(spark, sf):
    return store.fetch(V.memories(spark, sf), V.store_events(spark, sf).where("seq % 37 = 0").select("id"))


@query(f"WITH {STORE_SQL}, t AS (SELECT * FROM versions WHERE recorded_at <= TIMESTAMP '{AS_OF}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{AS_OF}')), n AS (SELECT lineage, arg_max(id, (recorded_at, id)) AS now_id FROM versions WHERE superseded_at IS NULL GROUP BY lineage) "
       "SELECT id, now_id, CASE WHEN now_id IS NULL THEN 'retired' WHEN now_id = id THEN 'unchanged' ELSE 'changed' END AS change FROM t LEFT JOIN n USING (lineage)")
def diff_now(spark, sf):
    v = V.memories(spark, sf)
    return store.diff_now(store.at(v, AS_OF), v).select("id", "now_id", "change")


# lexical search ----------------------------------------------------------------------------------------------------

def _search_sql(docs: str, prompts: str, where: str = "true", k: int = 3, head: str = "") -> str:
    """The whole of lexical.search over docs (id, text, ...) and prompts (qid, query)."""
    return f"""WITH {head} docs AS ({docs}), prompts AS ({prompts}),
toks AS (SELECT id, {TOK('text')} AS t FROM docs), n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
q AS (SELECT qid, {_FIRST.format('t')}[1:32] AS terms FROM (SELECT qid, {TOK('query')} AS t FROM prompts)), each_ AS (SELECT qid, unnest(terms) AS term FROM q),
post AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM each_) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
m AS (SELECT e.qid, p.id, round(sum((CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS bm25, count(*) AS hits
  FROM each_ e JOIN post p USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY e.qid, p.id),
c AS (SELECT m.qid, m.id, bm25, hits / len(q.terms)::DOUBLE AS cov FROM m JOIN q USING (qid)),
pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) AS p FROM c WHERE id IN (SELECT id FROM docs WHERE {where}) QUALIFY p <= 256),
s AS (SELECT *, round(cov + (1 - cov) * (1 / (1 + exp(-(bm25 - 1)))), 6) AS score FROM pool)
"""


_BENCH = "SELECT item_id AS qid, text AS query FROM benchmark"
_DOCS = "SELECT doc_id AS id, text FROM documents"
_BEST = "SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p) AS rank FROM s WHERE score >= 0.35 QUALIFY rank <= 3"


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT count(*) AS n_docs, round(avg(len({TOK('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf):
    return lexical.corpus(lexical.indexed(_docs(spark, sf))).withColumn("avgdl", F.round("avgdl", 6))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({TOK('text')}) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 50")
def postings_top_terms(spark, sf):
    return lexical.postings(lexical.indexed(_docs(spark, sf))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).orderBy(F.desc("df"), "term").limit(50)


@query(_search_sql(_DOCS, _BENCH + " WHERE item_id % 10 = 0") + "SELECT qid, id, bm25, round(cov, 6) AS cov FROM c")
def bm25_scores(spark, sf):
    return lexical.matched(_docs(spark, sf), V.benchmark_prompts(spark, sf).where("qid % 10 = 0")).withColumn("cov", F.round("cov", 6))


@query(_search_sql(_DOCS, f"SELECT 0::BIGINT AS qid, '{PHRASE}' AS query") + _BEST)
def lexical_search(spark, sf):
    return _long(lexical.search(_docs(spark, sf), spark.createDataFrame([(0, PHRASE)], "qid long, query string")))


@query(_search_sql(_DOCS, _BENCH) + _BEST)
def lexical_search_batch(spark, sf):
    return _long(lexical.search(_docs(spark, sf), V.benchmark_prompts(spark, sf)))


@query(_search_sql("SELECT id, text, recorded_at, superseded_at FROM versions", _BENCH, f"recorded_at <= TIMESTAMP '{AS_OF}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{AS_OF}')", head=STORE_SQL + ",") + _BEST)
def as_of_search(spark, sf):
    t = F.lit(AS_OF).cast("timestamp")
    where = (F.col("recorded_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t))
    return _long(lexical.search(V.memories(spark, sf), V.benchmark_prompts(spark, sf), where=where))


@query()
def stemmed_search(spark, sf):
    return _long(lexical.search(_docs(spark, sf), V.benchmark_prompts(spark, sf), stemmed=True))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.id AS qid, v.id, round(least(1.0, greatest(0.0, list_cosine_similarity(v.e, q.e))), 6) AS score FROM v CROSS JOIN v q WHERE q.id < 20) "
       "SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 5")
def vector_knn(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return _long(vector.knn(e, e.where("id < 20").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 5, 0.1))


# manifest ------------------------------------------------------------------------------------------------------------

_TOPICS = STORE_SQL + """, t AS (SELECT first_seq, 0 AS pos, topic FROM versions WHERE superseded_at IS NULL UNION ALL SELECT first_seq, 1, tags[1] FROM versions WHERE superseded_at IS NULL UNION ALL SELECT first_seq, 2, tags[2] FROM versions WHERE superseded_at IS NULL),
topics AS (SELECT topic, n, first_seq, row_number() OVER (ORDER BY n DESC, f, topic) AS rank FROM (SELECT topic, count(*) AS n, min((first_seq, pos)) AS f, min(first_seq) AS first_seq FROM t WHERE topic <> '' GROUP BY topic) QUALIFY rank <= 100)"""


@query(f"WITH {_TOPICS} SELECT * FROM topics")
def manifest_topics(spark, sf):
    return _long(manifest.topics(store.live(V.memories(spark, sf))))


@query(f"WITH {_TOPICS}, b AS (SELECT topic, rank, CAST(greatest(1, floor((sum(length(topic) + 2) OVER (ORDER BY rank) - 2) / 4)) AS BIGINT) AS tokens FROM topics) SELECT * FROM b WHERE rank = 1 OR tokens + 30 <= 45")
def manifest_budget(spark, sf):
    return _long(manifest.budgeted(manifest.topics(store.live(V.memories(spark, sf))), 30, 45)).select("topic", "rank", "tokens")


# outcome loop ----------------------------------------------------------------------------------------------------------

@query(f"WITH {TURNS_SQL} SELECT session_id, idx, role, length(text) AS n_chars FROM turns")
def turn_index(spark, sf):
    return V.turns(spark, sf).select("session_id", F.col("idx").cast("long").alias("idx"), "role", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {TURNS_SQL}, b AS (SELECT session_id, idx, upper(role) || ': ' || left(text, 2000) AS block FROM turns), r AS (SELECT *, row_number() OVER w AS rn, sum(length(block)) OVER w AS used FROM b WINDOW w AS (PARTITION BY session_id ORDER BY idx DESC)) "
       "SELECT session_id, count(*) AS n_turns, string_agg(block, chr(10) || chr(10) ORDER BY idx) AS rendered FROM r WHERE rn = 1 OR used <= 3000 GROUP BY session_id")
def transcript_tail(spark, sf):
    from factlake.sources.transcripts import tail

    return tail(V.turns(spark, sf), 3000)


@query(f"WITH {INJECTION_SQL} SELECT DISTINCT session_id, line_no, prompt_turn FROM placed")
def prompt_turn_match(spark, sf):
    pending, _ = V.injections(spark, sf)
    return ledger.prompt_turn(pending, V.turns(spark, sf)).select("session_id", F.col("line_no").cast("long").alias("line_no"), "prompt_turn").distinct()


_OUTCOME = INJECTION_SQL + f""",
marks AS (SELECT id, {_MARKS.format('d')} AS m FROM (SELECT id, {_FIRST.format('t')} AS d FROM (SELECT id, {TOK('text')} AS t FROM facts))),
said AS (SELECT session_id, w, max(idx) AS last FROM (SELECT session_id, idx, unnest({TOK('text')}) AS w FROM turns WHERE role = 'assistant') GROUP BY ALL),
hits AS (SELECT p.session_id, p.line_no, p.memory_id, count(*) AS h FROM (SELECT p.*, unnest(m) AS w FROM placed p JOIN marks ON marks.id = p.memory_id) p JOIN said s ON s.session_id = p.session_id AND s.w = p.w AND s.last > p.prompt_turn GROUP BY ALL),
outcomes AS (SELECT p.session_id, p.line_no, p.memory_id, p.prompt_turn, CASE WHEN len(m) > 0 AND coalesce(h, 0) >= greatest(3, ceil(0.15 * len(m))) THEN 'referenced' ELSE 'ignored' END AS outcome
  FROM placed p JOIN marks ON marks.id = p.memory_id LEFT JOIN hits USING (session_id, line_no, memory_id))"""


@query(f"WITH {_OUTCOME} SELECT * FROM outcomes")
def attribution(spark, sf):
    pending, facts = V.injections(spark, sf)
    return ledger.outcomes(pending, V.turns(spark, sf), facts).select("session_id", F.col("line_no").cast("long").alias("line_no"), F.col("memory_id").cast("long").alias("memory_id"), "prompt_turn", "outcome")


@query(f"WITH {_OUTCOME}, nxt AS (SELECT o.session_id, o.prompt_turn, arg_min(regexp_matches(t.text, '(?i)^\\s*th'), t.idx) AS corrects FROM (SELECT DISTINCT session_id, prompt_turn FROM outcomes) o JOIN turns t ON t.session_id = o.session_id AND t.role = 'user' AND t.idx > greatest(o.prompt_turn, -1) + 1 GROUP BY ALL) "
       "SELECT session_id, line_no, memory_id, CASE WHEN outcome = 'referenced' AND coalesce(corrects, false) THEN 'contradicted' ELSE outcome END AS outcome, outcome <> 'referenced' OR corrects IS NOT NULL AS settled FROM outcomes LEFT JOIN nxt USING (session_id, prompt_turn)")
def contradiction(spark, sf):
    pending, facts = V.injections(spark, sf)
    t = V.turns(spark, sf)
    return ledger.contradictions(ledger.outcomes(pending, t, facts), t, CORRECTS).select("session_id", F.col("line_no").cast("long").alias("line_no"), F.col("memory_id").cast("long").alias("memory_id"), "outcome", "settled")


_STATS = f"memory_id, injected, referenced, ignored, contradicted, tokens, {_when('last_injected')} AS last_injected, {_when('last_referenced')} AS last_referenced"


@query(f"WITH {LOG_SQL} SELECT {_STATS} FROM stats")
def ledger_stats(spark, sf):
    return ledger.stats(V.log_candidates(spark, sf)).withColumns({c: when(c) for c in ("last_injected", "last_referenced")})


@query(f"WITH {LOG_SQL} SELECT outcome, count(*) AS n FROM log WHERE injected AND outcome IS NOT NULL GROUP BY outcome")
def outcome_report(spark, sf):
    return ledger.report(V.log_candidates(spark, sf))


_QUAR = "(contradicted >= 3 AND contradicted > referenced)"


@query(f"WITH {LOG_SQL} SELECT memory_id, contradicted, referenced FROM stats WHERE {_QUAR}")
def quarantine(spark, sf):
    return ledger.stats(V.log_candidates(spark, sf)).where(ranking.quarantined()).select("memory_id", "contradicted", "referenced")


@query(f"""WITH {LOG_SQL}, j AS (SELECT session_id * 1000 + line_no AS qid, l.memory_id AS id, l.score, l.rank, s.injected, s.referenced, s.contradicted FROM log l LEFT JOIN stats s USING (memory_id) WHERE s.injected IS NULL OR NOT {_QUAR}),
b AS (SELECT *, CASE WHEN injected IS NULL THEN score ELSE least(1.0, greatest(0.0, score + 0.1::DOUBLE * (referenced - contradicted) / greatest(injected, 3))) END AS s0 FROM j),
r AS (SELECT qid, id, rank AS prior, round(CASE WHEN injected >= 8 AND referenced / injected::DOUBLE < 0.1 THEN greatest(0.0, s0 - 0.2) ELSE s0 END, 6) AS score FROM b)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prior) AS rank FROM r""")
def reinforced_ranking(spark, sf):
    log = V.log_candidates(spark, sf)
    hits = log.select((F.col("session_id") * 1000 + F.col("line_no")).alias("qid"), F.col("memory_id").alias("id"), "score", "rank")
    return _long(ranking.adjust(hits, ledger.stats(log)))


_VERDICT = f"CASE WHEN {_QUAR} THEN 'quarantined' WHEN referenced > 0 THEN 'valuable' WHEN injected >= 3 THEN 'wasteful' ELSE 'watching' END"


@query(f"WITH {LOG_SQL} SELECT memory_id, injected, referenced, ignored, contradicted, tokens, round(referenced / greatest(injected, 1)::DOUBLE, 6) AS ref_rate, {_VERDICT} AS verdict FROM stats ORDER BY tokens DESC, memory_id LIMIT 12")
def roi(spark, sf):
    return ranking.roi(ledger.stats(V.log_candidates(spark, sf)))


@query(f"WITH {LOG_SQL}, t AS (SELECT count(*) AS facts, sum(injected)::BIGINT AS injected, sum(referenced)::BIGINT AS referenced, sum(ignored)::BIGINT AS ignored, sum(contradicted)::BIGINT AS contradicted, sum(tokens)::BIGINT AS tokens FROM stats) SELECT *, round(referenced / greatest(injected, 1)::DOUBLE, 6) AS ref_rate FROM t")
def roi_totals(spark, sf):
    return ranking.roi_totals(ledger.stats(V.log_candidates(spark, sf)))


def _replay_sql(grid: str, key: str, would: str) -> str:
    return f"""WITH {LOG_SQL}, grid AS ({grid}), x AS (SELECT g.{key}, l.*, {would} AS would FROM log l CROSS JOIN grid g), turns_ AS (SELECT count(DISTINCT (session_id, line_no)) AS n FROM log),
replay AS (SELECT {key}, count(*) FILTER (injected AND outcome = 'referenced' AND would) AS kept_ref, count(*) FILTER (injected AND outcome = 'referenced' AND NOT would) AS lost_ref,
count(*) FILTER (injected AND outcome = 'ignored' AND would) AS kept_ign, count(*) FILTER (injected AND outcome = 'ignored' AND NOT would) AS cut_ign, count(*) FILTER (NOT injected AND would) AS unknown,
round(coalesce(sum(tokens) FILTER (would), 0) / any_value(n)::DOUBLE, 6) AS tok_per_turn FROM x CROSS JOIN turns_ GROUP BY {key}) """


_BY_THETA = _replay_sql("SELECT DISTINCT t::DOUBLE AS theta FROM (SELECT unnest([" + ", ".join(f"{i * 5 / 100:.2f}" for i in range(1, 20)) + "]) AS t)", "theta", f"l.score >= g.theta AND l.rank <= {K}")
_BY_K = _replay_sql(f"SELECT unnest(range(1, {K + 2}))::BIGINT AS k", "k", f"l.score >= {THETA} AND l.rank <= g.k")


@query(_BY_THETA + "SELECT * FROM replay")
def replay_threshold(spark, sf):
    return tuning.replay_threshold(V.log_candidates(spark, sf), K, THETA)


@query(_BY_THETA + f"SELECT coalesce(max(theta) FILTER (lost_ref = 0), {THETA})::DOUBLE AS theta FROM replay")
def recommend_threshold(spark, sf):
    return tuning.recommend_threshold(replay_threshold(spark, sf), THETA)


@query(_BY_K + "SELECT * FROM replay")
def replay_k(spark, sf):
    return tuning.replay_k(V.log_candidates(spark, sf), THETA, K)


@query(_BY_K + f"SELECT coalesce(min(k) FILTER (lost_ref = 0 AND k <= {K}), {K})::BIGINT AS k FROM replay")
def recommend_k(spark, sf):
    return tuning.recommend_k(replay_k(spark, sf), K)


# provenance --------------------------------------------------------------------------------------------------------------

_HASH = "sha256(concat(text, chr(0), '{\"topic\":\"' || topic || '\"}'))"


def _payload() -> Column:
    return X.payload_hash(F.col("text"), X.canonical(F.create_map(F.lit("topic"), F.col("topic"))))


def _chain(spark, sf) -> DataFrame:
    """The chain of store events: what was stored or revived."""
    ev = store.classified(V.store_events(spark, sf)).where("event <> 'repeated'")
    ev = ev.select(F.col("seq").alias("ord"), "event", F.col("id").alias("memory_id"), F.col("id").alias("lineage"), "source", X.speaker(F.col("source")).alias("speaker"), F.lit("").alias("session_id"), when("ts").alias("ts"), _payload().alias("payload_hash"))
    return provenance.append(ev, KEY)


_KINDS = f"e AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY seq) = 1 AS is_new FROM store_events), n AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY source ORDER BY seq) AS news FROM e), s AS (SELECT *, lag(news) OVER (PARTITION BY source, id ORDER BY seq) AS seen FROM n), chain AS (SELECT seq, id, {_HASH} AS h FROM s WHERE is_new OR (source NOT IN ('', 'mcp:remember') AND news > seen))"


@query(f"WITH {STORE_SQL}, {_KINDS} SELECT count(*) AS n, 0::BIGINT AS bad, NULL::BIGINT AS first_bad FROM chain")
def provenance_verify(spark, sf):
    return provenance.first_bad(provenance.verify_chain(_chain(spark, sf), KEY))


@query(f"WITH {STORE_SQL}, {_KINDS} SELECT id AS memory_id, arg_max(h, seq) AS payload_hash, 'hot' AS place FROM chain GROUP BY id")
def expected_state(spark, sf):
    return provenance.expected_state(_chain(spark, sf))


@query(f"WITH {STORE_SQL}, {_KINDS}, want AS (SELECT id, arg_max(h, seq) AS h FROM chain GROUP BY id), hot AS (SELECT id, CASE WHEN first_seq % 97 = 0 THEN sha256('x') ELSE {_HASH} END AS h FROM versions WHERE first_seq % 89 <> 1), cold AS (SELECT id, {_HASH} AS h FROM versions WHERE first_seq % 89 = 1 AND first_seq % 2 = 0) "
       "SELECT w.id AS memory_id, CASE WHEN hot.h IS NULL THEN 'missing or in the other tier' ELSE 'content differs' END AS problem FROM want w LEFT JOIN hot USING (id) WHERE hot.h IS NULL OR hot.h <> w.h")
def provenance_cross_check(spark, sf):
    v = V.memories(spark, sf)
    hot = v.where("first_seq % 89 <> 1").select("id", F.when(F.col("first_seq") % 97 == 0, F.sha2(F.lit("x"), 256)).otherwise(_payload()).alias("payload_hash"))
    cold = v.where("first_seq % 89 = 1 AND first_seq % 2 = 0").select("id", _payload().alias("payload_hash"))
    return provenance.cross_check(provenance.expected_state(_chain(spark, sf)), hot, cold)


# lifecycle ---------------------------------------------------------------------------------------------------------------

_EVIDENCE = "ev AS (SELECT v.id, sum(1 + l.quality + l.toxic)::BIGINT AS injected, sum(l.quality)::BIGINT AS referenced, sum(1 - l.quality)::BIGINT AS ignored, sum(3 * l.toxic)::BIGINT AS contradicted, max(CASE WHEN l.quality = 1 AND l.doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(l.doc_id) END) AS last_referenced FROM labels l JOIN store_events v ON v.seq = l.doc_id GROUP BY v.id)"


def _evidence(spark, sf) -> DataFrame:
    """Labels as evidence on the documents' facts."""
    ev = V.store_events(spark, sf).select("id", F.col("seq").alias("doc_id"), "ts")
    j = table(spark, sf, "labels").join(ev, "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    return j.groupBy(F.col("id").alias("memory_id")).agg(F.sum(1 + q + t).alias("injected"), F.sum(q).alias("referenced"), F.sum(1 - q).alias("ignored"), F.sum(3 * t).alias("contradicted"),
                                                         F.max(F.when((q == 1) & (F.col("doc_id") % 3 == 0), F.col("ts"))).alias("last_referenced"))


LATER = "2024-01-01 12:00:00"


@query(f"WITH {STORE_SQL}, {_EVIDENCE} SELECT id, max(reason) AS reason FROM (SELECT id, 'superseded' AS reason FROM versions WHERE superseded_at < TIMESTAMP '2024-04-01 04:00:00' - INTERVAL 90 DAY UNION ALL "
       f"SELECT id, 'quarantined' FROM ev WHERE {_QUAR} AND coalesce(last_referenced < TIMESTAMP '2024-04-01 04:00:00' - INTERVAL 60 DAY, true)) GROUP BY id")
def archive_steady(spark, sf):
    return archival.steady(V.memories(spark, sf), _evidence(spark, sf), "2024-04-01 04:00:00")


_RANKED = (STORE_SQL + ", " + _EVIDENCE + ", cand AS (SELECT v.id, recorded_at, CASE WHEN coalesce(injected, 0) > 0 AND coalesce(referenced, 0) = 0 THEN 0 ELSE 1 END AS proven, coalesce(referenced, 0) AS referenced, coalesce(ignored, 0) AS ignored, coalesce(injected, 0) AS injected, octet_length(encode(text)) AS bytes "
           "FROM versions v LEFT JOIN ev USING (id) WHERE superseded_at IS NULL AND recorded_at < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 30 DAY AND NOT list_contains(tags, 'de') AND (last_referenced IS NULL OR last_referenced < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 30 DAY)), "
           "ranked AS (SELECT *, row_number() OVER (ORDER BY proven, referenced, ignored DESC, injected DESC, recorded_at, id) AS place FROM cand)")


def _useless(spark, sf) -> DataFrame:
    return archival.useless_first(store.live(V.memories(spark, sf)), _evidence(spark, sf), "2024-01-31 12:00:00", keep="de")


@query(f"WITH {_RANKED} SELECT id, place, proven::BIGINT AS proven, referenced, ignored, injected FROM ranked")
def uselessness_rank(spark, sf):
    return archival.ranked(_useless(spark, sf)).select("id", F.col("place").cast("long").alias("place"), "proven", "referenced", "ignored", "injected")


@query(f"WITH {_RANKED}, r AS (SELECT *, sum(bytes) OVER (ORDER BY place) AS freed FROM ranked) SELECT id, place FROM r WHERE place <= ceil((SELECT coalesce(min(place) FILTER (freed >= 20000), max(place)) FROM r) / 25.0) * 25")
def archive_pressure(spark, sf):
    return archival.pressure(_useless(spark, sf), 20000).select("id", F.col("place").cast("long").alias("place"))


@query(f"WITH {STORE_SQL}, cold AS (SELECT id, superseded_at AS archived_at, octet_length(encode(text)) AS bytes FROM versions WHERE superseded_at IS NOT NULL), r AS (SELECT *, row_number() OVER w AS place, sum(bytes) OVER w AS freed FROM cold WINDOW w AS (ORDER BY archived_at, id)) "
       "SELECT id FROM r WHERE (SELECT sum(bytes) FROM cold) > 100000 AND place <= ceil((SELECT coalesce(min(place) FILTER (freed >= (SELECT sum(bytes) FROM cold) - 100000), max(place)) FROM r) / 25.0) * 25")
def purge_fifo(spark, sf):
    cold = V.memories(spark, sf).where("superseded_at IS NOT NULL").select("id", F.col("superseded_at").alias("archived_at"), F.octet_length("text").cast("long").alias("bytes"))
    return archival.purge_fifo(cold, 100000).select("id")


def _log_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").alias("session_id"))


_LINES = "lines AS (SELECT event_id AS line_no, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts, user_id AS session_id FROM events)"


@query(f"WITH {_LINES} SELECT line_no, coalesce(ts >= TIMESTAMP '{NOW}', false) AS keep FROM lines")
def rotate_log(spark, sf):
    return maintenance.rotate(_log_lines(spark, sf), NOW).select("line_no", "keep")


@query(f"WITH {_LINES}, d AS (SELECT line_no FROM lines WHERE NOT coalesce(ts >= TIMESTAMP '{NOW}', false)), c AS (SELECT session_id, max(line_no) AS log_line FROM lines GROUP BY session_id) SELECT session_id, log_line - (SELECT count(*) FROM d WHERE d.line_no < c.log_line) AS log_line FROM c")
def cursor_rebase(spark, sf):
    lines = _log_lines(spark, sf)
    return maintenance.rebase(lines.groupBy("session_id").agg(F.max("line_no").alias("log_line")), maintenance.rotate(lines, NOW).where("NOT keep").select("line_no"))


@query(f"WITH {LOG_SQL} SELECT event_id, memory_id FROM log ORDER BY event_id DESC LIMIT 200")
def prune_candidates(spark, sf):
    return maintenance.prune(V.log_candidates(spark, sf), 200, "event_id").select("event_id", "memory_id")


@query("SELECT 'store-' || n_nationkey AS name FROM nation ORDER BY n_nationkey DESC OFFSET 5")
def backup_retention(spark, sf):
    b = table(spark, sf, "nation").select(F.concat(F.lit("store-"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").alias("made_at"))
    return maintenance.backups_to_drop(b, 5).select("name")


@query("SELECT event_type, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, sf):
    from factlake.streaming.loop import hourly

    return hourly(table(spark, sf, "events")).select("event_type", when("hour").alias("hour"), "n", F.round("total", 4).alias("total"))


# ways beside the plain ones -------------------------------------------------------------------------------------------------

_STATS_DOCS = "SELECT doc_id AS memory_id, 10 AS injected, quality * 5 AS referenced, (1 - quality) * 5 AS ignored, toxic * 6 AS contradicted FROM labels"


@query(_search_sql(_DOCS, _BENCH + " WHERE item_id % 4 = 0") + f""", pool_ AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p) AS prior FROM s QUALIFY prior <= 12), st AS (SELECT memory_id, max(injected) AS injected, max(referenced) AS referenced, max(contradicted) AS contradicted FROM ({_STATS_DOCS}) GROUP BY memory_id),
j AS (SELECT p.*, st.* FROM pool_ p LEFT JOIN st ON st.memory_id = p.id WHERE injected IS NULL OR NOT {_QUAR}),
b AS (SELECT *, CASE WHEN injected IS NULL THEN score ELSE least(1.0, greatest(0.0, score + 0.1::DOUBLE * (referenced - contradicted) / greatest(injected, 3))) END AS s0 FROM j),
r AS (SELECT qid, id, prior, round(CASE WHEN injected >= 8 AND referenced / injected::DOUBLE < 0.1 THEN greatest(0.0, s0 - 0.2) ELSE s0 END, 6) AS score FROM b)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prior) AS rank FROM r WHERE score >= 0.35 QUALIFY rank <= 3""")
def context_injection(spark, sf):
    """Pool, evidence, threshold, k: in this order."""
    q, t = F.col("quality"), F.col("toxic")
    stats = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("memory_id")).agg(F.lit(10).alias("injected"), F.max(q * 5).alias("referenced"), F.max((1 - q) * 5).alias("ignored"), F.max(t * 6).alias("contradicted"))
    pool = lexical.search(_docs(spark, sf), V.benchmark_prompts(spark, sf).where("qid % 4 = 0"), 12, 0.0)
    return _long(ranking.injected(ranking.adjust(pool, stats), 3, THETA))


_COLD_SCORE = f"SELECT q.qid, d.id, round(len(list_intersect(q.terms, d.have)) / len(q.terms)::DOUBLE, 6) AS score FROM q CROSS JOIN (SELECT id, list_distinct({TOK('text')}) AS have FROM cold_docs) d WHERE len(q.terms) > 0"


@query(f"WITH q AS (SELECT qid, {_FIRST.format('t')}[1:32] AS terms FROM (SELECT item_id AS qid, {TOK('text')} AS t FROM benchmark WHERE item_id % 10 = 0)), cold_docs AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 5 = 0) SELECT * FROM ({_COLD_SCORE}) WHERE score > 0")
def search_cold(spark, sf):
    return lexical.search_cold(_docs(spark, sf).where("id % 5 = 0"), V.benchmark_prompts(spark, sf).where("qid % 10 = 0"))


_AT = f"recorded_at <= TIMESTAMP '{AS_OF}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{AS_OF}')"


@query(_search_sql("SELECT id, text, recorded_at, superseded_at FROM versions WHERE first_seq % 7 <> 0", _BENCH, _AT, head=STORE_SQL + ",") + f""", hot AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p) AS rank FROM s WHERE score >= 0.35 QUALIFY rank <= 3),
cold_docs AS (SELECT id, text FROM versions WHERE first_seq % 7 = 0 AND {_AT}), both_ AS (SELECT * FROM hot UNION ALL SELECT *, 1000000 FROM ({_COLD_SCORE}) WHERE score >= 0.35)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, id) AS rank FROM both_ QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, both_.rank, id) <= 3""")
def as_of_search_tiers(spark, sf):
    """As of an instant, over the hot and the cold tier."""
    from factlake.api import as_of_hits

    v, t = V.memories(spark, sf), F.lit(AS_OF).cast("timestamp")
    where = (F.col("recorded_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t))
    return _long(as_of_hits(v.where("first_seq % 7 <> 0"), store.at(v.where("first_seq % 7 = 0"), AS_OF), V.benchmark_prompts(spark, sf), 3, THETA, where, False))


def _terms(docs: str) -> str:
    return f"SELECT id, t, list_sort(list_distinct(t)) AS terms FROM (SELECT id, {TOK('text')} AS t FROM ({docs}))"


@query(f"WITH k AS ({_terms('SELECT doc_id AS id, CASE WHEN doc_id % 15 = 1 THEN left(text, 40) ELSE text END AS text FROM documents WHERE doc_id % 10 = 0 OR doc_id % 15 = 1 OR doc_id % 21 <> 2')}) SELECT id, len(t) AS dl, len(terms) AS n_terms, terms[1] AS first_term, len(list_filter(t, lambda x: x = terms[1])) AS first_tf FROM k")
def index_upkeep(spark, sf):
    """An index of nine documents in ten, then a generation of new, changed and removed ones: as if built anew."""
    d = _docs(spark, sf)
    first = lexical.index_rows(d.where("id % 10 <> 0"))
    changed = d.where("id % 10 = 0 OR id % 15 = 1").withColumn("text", F.when(F.col("id") % 15 == 1, F.left("text", F.lit(40))).otherwise(F.col("text")))
    index = first.unionByName(lexical.upkeep(first, changed, d.where("id % 21 = 2")))
    return lexical.current(index).select("id", F.col("dl").cast("long").alias("dl"), F.size("terms").cast("long").alias("n_terms"), F.get("terms", F.lit(0)).alias("first_term"), F.coalesce(F.get("tfs", F.lit(0)), F.lit(0)).cast("long").alias("first_tf"))


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS line_no, CAST(event_id % 50 AS VARCHAR) AS memory_id, round(value / (value + 10), 4) AS score, event_id % 3 = 0 AS injected, 10 + event_id % 40 AS tokens FROM events WHERE event_id % 13 <> 0")
def ingest_log(spark, sf):
    """Log lines as they are written, candidates as arrays, some broken."""
    from factlake.sources import tables

    e = table(spark, sf, "events")
    text = F.concat(F.lit('{"ts":"2024-01-01T00:00:00Z","session_id":"'), F.col("user_id").cast("string"), F.lit('","query":"q","candidates":[["'), (F.col("event_id") % 50).cast("string"), F.lit('",'), F.round(F.col("value") / (F.col("value") + 10), 4).cast("string"),
                    F.lit(","), F.when(F.col("event_id") % 3 == 0, "1").otherwise("0"), F.lit(","), (10 + F.col("event_id") % 40).cast("string"), F.lit('],["no score"],["x","y",1,2]]}'))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(text).alias("value"))
    return ledger.ingest(tables.records(lines)).select("session_id", "line_no", "memory_id", "score", "injected", "tokens")


@query(f"WITH {LOG_SQL} SELECT memory_id, injected, referenced, ignored, contradicted, tokens, round(referenced / greatest(injected, 1)::DOUBLE, 6) AS ref_rate, {_VERDICT} AS verdict, coalesce(left(d.text, 60), CAST(memory_id AS VARCHAR)) AS label FROM (SELECT * FROM stats ORDER BY tokens DESC, memory_id LIMIT 12) s LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = s.memory_id")
def roi_labels(spark, sf):
    return ranking.roi(ledger.stats(V.log_candidates(spark, sf)), _docs(spark, sf).where("id % 2 = 0"))


_AGAIN = "ev AS (SELECT seq, source, id, 'a' AS metadata FROM store_events UNION ALL SELECT seq + 1000000, source, id, CASE WHEN seq % 20 = 0 THEN 'b' ELSE 'a' END FROM store_events WHERE seq % 10 = 0)"


@query(f"WITH {STORE_SQL}, {_AGAIN}, e AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY seq) = 1 AS is_new, lag(metadata) OVER (PARTITION BY source, id ORDER BY seq) AS before FROM ev), n AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY source ORDER BY seq) AS news FROM e), s AS (SELECT *, lag(news) OVER (PARTITION BY source, id ORDER BY seq) AS seen FROM n) "
       "SELECT seq, id, CASE WHEN is_new THEN 'stored' WHEN source NOT IN ('', 'mcp:remember') AND news > seen THEN 'revived' WHEN metadata <> before THEN 'restated' ELSE 'repeated' END AS event FROM s")
def restated_events(spark, sf):
    """Facts that are stored again, some with other metadata."""
    ev = V.store_events(spark, sf).select("seq", "source", "text", "ts", "id", F.lit("a").alias("metadata"))
    again = ev.where("seq % 10 = 0").withColumn("metadata", F.when(F.col("seq") % 20 == 0, "b").otherwise("a")).withColumn("seq", F.col("seq") + 1000000)
    return store.classified(ev.unionByName(again)).select("seq", "id", "event")


@query(f"WITH {STORE_SQL}, {_KINDS}, c AS (SELECT row_number() OVER (ORDER BY seq) AS n FROM chain), k AS (SELECT n AS seq, n % 101 <> 0 AS own_ok, n = 1 OR (n - 1) % 211 <> 7 AS link_ok FROM c WHERE n % 211 <> 7) SELECT * FROM k WHERE NOT (own_ok AND link_ok)")
def provenance_tampered(spark, sf):
    """A chain with changed contents and deleted entries: each changed entry, and each that follows a deleted one."""
    c = _chain(spark, sf)
    bad = c.withColumn("payload_hash", F.when(F.col("seq") % 101 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("payload_hash"))).where("seq % 211 <> 7")
    return provenance.verify_chain(bad, KEY).where("NOT (own_ok AND link_ok)")


@query(f"WITH {STORE_SQL}, k AS (SELECT id, first_seq AS f, first_seq % 50 <> 3 AND first_seq % 70 <> 6 AS hot, first_seq % 50 = 3 AND first_seq % 4 <> 3 AS cold FROM versions), p AS (SELECT id AS memory_id, CASE WHEN f % 60 = 5 THEN CASE WHEN hot OR cold THEN 'no events' END WHEN f % 50 = 4 THEN CASE WHEN hot OR cold THEN 'purged but present' END "
       "WHEN (f % 50 = 3 AND NOT cold) OR (f % 50 <> 3 AND NOT hot) THEN 'missing or in the other tier' WHEN f % 50 <> 3 AND f % 97 = 0 THEN 'content differs' END AS problem FROM k) SELECT * FROM p WHERE problem IS NOT NULL")
def provenance_problems(spark, sf):
    """Stored, archived and purged facts against both tiers: all kinds of problems."""
    v = V.memories(spark, sf).select("id", "first_seq", _payload().alias("payload_hash"))
    known = v.where("first_seq % 60 <> 5").select(F.col("id").alias("memory_id"), "payload_hash", "first_seq")
    moved = F.when(F.col("first_seq") % 50 == 3, "archived").when(F.col("first_seq") % 50 == 4, "purged")
    chain = known.withColumn("event", F.lit("stored")).withColumn("seq", F.col("first_seq") * 2).unionByName(known.withColumn("event", moved).withColumn("seq", F.col("first_seq") * 2 + 1).where("event IS NOT NULL"))
    hot = v.where("first_seq % 50 <> 3 AND first_seq % 70 <> 6").select("id", F.when(F.col("first_seq") % 97 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("payload_hash")).alias("payload_hash"))
    return provenance.cross_check(provenance.expected_state(chain), hot, v.where("first_seq % 50 = 3 AND first_seq % 4 <> 3").select("id", "payload_hash"))


@query(f"WITH {STORE_SQL}, {_KINDS} SELECT 'genesis' AS event, id AS memory_id, lineage, source, {_HASH} AS payload_hash FROM versions WHERE id NOT IN (SELECT id FROM chain WHERE seq % 3 <> 0)")
def genesis_events(spark, sf):
    rows = V.memories(spark, sf).select("id", "lineage", "source", _payload().alias("payload_hash"))
    return provenance.genesis(rows, _chain(spark, sf).where("ord % 3 <> 0"))


@query(f"WITH {STORE_SQL} SELECT id, CASE WHEN first_seq % 6 = 0 AND first_seq % 12 <> 0 THEN 'cold' ELSE 'hot' END AS tier FROM versions")
def archive_restore(spark, sf):
    """Every sixth version goes to the cold tier, and half of these come back."""
    v = V.memories(spark, sf).select("id", "first_seq", "text")
    empty = v.limit(0).withColumn("archived_at", F.lit(None).cast("timestamp"))
    hot, cold = archival.move(v, empty, v.where("first_seq % 6 = 0").select("id"), NOW)
    cold, hot = archival.move(cold, hot, v.where("first_seq % 12 = 0").select("id"))
    return hot.select("id", F.lit("hot").alias("tier")).unionByName(cold.select("id", F.lit("cold").alias("tier")))


@query(f"WITH {STORE_SQL}, {LOG_SQL} SELECT (SELECT count(*) FILTER (superseded_at IS NULL) FROM versions) AS live, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM versions WHERE first_seq % 9 = 0) AS archived, count(*) AS candidates, count(*) FILTER (injected) AS injected, "
       "count(*) FILTER (injected AND outcome = 'referenced') AS referenced, count(*) FILTER (injected AND outcome = 'ignored') AS ignored, count(*) FILTER (injected AND outcome = 'contradicted') AS contradicted FROM log")
def status(spark, sf):
    v = V.memories(spark, sf)
    return maintenance.status(store.health(v), v.where("first_seq % 9 = 0"), V.log_candidates(spark, sf))


@query("SELECT vec_id AS id, label, len(embedding) AS dim FROM embeddings WHERE vec_id % 9 = 0")
def vector_lookup(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return vector.lookup(e, e.where("id % 9 = 0")).select("id", "label", F.size("embedding").cast("long").alias("dim"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id > 120 ORDER BY vec_id LIMIT 64")
def vector_scroll(spark, sf):
    return vector.scroll(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), 120, 64).select("id", "label")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
