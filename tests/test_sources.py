"""Transcripts, notes, log, streams, settings and the API on small files."""

import json
import time

from pyspark.sql import functions as F

from factlake import config
from factlake.api import Memory
from factlake.sources import tables, transcripts
from factlake.streaming import loop


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_nested_transcript(spark, tmp_path):
    lines(tmp_path / "s.jsonl", [{"type": "user", "message": {"role": "user", "content": "hi"}}, "garbage {", {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}},
                                {"type": "assistant", "isSidechain": True, "message": {"role": "assistant", "content": "side"}}, {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result"}]}}])
    assert [(r.idx, r.role, r.text) for r in transcripts.nested(spark, str(tmp_path)).orderBy("idx").collect()] == [(0, "user", "hi"), (1, "assistant", "a\nb")]


def test_rollout_and_chat(spark, tmp_path):
    (tmp_path / "r").mkdir()
    lines(tmp_path / "r" / "x.jsonl", [{"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}, {"type": "image"}]}}, {"type": "other", "payload": {"type": "reasoning"}}, {"payload": {"type": "message", "role": "assistant", "content": [{"text": "r"}]}}])
    assert [(r.role, r.text) for r in transcripts.rollout(spark, str(tmp_path / "r")).orderBy("idx").collect()] == [("user", "q"), ("assistant", "r")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text(json.dumps({"messages": [{"type": "user", "content": "q"}, {"type": "info", "content": "n"}, {"type": "gemini", "content": "r"}]}))
    lines(tmp_path / "c" / "y.json", [{"role": "human", "content": "1"}, {"role": "model", "parts": [{"text": "2"}]}])
    got = {(r.session_id, r.idx): (r.role, r.text) for r in transcripts.chat(spark, str(tmp_path / "c")).collect()}
    assert got == {("x.json", 0): ("user", "q"), ("x.json", 1): ("assistant", "r"), ("y.json", 0): ("user", "1"), ("y.json", 1): ("assistant", "2")}


def test_tail_and_facts(spark):
    t = spark.createDataFrame([("s", i, "user", "x" * 50) for i in range(5)], "session_id string, idx long, role string, text string")
    assert transcripts.tail(t, 120).first().n_turns == 2 and transcripts.tail(t, 1).first().n_turns == 1
    reply = spark.createDataFrame([('```json\n[{"text": "a", "topic": "t", "tags": ["x"]}]\n```',), ("nothing",)], "r string")
    got = [r.f for r in reply.select(transcripts.facts(F.col("r")).alias("f")).collect()]
    assert got[0][0].text == "a" and got[1] is None


def test_notes(spark, tmp_path):
    d = tmp_path / "-proj" / "memory"
    d.mkdir(parents=True)
    (d / "a.md").write_text('---\nname: "Alpha"\ndescription: what it is\ntype: feedback\n---\nbody\n')
    (d / "b.md").write_text("just text")
    (d / "c.md").write_text("---\nname: x\n---\n  \n")
    (d / "MEMORY.md").write_text("index")
    got = {r.name: (r.kind, r.text, r.source) for r in tables.notes(spark, str(tmp_path)).collect()}
    assert got == {"Alpha": ("feedback", "what it is\n\nbody", "native:proj:Alpha"), "b": ("project", "just text", "native:proj:b")}


def test_log_stream_reads_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rec = {"ts": "2024-01-01T00:00:00Z", "session_id": "s", "line_no": 1, "query": "q", "candidates": [{"id": "a", "score": 0.5, "injected": 1, "tokens": 3}]}
    lines(tmp_path / "log" / "1.json", [rec, rec, "{broken"])

    def run():
        q = loop.log_stream(spark, str(tmp_path / "log")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert tables.retrieval_log(spark, str(tmp_path / "log")).count() == 2


def test_attribution_stream(spark, tmp_path):
    marks = ["terraform", "workspace", "staging"]
    rows = [("s", "injection", 1, 7, "A", marks, False), ("s", "injection", 2, 7, "B", ["coffee"], False), ("s", "assistant", 3, 0, None, [*marks, "other"], False), ("s", "user", 4, 0, None, [], True)]
    schema = "session_id string, kind string, ts long, line_no long, memory_id string, marks array<string>, corrects boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = loop.attribute_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("outcomes").start()
    for _ in range(120):  # a processing-time timeout keeps the query going, so it is ended from here
        if spark.table("outcomes").count() >= 3:
            break
        time.sleep(0.5)
    q.stop()
    assert {(r.memory_id, r.outcome) for r in spark.table("outcomes").collect()} == {("A", "referenced"), ("A", "contradicted"), ("B", "ignored")}


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text("data_dir = 'x'\n[retrieval]\nk = 5\nthreshold = 0.5\n")
    monkeypatch.setenv("FACTLAKE_RETRIEVAL__THRESHOLD", "0.6")
    c = config.load(str(tmp_path / "c.toml"), {"retrieval": {"max_inject_chars": 9}})
    assert (c.data_dir, c.retrieval.k, c.retrieval.threshold, c.retrieval.max_inject_chars) == ("x", 5, 0.6, 9)
    (tmp_path / "d.toml").write_text(config.render(c))
    assert config.load(str(tmp_path / "d.toml")) == c


def test_memory_end_to_end(spark, tmp_path):
    m = Memory(spark, config.load(overrides={"data_dir": str(tmp_path / "mem")}))
    assert m.health()["live"] == 0 and m.manifest() == ""
    m.remember("the gateway deploys with terraform from the staging workspace", ["deploy"], "doc:gateway", "deploy", at="2024-01-01 00:00:00")
    m.remember("the team prefers tabs in python files", ["style"], topic="style", at="2024-01-02 00:00:00")
    assert "terraform" in m.recall("how does the gateway deploy")
    m.remember("the gateway deploys with helm charts now", ["deploy"], "doc:gateway", "deploy", at="2024-02-01 00:00:00")
    assert "helm" in m.recall("how does the gateway deploy") and "terraform" not in m.recall("how does the gateway deploy")
    assert "terraform" in m.recall("how does the gateway deploy", as_of="2024-01-15")
    h = m.health()
    assert (h["live"], h["versions"]) == (2, 3) and "deploy" in m.manifest()
    old = m.versions().where("superseded_at IS NOT NULL").select("id")
    gone = old.first().id
    assert m.archive(old, "2024-06-01") == 1 and m.health()["versions"] == 2
    assert "terraform" in m.recall("gateway deploys terraform staging workspace", as_of="2024-01-15")
    assert set(m.fetch([gone, "unknown"])) == {gone}
    prompts = spark.createDataFrame([(1, "how does the gateway deploy"), (2, "thanks!")], "qid long, query string")
    assert [r.qid for r in m.context(prompts).collect()] == [1]
    assert m.chain(b"k").count() == 3


def test_log_as_it_is_written(spark, tmp_path):
    """Candidates as arrays, lines numbered by their place, malformed ones skipped, records made from a pool and read back."""
    lines = ['{"ts":"2024-01-01T00:00:00+00:00","session_id":"s","query":"q","tier":"tier2","injected_ids":["a"],"scores":[0.9],"candidates":[["a",0.9,1,12],["b",0.4,0,7],["bad"],["c","x",0,1]]}',
             "no json", '{"ts":"2024-01-02T00:00:00+00:00","session_id":"t","query":"r","candidates":[]}', '{"session_id":"s","ts":"2024-01-03T00:00:00+00:00","query":"z","candidates":[["a",0.5,0,12]]}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    got = tables.retrieval_log(spark, str(tmp_path / "log.jsonl"))
    rows = {(r.session_id, r.line_no, c.id, c.score, c.injected, c.tokens) for r in got.collect() for c in r.candidates}
    assert rows == {("s", 0, "a", 0.9, 1, 12), ("s", 0, "b", 0.4, 0, 7), ("s", 3, "a", 0.5, 0, 12)} and got.count() == 3
    from factlake.operators import ledger

    assert ledger.ingest(got).count() == 3
    pool = spark.createDataFrame([(1, 'x"y', 0.91234, 1, "text of some length"), (1, "z", 0.2, 2, "t")], "qid long, id string, score double, rank int, text string")
    prompts = spark.createDataFrame([(1, "s", 'say "hi"'), (2, "s", "none")], "qid long, session_id string, query string")
    tables.write_log(tables.log_records(pool, pool.where("rank = 1").select("qid", "id"), prompts, "2024-01-04T00:00:00Z"), str(tmp_path / "own"))
    back = {r["query"]: r for r in tables.retrieval_log(spark, str(tmp_path / "own")).collect()}
    assert [tuple(c) for c in back['say "hi"'].candidates] == [('x"y', 0.9123, 1, 4), ("z", 0.2, 0, 1)] and back['say "hi"'].injected_ids == ['x"y'] and back["none"].candidates == []
    assert [r.line_no for r in tables.newest(spark, str(tmp_path / "log.jsonl"), len(lines[3]) + 10).collect()] == [3]


def test_tiers_and_the_stored_chain(spark, tmp_path):
    m = Memory(spark, config.load(overrides={"data_dir": str(tmp_path / "m")}))
    for k in range(6):
        m.remember(f"the service number {k} lives in cluster {'abcdef'[k]}", topic="ops", at=f"2024-01-0{k + 1} 00:00:00")
    key = b"key"
    assert m.seal(key) == 6 and m.seal(key) == 0
    ids = [r.id for r in m.versions().orderBy("first_seq").collect()]
    pick = lambda *n: spark.createDataFrame([(ids[x],) for x in n], "id string")
    assert m.archive(pick(0, 1, 2), "2024-02-01 00:00:00") == 3 and m.archive(pick(3), "2024-02-02 00:00:00") == 1
    assert m.restore(pick(1, 5)) == 1 and m.health()["versions"] == 3 and m.cold().count() == 3
    assert m.verify(key)["problems"] == {"missing or in the other tier": 3}  # not sealed yet
    assert m.seal(key) == 5 and m.verify(key) == {"n": 11, "bad": 0, "first_bad": None, "problems": {}}
    assert m.purge(10**9) == 0 and m.purge(1, "2024-03-01 00:00:00") == 3 and m.cold().count() == 0
    assert m.seal(key) == 3 and m.verify(key)["problems"] == {} and m.status()["moves"] == {"archived": 4, "restored": 1, "purged": 3}
    assert m.versions_full().count() == 3
    m.reindex()
    m.archive(pick(4))
    m.remember("a new service lives nowhere yet")
    m.keep_index()
    assert {r.id for r in m.index().collect()} == {r.id for r in m.versions().collect()}
    steps = m.maintain(spark.createDataFrame([], "memory_id string, injected long, referenced long, ignored long, contradicted long, last_referenced timestamp"), key)
    assert [s[1] for s in steps] == ["ok"] * len(steps), steps


def test_evidence_comes_before_the_threshold(spark, tmp_path):
    m = Memory(spark, config.load(overrides={"data_dir": str(tmp_path / "m")}))
    for t in ("alpha beta gamma delta epsilon", "alpha beta gamma zeta eta theta", "alpha other words here", "nothing in common at all", "still more text without it"):
        m.remember(t)
    prompts = spark.createDataFrame([(1, "alpha beta gamma delta")], "qid long, query string")
    plain = m.search(prompts, 3, 0.0).orderBy("rank").collect()
    assert len(plain) == 3 and m.search(prompts, 0).count() == 0 and m.search(prompts, -1).count() == 0
    second, cut = plain[1], (plain[1].score + plain[2].score) / 2
    stats = spark.createDataFrame([(plain[0].id, 9, 0, 5, 4, 1), (plain[2].id, 3, 3, 0, 0, 1)], "memory_id string, injected long, referenced long, ignored long, contradicted long, tokens long")
    best = m.search(prompts, 1, cut, stats=stats).collect()
    assert [r.id for r in best] == [second.id]  # the first is quarantined, so the pool's next takes its place
    low = m.search(prompts, 3, plain[2].score + 0.05, stats=stats).collect()
    assert plain[2].id in {r.id for r in low}  # evidence lifts it above the threshold
