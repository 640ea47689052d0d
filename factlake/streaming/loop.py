"""The outcome loop as streams: retrieval log in, outcomes and statistics out; and windowed activity."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record as it is written: candidates are arrays [id, score, injected, tokens]; objects of these names are read as well.
RECORD = "ts timestamp, session_id string, line_no long, query string, tier string, injected_ids array<string>, scores array<double>, candidates array<string>"
LOG = ("ts timestamp, session_id string, line_no long, query string, tier string, injected_ids array<string>, scores array<double>, "
       "candidates array<struct<id:string,score:double,injected:int,tokens:int>>")


def candidates(c: Column) -> Column:
    """Candidates of a record's elements, each an array or an object in JSON; those that lack a part are left out."""

    def one(x: Column) -> Column:
        listed = F.from_json(x, "array<string>")
        named = F.from_json(x, "struct<id:string,score:double,injected:int,tokens:int>")
        part = lambda k, kind: F.get(listed, F.lit(k)).try_cast(kind)
        own = F.struct(part(0, "string").alias("id"), part(1, "double").alias("score"), part(2, "int").alias("injected"), part(3, "int").alias("tokens"))
        return F.when(x.startswith("["), own).otherwise(named)

    return F.filter(F.transform(c, one), lambda x: x["id"].isNotNull() & x["score"].isNotNull() & x["injected"].isNotNull() & x["tokens"].isNotNull())


def log_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """New candidates of a folder of JSON log files; files are read once (checkpoint), repeats within the watermark drop, malformed lines too.

    Records don't know their line, so in a stream a turn is known by its time in microseconds unless it has a line_no.
    """
    raw = spark.readStream.schema(RECORD).option("mode", "PERMISSIVE").json(folder).where("session_id IS NOT NULL AND ts IS NOT NULL")
    flat = raw.select("session_id", F.coalesce("line_no", F.unix_micros("ts")).alias("line_no"), "ts", "query", F.inline(candidates(F.col("candidates"))))
    return flat.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "line_no", "id"])


def hourly(events: DataFrame) -> DataFrame:
    """Events of each type in tumbling hours; for batches and streams (add a watermark on ts first)."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def attribute_stream(turns_and_injections: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """(session_id, line_no, memory_id, outcome) from a stream of one session's rows: kind, ts, line_no, memory_id, text, marks, corrects.

    A fact is referenced as soon as three distinctive words or 15 % of them have occurred in what the assistant has said
    since its prompt. The next user turn after an answer settles the rest: it makes a reference a contradiction if it
    corrects, and what isn't referenced by then is ignored, as is what still waits when a session has been idle for
    longer than the timeout. (The batch looks at all later turns.) State of a session: what waits, with those of its own
    words that were said, so it doesn't grow with the talk. Rows that come in a later micro-batch are judged in the order
    in which they come.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    minutes = int(idle.split()[0])
    out = "session_id string, line_no long, memory_id string, outcome string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # what waits: line, fact, words of its own, those that were said, whether an assistant has answered
        waiting = [json.loads(x) for x in state.get[0]] if state.exists else []
        settled: list[tuple] = []

        def used(x: list) -> bool:
            return bool(x[2]) and len(x[3]) >= max(3, -(-15 * len(x[2]) // 100))

        if state.hasTimedOut:
            settled += [(key[0], x[0], x[1], "ignored") for x in waiting if not used(x)]
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for r in rows.itertuples():
                marks = list(r.marks) if r.marks is not None else []
                if r.kind == "injection":
                    waiting.append([int(r.line_no), r.memory_id, sorted(set(marks)), [], False])
                elif r.kind == "assistant":
                    said = set(marks)
                    for x in waiting:
                        before = used(x)
                        x[3], x[4] = sorted(set(x[3]) | said.intersection(x[2])), True
                        if used(x) and not before:
                            settled.append((key[0], x[0], x[1], "referenced"))
                elif r.kind == "user":
                    for x in waiting:
                        if x[4] and not used(x):
                            settled.append((key[0], x[0], x[1], "ignored"))
                        elif x[4] and r.corrects:
                            settled.append((key[0], x[0], x[1], "contradicted"))
                    waiting = [x for x in waiting if not x[4]]
            state.update(([json.dumps(x) for x in waiting],))
            state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame(settled, columns=["session_id", "line_no", "memory_id", "outcome"])

    return turns_and_injections.groupBy("session_id").applyInPandasWithState(step, out, "waiting array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
