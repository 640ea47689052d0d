"""Transcripts of three clients as turns (session_id, idx, role, text), and their newest part as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.functions.text import strip

_BLOCK = "array<struct<type:string,text:string>>"
USERS, ASSISTANTS = ("user", "human"), ("assistant", "model", "ai", "gemini")


def flatten(content: Column) -> Column:
    """The text of a message: a JSON string, or the texts of a list of blocks, one on each line."""
    blocks = F.from_json(content, _BLOCK)
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "\n")
    return F.when(content.startswith("["), joined).otherwise(content)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON files with their file and place in it; files are read whole, so a session should be one file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("session_id"), "value")
    return files.select("session_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def _numbered(rows: DataFrame) -> DataFrame:
    own = rows.where(F.col("role").isin("user", "assistant") & (strip(F.coalesce("text", F.lit(""))) != ""))
    return own.select("session_id", (F.row_number().over(W.partitionBy("session_id").orderBy("line_no", "pos")) - 1).alias("idx"), "role", "text")


def nested(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {type, isSidechain, message: {role, content}}: side chains and entries without text are left out."""
    j = F.get_json_object
    rows = _lines(spark, path).select("session_id", "line_no", F.lit(0).alias("pos"), F.coalesce(j("line", "$.message.role"), j("line", "$.type")).alias("role"), flatten(j("line", "$.message.content")).alias("text"), j("line", "$.isSidechain").alias("side"))
    return _numbered(rows.where("coalesce(side, 'false') <> 'true'"))


def rollout(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {type, payload: {type: message, role, content: [...]}}."""
    j = F.get_json_object
    rows = _lines(spark, path).where(j("line", "$.payload.type") == "message")
    return _numbered(rows.select("session_id", "line_no", F.lit(0).alias("pos"), j("line", "$.payload.role").alias("role"), flatten(j("line", "$.payload.content")).alias("text")))


def chat(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document with a list of entries under one of several names, a bare list, or JSON lines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("session_id"), strip(F.col("value")).alias("value"))
    j = F.get_json_object
    inside = F.coalesce(*[j("value", f"$.{k}") for k in ("messages", "history", "turns", "conversation", "entries")], F.when(F.col("value").startswith("["), F.col("value")))
    entry = "array<struct<type:string,role:string,content:string,text:string,parts:string,message:string>>"
    listed = F.from_json(inside, entry)
    lines = F.transform(F.split("value", "\n"), lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), entry), F.lit(0)))
    rows = files.select("session_id", F.posexplode(F.coalesce(listed, lines)).alias("line_no", "e")).where("e IS NOT NULL")
    said = F.lower(F.coalesce(F.col("e.role"), F.col("e.type"), F.lit("")))
    role = F.when(said.isin(*USERS), "user").when(said.isin(*ASSISTANTS), "assistant")
    return _numbered(rows.select("session_id", "line_no", F.lit(0).alias("pos"), role.alias("role"), flatten(F.coalesce(F.col("e.content"), F.col("e.text"), F.col("e.parts"), F.col("e.message"))).alias("text")))


def tail(turns: DataFrame, budget: int = 60_000, per_turn: int = 2_000) -> DataFrame:
    """(session_id, n_turns, rendered): each session's newest turns within a budget of characters, one at least."""
    block = F.concat(F.upper("role"), F.lit(": "), F.left("text", F.lit(per_turn)))
    w = W.partitionBy("session_id").orderBy(F.desc("idx"))
    own = turns.select("session_id", "idx", block.alias("block")).withColumn("rn", F.row_number().over(w)).withColumn("used", F.sum(F.length("block")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    kept = own.where((F.col("rn") == 1) | (F.col("used") <= budget)).groupBy("session_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("idx", "block"))).alias("b"))
    return kept.select("session_id", "n_turns", F.array_join("b.block", "\n\n").alias("rendered"))


def facts(reply: Column) -> Column:
    """The facts of an extraction reply: the outermost JSON list of {text, topic, tags}, fenced or not."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<text:string,topic:string,tags:array<string>>>")
