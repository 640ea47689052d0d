"""The engine's tables: store events, tiers, retrieval log, snapshots; and markdown notes as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.functions.text import strip, tokens_estimate
from factlake.streaming.loop import RECORD, candidates

EVENTS = "seq long, source string, text string, ts timestamp, topic string, tags array<string>, metadata string"
MOVES = "n long, event string, id string, lineage string, source string, payload_hash string, ts timestamp"
CHAIN = "log int, n long, event string, memory_id string, lineage string, source string, speaker string, session_id string, ts string, payload_hash string, seq long, prev_hash string, entry_hash string"
COLD = "id string, lineage string, text string, source string, topic string, tags array<string>, recorded_at timestamp, superseded_at timestamp, updated_at timestamp, archived_at timestamp, bytes long"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table there; an empty one if there is none yet."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes df beside the table there and puts it in its place; df mustn't read that table."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs = spark._jvm.org.apache.hadoop.fs
    old, new = fs.Path(path), fs.Path(f"{path}.new")
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(old, True)
    system.rename(new, old)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): a text file's lines with their numbers from 0, counted by blocks in parallel."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    own = raw.withColumn("n", F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1)
    counts = raw.groupBy("file", "block").count()
    before = counts.select("file", "block", F.coalesce(F.sum("count").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.join(before, ["file", "block"]).select("file", (F.col("n") + F.col("before")).alias("line_no"), "value")


def newest(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(file, line_no, value) of the lines that begin within the newest so many bytes of a file; a line that is cut there is left out."""
    lines = numbered(spark, path).withColumn("size", F.octet_length("value") + 1)
    w = W.partitionBy("file").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("from_end", F.sum("size").over(w)).where(F.col("from_end") <= most).select("file", "line_no", "value")


def records(lines: DataFrame) -> DataFrame:
    """Log records of (line_no, value) lines; malformed ones and those without a session are left out. A record's place is its line."""
    own = lines.select("line_no", F.from_json("value", RECORD).alias("r")).where("r.session_id IS NOT NULL")
    return own.select("r.ts", "r.session_id", F.coalesce("r.line_no", "line_no").alias("line_no"), "r.query", "r.tier", "r.injected_ids", "r.scores", candidates(F.col("r.candidates")).alias("candidates"))


def retrieval_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log file or folder."""
    return records(numbered(spark, path))


def log_records(pool: DataFrame, injected: DataFrame, prompts: DataFrame, ts: str, clip: int = 600) -> DataFrame:
    """Records of one batch: each prompt (qid, session_id, query) with its pool (qid, id, score, rank, text) and what of it was injected (qid, id)."""
    own = pool.join(injected.select("qid", "id", F.lit(1).alias("used")), ["qid", "id"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    one = F.struct("rank", "id", F.round("score", 4).alias("score"), "used", tokens_estimate(F.col("text"), clip).alias("tokens"))
    got = own.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("c"))
    row = prompts.join(got, "qid", "left")
    c = F.coalesce("c", F.array().cast(got.schema["c"].dataType))
    text = lambda f: F.transform(c, lambda x: f(x))
    shown = F.filter(c, lambda x: x["used"] == 1)
    as_json = F.concat(F.lit("["), F.array_join(text(lambda x: F.concat(F.lit("["), F.to_json(F.array(x["id"].cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(x["id"].cast("string")))) - 2), F.lit(","), x["score"].cast("string"), F.lit(","), x["used"].cast("string"), F.lit(","), x["tokens"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    head = F.to_json(F.struct(F.lit(ts).alias("ts"), F.col("session_id"), F.left("query", F.lit(500)).alias("query"), F.lit("tier2").alias("tier"), F.transform(shown, lambda x: x["id"].cast("string")).alias("injected_ids"), F.transform(shown, lambda x: x["score"]).alias("scores")))
    return row.select(F.concat(F.left(head, F.length(head) - 1), F.lit(',"candidates":'), as_json, F.lit("}")).alias("value"))


def write_log(lines: DataFrame, path: str) -> None:
    """Appends records, one JSON text a row."""
    lines.select("value").write.mode("append").text(path)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as facts (path, project, name, description, kind, text, source); the index file and empty ones are left out.

    A front matter's name, description and type are read; without them the file's name and ``project`` hold.
    """
    raw = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    raw = raw.where("file <> 'MEMORY.md'")
    head = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    field = lambda n: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^\s*{n}\s*:\s*[\"']?(.*?)[\"']?\s*$", 1)), F.lit(""))
    body = strip(F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", ""))
    stem = F.regexp_replace("file", r"\.md$", "")
    project = F.regexp_replace(F.element_at(F.split("path", "/"), -3), "^-+", "")
    own = raw.select("path", project.alias("project"), F.coalesce(field("name"), stem).alias("name"), F.coalesce(field("description"), F.lit("")).alias("description"), F.coalesce(field("type"), F.lit("project")).alias("kind"), body.alias("body")).where("body <> ''")
    text = F.when(F.col("description") == "", F.col("body")).otherwise(F.concat_ws("\n\n", "description", "body"))
    return own.select("path", "project", "name", "description", "kind", text.alias("text"), F.concat_ws(":", F.lit("native"), "project", "name").alias("source"))
