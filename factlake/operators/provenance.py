"""Tamper evidence: an HMAC chain over store events, verified in parallel, and a check of both tiers against it."""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake.functions.text import hmac_sha256

START = "0" * 64
CONTENT = ("stored", "revived", "restated", "genesis")
FIELDS = ("event", "memory_id", "lineage", "source", "speaker", "session_id", "ts", "payload_hash")


def load_key(path: str) -> bytes:
    """The key in that file, made with mode 0600 if there is none."""
    if not os.path.exists(path):
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(fd, "wb") as f:
            f.write(secrets.token_bytes(32))
    with open(path, "rb") as f:
        return f.read()


def message(cols: tuple[str, ...] = FIELDS) -> Column:
    """An event in canonical form: JSON of its fields in fixed order, nulls as empty strings."""
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]))


def append(ev: DataFrame, key: bytes, previous: str = START, first_seq: int = 1) -> DataFrame:
    """Chained events (seq, prev_hash, entry_hash) of one batch, ordered by ``ord``.

    Each entry hashes the one before, so one task walks along the batch. It gets the events' digests only, made in
    parallel before, and streams them: its memory doesn't grow with the batch.
    """
    own = ev.withColumn("digest", F.sha2(message(), 256))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, seq = previous, first_seq
        for b in batches:
            before, entry, first = [], [], seq
            for d in b.column(1).to_pylist():
                before.append(prev)
                prev = hmac.new(key, (prev + d).encode(), hashlib.sha256).hexdigest()
                entry.append(prev)
                seq += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(first, seq), pa.int64()), pa.array(before, pa.string()), pa.array(entry, pa.string())], ["ord", "seq", "prev_hash", "entry_hash"])

    links = own.select(F.col("ord").cast("long").alias("ord"), "digest").repartition(1).sortWithinPartitions("ord").mapInArrow(walk, "ord long, seq long, prev_hash string, entry_hash string")
    return own.join(links, "ord").drop("digest")


def verify_chain(chain: DataFrame, key: bytes, start: str = START) -> DataFrame:
    """(seq, own_ok, link_ok) of all entries: each hash is made anew from the stored one before, in parallel.

    The link is an equi-join with the entry before, not a window over all of it, so no task holds the chain. A deleted
    entry breaks the link of the next.
    """
    own = chain.withColumn("own_ok", hmac_sha256(key, F.concat(F.col("prev_hash"), F.sha2(message(), 256))) == F.col("entry_hash"))
    before = chain.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("before"))
    return own.join(before, "seq", "left").select("seq", "own_ok", (F.col("prev_hash") == F.when(F.col("seq") == 1, F.lit(start)).otherwise(F.coalesce("before", F.lit("")))).alias("link_ok"))


def first_bad(checked: DataFrame) -> DataFrame:
    """(n, bad, first_bad): a chain's verdict."""
    good = F.col("own_ok") & F.col("link_ok")
    return checked.agg(F.count("*").alias("n"), F.count_if(~good).alias("bad"), F.min(F.when(~good, F.col("seq"))).alias("first_bad"))


def expected_state(chain: DataFrame) -> DataFrame:
    """(memory_id, payload_hash, place): what each fact's last events say it is and where."""
    content = F.col("event").isin(*CONTENT)
    place = F.when(F.col("event") == "archived", "cold").when(F.col("event") == "purged", "gone").when(F.col("event") != "superseded", "hot")
    return chain.groupBy("memory_id").agg(F.max_by(F.when(content, F.col("payload_hash")), F.when(content, F.col("seq"))).alias("payload_hash"), F.max_by(place, F.when(place.isNotNull(), F.col("seq"))).alias("place"))


def cross_check(expected: DataFrame, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """(memory_id, problem) of facts whose rows and events disagree. Tiers need (id, payload_hash)."""
    tiers = hot.select("id", F.col("payload_hash").alias("hot")).join(cold.select("id", F.col("payload_hash").alias("cold")), "id", "full_outer")
    x = expected.join(tiers, expected.memory_id == tiers.id, "full_outer").select(F.coalesce("memory_id", "id").alias("memory_id"), "payload_hash", "place", "hot", "cold", F.col("memory_id").isNull().alias("unknown"))
    there = F.when(F.col("place") == "hot", F.col("hot")).otherwise(F.col("cold"))
    problem = (F.when(F.col("unknown"), "no events").when((F.col("place") == "gone") & (F.col("hot").isNotNull() | F.col("cold").isNotNull()), "purged but present")
               .when((F.col("place") != "gone") & there.isNull(), "missing or in the other tier").when((F.col("place") != "gone") & (there != F.col("payload_hash")), "content differs"))
    return x.select("memory_id", problem.alias("problem")).where("problem IS NOT NULL")


def uncovered(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """Rows without any event; they get genesis events."""
    return rows.join(chain.select(F.col("memory_id").alias("id")).distinct(), "id", "left_anti")


def genesis(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """(event, memory_id, lineage, source, payload_hash) for rows (id, lineage, source, payload_hash) that no event covers."""
    return uncovered(rows, chain).select(F.lit("genesis").alias("event"), F.col("id").alias("memory_id"), "lineage", "source", "payload_hash")
