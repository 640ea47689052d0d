"""A memory engine over a folder of tables: remember, recall, record outcomes, keep house."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factlake import config as C
from factlake import shared
from factlake.functions import text as X
from factlake.operators import archival, lexical, maintenance, manifest, provenance, ranking, store
from factlake.sources import tables


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


class Memory:
    """Facts in one folder. Writes append events; all state is derived from them."""

    def __init__(self, spark: SparkSession, settings: C.Config | None = None):
        self.spark, self.config = spark, settings or C.load()
        self.folder = self.config.data_dir
        self.manifests = manifest.Cache()

    # tables ---------------------------------------------------------------------------------------------------------

    def events(self) -> DataFrame:
        return store.events(tables.read_or_empty(self.spark, f"{self.folder}/events", tables.EVENTS))

    def moves(self) -> DataFrame:
        """What was archived, restored and purged, in order."""
        return tables.read_or_empty(self.spark, f"{self.folder}/moves", tables.MOVES)

    def places(self) -> DataFrame:
        """(id, event) of the last move of each version that has moved."""
        return self.moves().groupBy("id").agg(F.max_by("event", "n").alias("event"))

    def cold(self) -> DataFrame:
        """The cold tier: the latest archived row of each version that was archived last."""
        rows = tables.read_or_empty(self.spark, f"{self.folder}/cold", tables.COLD)
        cols = [c for c in rows.columns if c != "id"]
        latest = rows.groupBy("id").agg(F.max_by(F.struct(*cols), "archived_at").alias("r")).select("id", "r.*").select(*rows.columns)
        return latest.join(self.places().where("event = 'archived'"), "id", "left_semi")

    def versions(self) -> DataFrame:
        """All versions of the hot tier."""
        return store.versions(self.events()).join(self.places().where("event <> 'restored'"), "id", "left_anti")

    def versions_full(self) -> DataFrame:
        """All versions of both tiers, with their tier."""
        hot = self.versions()
        cols = ["id", "lineage", "text", "source", "topic", "tags", "recorded_at", "superseded_at", "updated_at"]
        return hot.select(*cols, F.lit("hot").alias("tier")).unionByName(self.cold().select(*cols, F.lit("cold").alias("tier")))

    # writing ----------------------------------------------------------------------------------------------------------

    def remember_all(self, facts: DataFrame, at: str | None = None) -> None:
        """Stores facts (text, and optionally source, topic, tags, metadata) in their order as one batch."""
        last = self.events().agg(F.max("seq")).first()[0]
        base = 0 if last is None else last + 1
        for name, kind in (("source", "string"), ("topic", "string"), ("tags", "array<string>"), ("metadata", "string")):
            if name not in facts.columns:
                facts = facts.withColumn(name, F.lit(None).cast(kind))
        rows = facts.withColumn("seq", F.monotonically_increasing_id() + base).withColumn("ts", F.lit(at or now()).cast("timestamp"))
        tables.append(rows.select("seq", F.coalesce("source", F.lit("mcp:remember")).alias("source"), "text", "ts", "topic", "tags", "metadata"), f"{self.folder}/events")

    def remember(self, text: str, tags: list[str] | None = None, source: str | None = None, topic: str | None = None, at: str | None = None) -> None:
        self.remember_all(self.spark.createDataFrame([(text, source, topic, tags)], "text string, source string, topic string, tags array<string>"), at)

    # reading -----------------------------------------------------------------------------------------------------------

    def pool(self, prompts: DataFrame, k: int, stats: DataFrame | None = None) -> DataFrame:
        """(qid, id, score, rank) of each prompt's candidates, whatever their score, in the order that evidence gives them."""
        hits = lexical.search(self.versions(), prompts, max(k, self.config.ledger.pool_k), 0.0, F.col("superseded_at").isNull(), self.config.lexical.stemmed)
        return hits if stats is None else ranking.adjust(hits, stats)

    def search(self, prompts: DataFrame, k: int | None = None, theta: float | None = None, as_of: str | None = None, stats: DataFrame | None = None) -> DataFrame:
        """(qid, id, score, rank, text, superseded_at) for prompts (qid, query); nothing for k of 0 or less.

        Candidates are ranked by evidence first (with stats), and of those that then reach the threshold come the first k.
        With as_of, versions count that held then, archived ones too.
        """
        r = self.config.retrieval
        k, theta = r.k if k is None else k, r.threshold if theta is None else theta
        v = self.versions()
        texts = v.select("id", "text", "superseded_at")
        if as_of:
            t = F.lit(X.as_of(as_of)).cast("timestamp")
            where = (F.col("recorded_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t))
            old = store.at(self.cold(), X.as_of(as_of))
            hits = as_of_hits(v, old, prompts, k, theta, where, self.config.lexical.stemmed)
            texts = texts.unionByName(old.select("id", "text", "superseded_at"))
        else:
            hits = ranking.injected(self.pool(prompts, max(k, 0), stats), k, theta)
        return hits.join(texts, "id")

    def recall(self, query: str, k: int | None = None, as_of: str | None = None) -> str:
        """The best facts for a query as text, each with its relevance and, as of an instant, whether it still holds."""
        rows = self.search(self.spark.createDataFrame([(0, query)], "qid long, query string"), k, as_of=as_of).orderBy("rank").collect()
        mark = lambda r: "" if not as_of else " [superseded since]" if r.superseded_at else " [still current]"
        return "\n".join(f"- {r.text}  (relevance {r.score:.2f}){mark(r)}" for r in rows) or "Nothing is known about this."

    def context(self, prompts: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        """(qid, context): what to show with each prompt that needs retrieval, clipped facts under one heading."""
        need = prompts.where(~X.skip_retrieval(F.col("query")))
        return ranking.context(self.search(need, stats=stats), self.config.retrieval.max_inject_chars)

    def envelope(self, prompts: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        """(qid, json): the same as a hook's answer."""
        inner = F.struct(F.lit("UserPromptSubmit").alias("hookEventName"), F.col("context").alias("additionalContext"))
        return self.context(prompts, stats).select("qid", F.to_json(F.struct(inner.alias("hookSpecificOutput"))).alias("json"))

    def fetch(self, ids: list[str]) -> dict[str, str]:
        rows = store.fetch(self.versions(), self.spark.createDataFrame([(i,) for i in ids], "id string"), self.cold())
        return {r.id: r.text for r in rows.collect()}

    def health(self) -> dict[str, Any]:
        return store.health(self.versions()).first().asDict()

    def manifest(self) -> str:
        h, m = self.health(), self.config.manifest
        return self.manifests.get(h["revision"] or "", lambda: manifest.render(store.live(self.versions()), h["live"], m.max_topics, m.full_below, m.token_budget))

    # lifecycle -----------------------------------------------------------------------------------------------------------

    def _move(self, rows: DataFrame, event: str, at: str | None) -> int:
        """Notes a move of (id, lineage, source, payload_hash); returns how many rows."""
        last = self.moves().agg(F.max("n")).first()[0]
        base = 0 if last is None else last + 1
        own = rows.select((F.monotonically_increasing_id() + base).alias("n"), F.lit(event).alias("event"), "id", "lineage", "source", "payload_hash", F.lit(at or now()).cast("timestamp").alias("ts"))
        tables.append(own, f"{self.folder}/moves")
        return self.moves().where(F.col("n") >= base).count()

    def archive(self, ids: DataFrame, at: str | None = None) -> int:
        """Moves versions to the cold tier, with an event each; returns how many."""
        rows = self.versions().join(ids.select("id").distinct(), "id", "left_semi").withColumn("archived_at", F.lit(at or now()).cast("timestamp")).withColumn("bytes", F.octet_length("text").cast("long"))
        cols = [c.split()[0] for c in tables.COLD.split(", ")]
        settled = shared.settled(rows.select(*cols, payload().alias("payload_hash")), "archived")
        tables.append(settled.select(*cols), f"{self.folder}/cold")
        return self._move(settled, "archived", at)

    def restore(self, ids: DataFrame, at: str | None = None) -> int:
        """Moves versions back to the hot tier, with an event each; returns how many."""
        rows = self.cold().join(ids.select("id").distinct(), "id", "left_semi").select("id", "lineage", "source", "text")
        own = rows.join(store.versions(self.events()).select("id", payload().alias("payload_hash")), "id")
        return self._move(shared.settled(own, "restored"), "restored", at)

    def purge(self, cap_bytes: int, at: str | None = None) -> int:
        """Deletes archived versions for good, oldest first, until the cold tier fits, with an event each; returns how many.

        The cold table is written anew without them; their store events stay as history but give no version any more.
        """
        cold = self.cold()
        gone = shared.settled(archival.purge_fifo(cold.select("id", "archived_at", "bytes"), cap_bytes).select("id"), "purged")
        own = cold.join(gone, "id", "left_semi").select("id", "lineage", "source").join(store.versions(self.events()).select("id", payload().alias("payload_hash")), "id")
        n = self._move(shared.settled(own, "purged"), "purged", at)
        if n:
            tables.replace(shared.settled(tables.read_or_empty(self.spark, f"{self.folder}/cold", tables.COLD).join(gone, "id", "left_anti"), "cold"), f"{self.folder}/cold")
        return n

    def archive_steady(self, stats: DataFrame, at: str | None = None) -> int:
        a = self.config.archival
        return self.archive(archival.steady(self.versions(), stats, at or now(), a.superseded_after_days, a.quarantined_after_days), at)

    def chain_events(self) -> DataFrame:
        """All events of the store and of its tiers in one order: what a chain is made of."""
        ev = store.classified(self.events()).where("event <> 'repeated'").select(F.col("seq").alias("n"), F.lit(0).alias("log"), "event", "id", F.col("id").alias("lineage"), "source", "ts", payload().alias("payload_hash"))
        mv = self.moves().select("n", F.lit(1).alias("log"), "event", "id", "lineage", "source", "ts", "payload_hash")
        own = ev.unionByName(mv)
        return own.select("log", "n", "event", F.col("id").alias("memory_id"), "lineage", "source", X.speaker(F.col("source")).alias("speaker"), F.lit("").alias("session_id"), F.col("ts").cast("string").alias("ts"), "payload_hash")

    def sealed(self) -> DataFrame:
        """The stored chain."""
        return tables.read_or_empty(self.spark, f"{self.folder}/chain", tables.CHAIN)

    def seal(self, key: bytes) -> int:
        """Appends what has happened since to the stored chain; returns how many entries."""
        last = self.sealed().agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("l")).first()["l"]
        new = self.chain_events().join(self.sealed().select("log", "n"), ["log", "n"], "left_anti")
        # one order for both logs: by time, then log and number
        ranked = new.withColumn("ord", F.row_number().over(W.orderBy("ts", "log", "n")))
        made = provenance.append(ranked, key, last["entry_hash"] if last else provenance.START, last["seq"] + 1 if last else 1)
        made = shared.settled(made.select(*[c.split()[0] for c in tables.CHAIN.split(", ")]), "chain")
        tables.append(made, f"{self.folder}/chain")
        return made.count()

    def chain(self, key: bytes) -> DataFrame:
        """The provenance chain of the store events alone, made in one pass and not stored; ``seal`` keeps one of all events."""
        return provenance.append(self.chain_events().where("log = 0").withColumn("ord", F.row_number().over(W.orderBy("ts", "log", "n"))), key)

    def verify(self, key: bytes) -> dict[str, Any]:
        """The stored chain's verdict, and the problems of both tiers against it."""
        chain = self.sealed()
        out = provenance.first_bad(provenance.verify_chain(chain, key)).first().asDict()
        content = store.versions(self.events()).select("id", payload().alias("payload_hash"))
        hot = self.versions().select("id", payload().alias("payload_hash"))
        problems = provenance.cross_check(provenance.expected_state(chain), hot, self.cold().select("id").join(content, "id"))
        return {**out, "problems": {r.problem: r["count"] for r in problems.groupBy("problem").count().collect()}}

    def status(self) -> dict[str, Any]:
        """Counts of both tiers, of the log of moves and of the chain."""
        cold = self.cold().agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        return {**self.health(), "archived": cold["n"], "archive_bytes": cold["bytes"], "moves": {r.event: r["count"] for r in self.moves().groupBy("event").count().collect()}, "chain": self.sealed().count()}

    def archive_list(self) -> DataFrame:
        """Archived versions, latest first."""
        return self.cold().select("id", "source", "topic", F.left("text", F.lit(80)).alias("label"), "archived_at", "bytes").orderBy(F.desc("archived_at"), "id")

    def migrate(self, notes: DataFrame, at: str | None = None) -> dict[str, int]:
        """Stores notes (source, text, kind) that aren't stored yet; how many were new, and how many were there."""
        known = self.events().select("id")
        own = store.events(notes.select("source", "text", F.lit(0).alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.col("kind").alias("topic"))).dropDuplicates(["id"])
        new = shared.settled(own.join(known, "id", "left_anti").select("source", "text", "topic"), "migrated")
        total, n = own.count(), new.count()
        if n:
            self.remember_all(new, at)
        return {"new": n, "known": total - n}

    def reindex(self) -> None:
        """Writes the search index of all hot versions anew."""
        tables.replace(lexical.index_rows(self.versions().select("id", "text"), 0, self.config.lexical.stemmed), f"{self.folder}/index")

    def index(self) -> DataFrame:
        """The kept search index as it holds."""
        return lexical.current(self.spark.read.parquet(f"{self.folder}/index"))

    def keep_index(self) -> None:
        """Brings the kept index up to date: new and restored versions come in, archived and purged ones go."""
        have, hot = self.index().select("id"), self.versions().select("id", "text")
        rows = lexical.upkeep(self.spark.read.parquet(f"{self.folder}/index"), hot.join(have, "id", "left_anti"), have.join(hot, "id", "left_anti"), self.config.lexical.stemmed)
        tables.append(shared.settled(rows, "index"), f"{self.folder}/index")

    def maintain(self, stats: DataFrame, key: bytes, at: str | None = None) -> list[tuple[str, str, str]]:
        """Runs the store's housekeeping in order; (name, status, detail) of each step, and a step that fails doesn't stop the rest."""
        a = self.config.archival

        def pressure() -> str:
            over = self.versions().agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] - int(a.main_max_mb * 1e6)
            if over <= 0:
                return "fits"
            first = archival.useless_first(store.live(self.versions()), stats, at or now(), a.decay_min_age_days, a.keep_tag)
            return f"{self.archive(archival.pressure(first, over), at)} archived" if first.limit(1).count() else "refusing: nothing may be archived"

        def chained() -> str:
            self.seal(key)
            v = self.verify(key)
            if v["bad"] or v["problems"]:
                raise ValueError(f"chain: {v}")
            return f"{v['n']} entries hold"

        return maintenance.run([
            ("archive-steady", lambda: f"{self.archive_steady(stats, at)} archived"), ("archive-pressure", pressure), ("purge", lambda: f"{self.purge(int(a.archive_max_mb * 1e6), at)} purged"),
            ("index", lambda: (self.keep_index(), "kept")[1]), ("manifest", lambda: f"{len(self.manifest())} characters"), ("provenance", chained), ("health", lambda: str(self.health()))])


def payload() -> Column:
    """A version's content hash, as the chain has it."""
    return X.payload_hash(F.col("text"), F.coalesce("metadata", F.lit("")))


def as_of_hits(v: DataFrame, old: DataFrame, prompts: DataFrame, k: int, theta: float, where: Column, stemmed: bool) -> DataFrame:
    """(qid, id, score, rank) of hot versions and archived ones together; of equal scores hot ones come first."""
    hits = lexical.search(v, prompts, k, theta, where, stemmed)
    more = lexical.search_cold(old, prompts).where(F.col("score") >= theta).withColumn("rank", F.lit(10**6))
    both = hits.unionByName(more).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "rank", "id")))
    return both.where(F.col("rank") <= k)


def register(spark: SparkSession) -> list[str]:
    """Makes the text functions callable from SQL; returns their names."""
    from factlake.functions.stem import index_words

    spark.udf.register("index_words", index_words, "array<string>")
    return ["index_words"]
