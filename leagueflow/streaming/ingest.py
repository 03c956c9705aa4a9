"""Incremental per-player ingest as a Structured Streaming job.

Bronze input is JSON Lines: one fetch per line,
``{"request_key": "element-summary:{id}", "fetched_at_utc": "...", "payload": {...}}``
(many fetches per file avoids the small-files problem of one file per fetch).
Each micro-batch (``maxFilesPerTrigger`` files, 20 by default) is parsed and
upserted into the history and future-fixture tables, and its fetches are
logged. A replayed batch stores the same rows again under the same keys and
replaces its own log and quarantine parts, so it changes nothing. A line that
is no envelope, or whose payload is no JSON object, goes to a quarantine folder
instead of failing the batch. Rows without a parent in the store are set aside.
The file of every fetch goes into the log; a batch ends with compacting the
buckets that have too many deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.functions.casts import safe_ts_utc
from leagueflow.functions.keys import key_id, payload_digest, variant_digest
from leagueflow.sources import payloads
from leagueflow.sources.tables import MOST_DELTAS, TableStore

def envelope(lines: DataFrame) -> DataFrame:
    """Text lines → (request_key, player_id, fetched_at_utc, url, payload_path, payload, _document, ok).

    ``ok``: the key names a player and the payload is a well-formed JSON object.
    ``payload_path`` is the file of the line, where the reader kept it.
    """
    path = F.col("payload_path") if "payload_path" in lines.columns else F.lit(None).cast("string")
    e = lines.select(F.from_json(F.col("value"), payloads.ENVELOPE).alias("e"), F.col("value").alias("_raw"), path.alias("payload_path"))
    out = e.select(
        F.col("e.request_key").alias("request_key"),
        key_id(F.col("e.request_key")).alias("player_id"),
        safe_ts_utc(F.col("e.fetched_at_utc")).alias("fetched_at_utc"),
        F.col("e.url").alias("url"),
        "payload_path",
        F.col("e.payload").alias("payload"),
        "_raw",
    ).withColumn("_document", F.try_parse_json("payload"))
    is_object = F.col("_document").isNotNull() & F.ltrim("payload").startswith("{")
    return out.withColumn("ok", F.coalesce(F.col("player_id").isNotNull() & is_object, F.lit(False)))


def fetch_log(docs: DataFrame, endpoint: str, run_id: str | None = None) -> DataFrame:
    """Ingestion log rows of fetched documents (``request_key``, ``fetched_at_utc``, ``payload`` or its digest).

    ``url`` and ``payload_path`` are those of the fetch, where the documents have them.
    """
    kept = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    return docs.select(
        F.lit(run_id).cast("string").alias("run_id"),
        "request_key",
        F.lit(endpoint).alias("endpoint"),
        kept("url"),
        "fetched_at_utc",
        F.lit(200).alias("http_status"),
        kept("payload_path"),
        F.col("payload_sha256") if "payload_sha256" in docs.columns else payload_digest("payload").alias("payload_sha256"),
    )


#: Order of rows with one key: fetch time, then the document (by its digest), then the place in the document.
ORDER = ["fetched_at_utc", "_doc_digest", "_pos"]


def ordered(docs: DataFrame) -> DataFrame:
    """Documents parsed once, with the digests of their text.

    ``_doc_digest`` orders documents whose fetch times are equal, whatever
    their layout; ``payload_sha256`` is for the log; ``payload`` is a VARIANT
    from here on, so nothing reads the text again.
    """
    if "_document" not in docs.columns:
        docs = docs.withColumn("_document", F.try_parse_json("payload"))
    digests = docs.withColumns({"_doc_digest": F.sha2("payload", 256), "payload_sha256": variant_digest("_document")})
    return digests.withColumn("payload", F.col("_document")).drop("_document")


def process_batch(
    store: TableStore, batch: DataFrame, batch_id: int, run_id: str | None = None, orphans: str = "quarantine", most_deltas: int = MOST_DELTAS
) -> None:
    """Parse one micro-batch, upsert history and future fixtures, log the fetches, compact what has grown too many deltas."""
    # parsed and digested once; the line itself is kept only where it is set aside
    docs = ordered(envelope(batch)).withColumn("_raw", F.when(~F.col("ok"), F.col("_raw"))).persist()
    try:
        bad = docs.where(~F.col("ok"))
        if not bad.isEmpty():
            bad.select("_raw").write.mode("overwrite").text(f"{store.root}/_quarantine/batch={batch_id}")
        good = docs.where(F.col("ok"))
        keep = ORDER[:2]
        parse = {"player_match_history": payloads.parse_history, "player_future_fixtures": payloads.parse_future}
        for table, rows in parse.items():
            store.upsert(table, rows(good, keep=keep, pos="_pos"), ORDER, orphans=orphans)
        store.log_fetches(fetch_log(good, "element-summary", run_id), part=f"stream-{run_id or 0}-{batch_id}")
        for table in [*parse, "last_fetches"]:
            store.compact(table, most_deltas)
    finally:
        docs.unpersist()


def ingest_stream(
    spark: SparkSession,
    in_dir: str,
    store_root: str,
    checkpoint: str,
    files_per_batch: int = 20,
    run_id: str | None = None,
    orphans: str = "quarantine",
    most_deltas: int = MOST_DELTAS,
    endpoint: str | None = None,
) -> None:
    """Drain everything currently in ``in_dir`` (``availableNow``) into the store.

    ``endpoint`` names the partition to read where ``in_dir`` is a bronze root.
    Rows whose player or fixture the store does not have are set aside; a store
    without those tables has nothing to hold them against.
    """
    store = TableStore(spark, store_root)
    store.init(["player_match_history", "player_future_fixtures", "meta_ingestions", "last_fetches"])
    lines = payloads.stream_bronze(spark, in_dir, files_per_batch, endpoint)
    q = (
        lines.writeStream.foreachBatch(lambda df, bid: process_batch(store, df, bid, run_id, orphans, most_deltas))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


#: Periods in a season, and thus in one document of a player.
SEASON_PERIODS = 12


def season(event: str = "event_id"):
    """Season of a period; games without a period are in the document without a season."""
    return F.floor((F.col(event) - 1) / SEASON_PERIODS)


def summary_docs(history: DataFrame, future: DataFrame) -> DataFrame:
    """One document per (player, season) from silver-shaped rows: ``player_id``, ``payload``.

    Items are in key order. All games of one period are in one document, so a
    place in the array never repeats within a period and synthetic keys are
    unique. A document holds the games of one player in one season.
    """
    h = F.struct(
        F.abs("fixture_id_effective").alias("_ord"), F.col("fixture_id").alias("fixture"), F.col("event_id").alias("round"),
        "minutes", "total_points", "goals_scored", "assists", "clean_sheets", "goals_conceded",
        "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
    )
    f = F.struct(
        F.col("fixture_id").alias("id"), F.col("event_id").alias("event"), "is_home", "opponent_team",
        F.concat(F.date_format("kickoff_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("kickoff_time"), "difficulty",
    )
    past = history.groupBy("player_id", season().alias("season")).agg(F.array_sort(F.collect_list(h)).alias("history"))
    coming = future.groupBy("player_id", season().alias("season")).agg(F.array_sort(F.collect_list(f)).alias("fixtures"))
    both = past.join(coming, past["player_id"].eqNullSafe(coming["player_id"]) & past["season"].eqNullSafe(coming["season"]), "full")
    payload = F.to_json(F.struct("history", "fixtures"))
    return both.select(F.coalesce(past["player_id"], coming["player_id"]).alias("player_id"), payload.alias("payload"))


def summary_lines(history: DataFrame, future: DataFrame, fetched_at: str = "2024-01-31T00:00:00Z") -> DataFrame:
    """Bronze JSON Lines, one fetch per document of :func:`summary_docs`."""
    docs = summary_docs(history, future)
    key = F.concat(F.lit("element-summary:"), F.col("player_id").cast("string")).alias("request_key")
    # the payload is nested as JSON, as a fetch has it
    head = F.to_json(F.struct(key, F.lit(fetched_at).alias("fetched_at_utc")))
    opened = docs.withColumn("head", head).withColumn("head", F.expr("substring(head, 1, length(head) - 1)"))
    return opened.select(F.concat("head", F.lit(',"payload":'), "payload", F.lit("}")).alias("value"))
