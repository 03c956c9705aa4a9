"""Bronze JSON documents → typed silver rows.

Documents are rows ``(key columns..., payload)``, the payload as text or, if
it has been parsed already (:func:`parsed`), as VARIANT; a job parses a document
once and fans the variant out to its tables. Every leaf is read as STRING
(numbers arrive as numbers or as strings), then safe-cast. A missing or null
array, one with an element that is no object, and a document that is no JSON or
repeats a key yield no rows.

Bronze files hold one fetch per line; readers keep the file and its time with
each line, and prune by the partition folders ``endpoint`` and ``fetch_date``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, VariantType

from leagueflow.functions.casts import safe_bool, safe_float, safe_int, safe_ts_utc


# Field names of the source API's documents.
TEAM_FIELDS = ("id", "name", "short_name", "strength")
POSITION_FIELDS = ("id", "singular_name_short", "singular_name", "squad_select")
EVENT_FIELDS = ("id", "name", "deadline_time", "finished", "is_current", "is_next")
ELEMENT_FIELDS = (
    "id", "web_name", "first_name", "second_name", "team", "element_type", "now_cost", "status", "minutes",
    "total_points", "selected_by_percent", "form", "points_per_game", "expected_goals", "expected_assists",
    "expected_goal_involvements", "expected_goals_conceded",
)
FIXTURE_FIELDS = ("id", "event", "team_h", "team_a", "kickoff_time", "finished", "team_h_difficulty", "team_a_difficulty")
HISTORY_FIELDS = (
    "fixture", "round", "minutes", "total_points", "goals_scored", "assists", "clean_sheets", "goals_conceded",
    "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
)
FUTURE_FIELDS = ("id", "event", "is_home", "opponent_team", "kickoff_time", "difficulty")
PICK_FIELDS = ("element", "position", "is_captain", "is_vice_captain", "multiplier")
ENTRY_FIELDS = ("bank", "value", "event_transfers", "event_transfers_cost")
CURRENT_FIELDS = ("event", "points", "total_points", "rank", "event_transfers", "event_transfers_cost", "value", "points_on_bench")
PAST_FIELDS = ("season_name", "total_points", "rank")

def parsed(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents whose payload is a VARIANT: one parse, whatever is read from it afterwards."""
    return docs.withColumn(payload, _document(docs, payload))


def _document(docs: DataFrame, payload: str) -> Column:
    return F.col(payload) if isinstance(docs.schema[payload].dataType, VariantType) else F.try_parse_json(F.col(payload))


def _leaf(docs: DataFrame, payload: str, path: str) -> Column:
    return F.try_variant_get(_document(docs, payload), path, "string")


def _array(docs: DataFrame, payload: str, field: str | None, names: Iterable[str]) -> Column:
    """The array of objects in a field, or the document itself if it is one; of each object the leaves ``names`` as text."""
    elements = f"array<struct<{','.join(f'`{n}`:string' for n in names)}>>"
    return F.try_variant_get(_document(docs, payload), "$" if field is None else f"$.{field}", elements)


def _whole(array: str) -> Column:
    """The array, unless one of its elements is no object: it has become NULL."""
    return F.when(F.forall(array, lambda x: x.isNotNull()), F.col(array))


def _items(docs: DataFrame, payload: str, field: str | None, keep: list[str], names: Iterable[str]) -> DataFrame:
    # read before it is looked through: a generator would evaluate it once for each use
    arrays = docs.select(*keep, _array(docs, payload, field, names).alias("_a"))
    return arrays.select(*keep, F.posexplode(_whole("_a")).alias("_i", "_e"))


def _kept(keep: list[str] | None, pos: str | None) -> list[Column]:
    """Document columns, and the item's place in its array under the name ``pos`` (the order of rows of one batch)."""
    return [F.col(c) for c in keep or []] + ([F.col("_i").cast("int").alias(pos)] if pos else [])


def _e(name: str) -> Column:
    return F.col("_e")[name]


def parse_teams(docs: DataFrame, payload: str = "payload", keep: list[str] | None = None, pos: str | None = None) -> DataFrame:
    k = keep or []
    return _items(docs, payload, "teams", k, TEAM_FIELDS).select(
        *_kept(k, pos), safe_int(_e("id")).alias("id"), _e("name").alias("name"), _e("short_name").alias("short_name"),
        safe_int(_e("strength"), "int").alias("strength"),
    )


def parse_positions(docs: DataFrame, payload: str = "payload", keep: list[str] | None = None, pos: str | None = None) -> DataFrame:
    k = keep or []
    return _items(docs, payload, "element_types", k, POSITION_FIELDS).select(
        *_kept(k, pos), safe_int(_e("id")).alias("id"), _e("singular_name_short").alias("singular_name_short"),
        _e("singular_name").alias("singular_name"), safe_int(_e("squad_select"), "int").alias("squad_select"),
    )


def parse_events(docs: DataFrame, payload: str = "payload", keep: list[str] | None = None, pos: str | None = None) -> DataFrame:
    k = keep or []
    return _items(docs, payload, "events", k, EVENT_FIELDS).select(
        *_kept(k, pos), safe_int(_e("id")).alias("id"), _e("name").alias("name"), safe_ts_utc(_e("deadline_time")).alias("deadline_time"),
        safe_bool(_e("finished")).alias("finished"), safe_bool(_e("is_current")).alias("is_current"),
        safe_bool(_e("is_next")).alias("is_next"),
    )


def parse_players(docs: DataFrame, payload: str = "payload", keep: list[str] | None = None, pos: str | None = None) -> DataFrame:
    """``elements`` → players; ``team``→team_id, ``element_type``→element_type_id."""
    k = keep or []
    ints = {"minutes": "int", "total_points": "int", "now_cost": "int"}
    floats = ("selected_by_percent", "form", "points_per_game", "expected_goals", "expected_assists",
              "expected_goal_involvements", "expected_goals_conceded")
    return _items(docs, payload, "elements", k, ELEMENT_FIELDS).select(
        *_kept(k, pos),
        safe_int(_e("id")).alias("id"),
        _e("web_name").alias("web_name"),
        _e("first_name").alias("first_name"),
        _e("second_name").alias("second_name"),
        safe_int(_e("team")).alias("team_id"),
        safe_int(_e("element_type")).alias("element_type_id"),
        safe_int(_e("now_cost"), ints["now_cost"]).alias("now_cost"),
        _e("status").alias("status"),
        safe_int(_e("minutes"), ints["minutes"]).alias("minutes"),
        safe_int(_e("total_points"), ints["total_points"]).alias("total_points"),
        *[safe_float(_e(f)).alias(f) for f in floats],
    )


def parse_fixtures(docs: DataFrame, payload: str = "payload", keep: list[str] | None = None, pos: str | None = None) -> DataFrame:
    """Top-level array of fixtures; ``event``→event_id."""
    k = keep or []
    return _items(docs, payload, None, k, FIXTURE_FIELDS).select(
        *_kept(k, pos),
        safe_int(_e("id")).alias("id"),
        safe_int(_e("event")).alias("event_id"),
        safe_int(_e("team_h")).alias("team_h"),
        safe_int(_e("team_a")).alias("team_a"),
        safe_ts_utc(_e("kickoff_time")).alias("kickoff_time"),
        safe_bool(_e("finished")).alias("finished"),
        safe_int(_e("team_h_difficulty"), "int").alias("team_h_difficulty"),
        safe_int(_e("team_a_difficulty"), "int").alias("team_a_difficulty"),
    )


def effective_fixture_id(fixture_id: Column, event_id: Column, index: Column) -> Column:
    """Real fixture id, else the synthetic ``-(coalesce(event, 0) * 1000 + index)``."""
    return F.coalesce(fixture_id, -(F.coalesce(event_id, F.lit(0)) * F.lit(1000) + index.cast("bigint")))


def parse_history(
    docs: DataFrame, player: str = "player_id", payload: str = "payload", keep: list[str] | None = None, pos: str | None = None
) -> DataFrame:
    """``history`` of a per-player document → match history rows.

    The player id comes from the document key, not the payload; the array
    position (0-based) feeds the synthetic key of games without a fixture id.
    """
    k = [player] + (keep or [])
    rows = _items(docs, payload, "history", k, HISTORY_FIELDS)
    fid = safe_int(_e("fixture"))
    eid = safe_int(_e("round"))
    ints = ("minutes", "total_points", "goals_scored", "assists", "clean_sheets", "goals_conceded")
    floats = ("expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded")
    return rows.select(
        *_kept(k, pos),
        effective_fixture_id(fid, eid, F.col("_i")).alias("fixture_id_effective"),
        fid.alias("fixture_id"),
        eid.alias("event_id"),
        *[safe_int(_e(f), "int").alias(f) for f in ints],
        *[safe_float(_e(f)).alias(f) for f in floats],
    )


def parse_future(
    docs: DataFrame, player: str = "player_id", payload: str = "payload", keep: list[str] | None = None, pos: str | None = None
) -> DataFrame:
    """``fixtures`` of a per-player document → upcoming fixtures of that player."""
    k = [player] + (keep or [])
    return _items(docs, payload, "fixtures", k, FUTURE_FIELDS).select(
        *_kept(k, pos),
        safe_int(_e("id")).alias("fixture_id"),
        safe_int(_e("event")).alias("event_id"),
        safe_bool(_e("is_home")).alias("is_home"),
        safe_int(_e("opponent_team")).alias("opponent_team"),
        safe_ts_utc(_e("kickoff_time")).alias("kickoff_time"),
        safe_int(_e("difficulty"), "int").alias("difficulty"),
    )


def parse_picks(docs: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """Squad picks in document order; vice-captain also flags ``multiplier = 0``."""
    rows = _items(docs, payload, "picks", keep, PICK_FIELDS)
    vice = F.coalesce(safe_bool(_e("is_vice_captain")), F.lit(False)) | F.coalesce(
        safe_int(_e("multiplier")) == 0, F.lit(False)
    )
    return rows.select(
        *keep,
        F.col("_i").cast("int").alias("pick_index"),
        safe_int(_e("element")).alias("element"),
        safe_int(_e("position"), "int").alias("position"),
        safe_bool(_e("is_captain")).alias("is_captain"),
        vice.alias("is_vice_captain"),
    )


def parse_entry(docs: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """``entry_history`` of a picks document: bank, value, transfers (raw ints)."""
    return docs.select(*keep, *[safe_int(_leaf(docs, payload, f"$.entry_history.{f}")).alias(f) for f in ENTRY_FIELDS])


def squad_from_picks(docs: DataFrame, keep: list[str], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(members, bank): ordered member ids (NULL elements dropped) and bank in
    millions = integer bank / 10, 0.0 when absent or not an integer."""
    picks = parse_picks(docs, keep, payload).where(F.col("element").isNotNull())
    w_keep = keep
    members = picks.select(*w_keep, "pick_index", F.col("element").alias("player_id"))
    raw = F.trim(_leaf(docs, payload, "$.entry_history.bank"))
    bank_int = F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("bigint"))
    bank = docs.select(*keep, F.coalesce(bank_int.cast("double") / F.lit(10.0), F.lit(0.0)).alias("bank_million"))
    return members, bank


def parse_entry_history(docs: DataFrame, keep: list[str], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(current gameweeks, past seasons) of an entry history document."""
    cur = _items(docs, payload, "current", keep, CURRENT_FIELDS).select(
        *keep, F.col("_i").cast("int").alias("idx"), *[safe_int(_e(f)).alias(f) for f in CURRENT_FIELDS]
    )
    past = _items(docs, payload, "past", keep, PAST_FIELDS).select(
        *keep, F.col("_i").cast("int").alias("idx"), _e("season_name").alias("season_name"),
        safe_int(_e("total_points")).alias("total_points"), safe_int(_e("rank")).alias("rank"),
    )
    return cur, past


def entry_summary(docs: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """Per document: latest gameweek (last array element) and number of past seasons."""
    arrays = docs.select(*keep, _array(docs, payload, "current", CURRENT_FIELDS).alias("_current"), _array(docs, payload, "past", PAST_FIELDS).alias("_past"))
    doc = arrays.select(*keep, _whole("_current").alias("_current"), _whole("_past").alias("_past"))
    last = F.try_element_at(F.col("_current"), F.lit(-1))
    return doc.select(
        *keep,
        F.coalesce(F.size("_current"), F.lit(0)).cast("int").alias("n_current"),
        safe_int(last["event"]).alias("latest_event"),
        safe_int(last["points"]).alias("latest_points"),
        safe_int(last["total_points"]).alias("latest_total_points"),
        safe_int(last["value"]).alias("latest_value"),
        safe_int(last["event_transfers"]).alias("latest_event_transfers"),
        F.greatest(F.coalesce(F.size("_past"), F.lit(0)), F.lit(0)).cast("int").alias("n_past"),
    )


def parse_id_list(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """``"1, 2,,3"`` → rows (position, id); blank entries dropped, order kept."""
    parts = F.filter(F.split(F.col(col), ","), lambda x: F.trim(x) != "")
    ids = F.transform(parts, lambda x: F.trim(x).try_cast("bigint"))
    return df.select(*keep, F.posexplode(ids).alias("pos", "player_id")).select(
        *keep, F.col("pos").cast("int").alias("pos"), "player_id"
    )


#: A line of a bronze file: one fetch.
ENVELOPE = StructType([StructField(n, StringType()) for n in ("request_key", "fetched_at_utc", "url", "payload")])


def write_bronze(fetches: DataFrame, root: str) -> None:
    """Append raw fetches as JSON Lines partitioned by endpoint and fetch date.

    ``fetches``: (endpoint, request_key, fetched_at_utc, payload) and, where
    known, url. Many fetches share a file (no small-file explosion); partition
    folders keep per-endpoint and per-day reads pruned. The per-fetch file path
    of the source system is available as
    :func:`leagueflow.functions.keys.bronze_path`.
    """
    url = F.col("url") if "url" in fetches.columns else F.lit(None).cast("string").alias("url")
    line = F.struct("request_key", F.date_format("fetched_at_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at_utc"), url, "payload")
    (
        fetches.withColumn("fetch_date", F.date_format("fetched_at_utc", "yyyy-MM-dd"))
        .select("endpoint", "fetch_date", F.to_json(line).alias("value"))
        .write.mode("append")
        .partitionBy("endpoint", "fetch_date")
        .text(root)
    )


#: Partition folders of a bronze root, stated so that no reader has to look for them.
BRONZE_SCHEMA = "value string, endpoint string, fetch_date string"


def _with_file(lines: DataFrame) -> DataFrame:
    """Lines with the file they are in and its modification time, as UTC."""
    return lines.select("*", F.col("_metadata.file_path").alias("payload_path"), F.to_timestamp_ntz(F.to_utc_timestamp(F.col("_metadata.file_modification_time"), F.current_timezone())).alias("file_time_utc"))


def _pruned(lines: DataFrame, endpoint: str | None, first_day: str | None, last_day: str | None) -> DataFrame:
    if endpoint is not None:
        lines = lines.where(F.col("endpoint") == endpoint)
    if first_day is not None:
        lines = lines.where(F.col("fetch_date") >= first_day)
    return lines if last_day is None else lines.where(F.col("fetch_date") <= last_day)


def read_bronze(spark: SparkSession, root: str, endpoint: str | None = None, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Lines of bronze files: ``value, endpoint, fetch_date, payload_path, file_time_utc``.

    Only the folders of the endpoint and of the days (both ends included) are listed.
    """
    return _with_file(_pruned(spark.read.schema(BRONZE_SCHEMA).format("text").load(root), endpoint, first_day, last_day))


def stream_bronze(spark: SparkSession, root: str, files_per_batch: int = 20, endpoint: str | None = None) -> DataFrame:
    """The same lines as a stream of new files; a root without partition folders is read whole."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
    if endpoint is None:
        return _with_file(lines.load(root))
    return _with_file(_pruned(lines.schema(BRONZE_SCHEMA).load(root), endpoint, None, None))
