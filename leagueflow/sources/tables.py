"""Silver tables on Parquet: schemas, idempotent keyed upsert, FK guard and
the append-only ingestion log.

No MERGE-capable table format is available. A table is a folder of deltas,
``{table}/delta={seq}-{id}/_bucket={k}``, each with at most one row per key,
split by a hash of the key. An upsert writes its own rows as one more delta
and touches nothing else, so it costs its own size. A read takes the latest
row per key; :meth:`TableStore.compact` folds buckets with many deltas into a
base, ``{table}/base={seq}-{id}/_bucket={k}``, that stands for everything
before it in the buckets it has. Folders are never overwritten, their names
are unique, and one counts only once its ``_SUCCESS`` marker exists, so a
failed or repeated write does no harm and two writers cannot collide. What a
base stands for stays on disk for readers that have begun, until
:meth:`TableStore.remove_superseded`.

A keyed table carries a descriptor, ``{table}/_descriptor``, written when it is
created: columns, key and number of buckets. Every later writer goes by it,
whatever number it was opened with; another key or other columns are an error.

Append-only tables are folders of parts, ``{table}/part={name}``; writing a
part of the same name again (a replayed batch) replaces that part alone.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


L, I, D, S, B, T = LongType(), IntegerType(), DoubleType(), StringType(), BooleanType(), TimestampNTZType()

SCHEMAS: dict[str, StructType] = {
    "meta_ingestions": _s(("id", L), ("run_id", S), ("request_key", S), ("endpoint", S), ("url", S),
                          ("fetched_at_utc", T), ("http_status", I), ("etag", S), ("payload_path", S),
                          ("payload_sha256", S)),
    "teams": _s(("id", L), ("name", S), ("short_name", S), ("strength", I), ("ingested_at_utc", T)),
    "element_types": _s(("id", L), ("singular_name_short", S), ("singular_name", S), ("squad_select", I),
                        ("ingested_at_utc", T)),
    "events": _s(("id", L), ("name", S), ("deadline_time", T), ("finished", B), ("is_current", B), ("is_next", B),
                 ("ingested_at_utc", T)),
    "players": _s(("id", L), ("web_name", S), ("first_name", S), ("second_name", S), ("team_id", L),
                  ("element_type_id", L), ("now_cost", I), ("status", S), ("minutes", I), ("total_points", I),
                  ("selected_by_percent", D), ("form", D), ("points_per_game", D), ("expected_goals", D),
                  ("expected_assists", D), ("expected_goal_involvements", D), ("expected_goals_conceded", D),
                  ("ingested_at_utc", T)),
    "fixtures": _s(("id", L), ("event_id", L), ("team_h", L), ("team_a", L), ("kickoff_time", T), ("finished", B),
                   ("team_h_difficulty", I), ("team_a_difficulty", I), ("ingested_at_utc", T)),
    "player_match_history": _s(("player_id", L), ("fixture_id_effective", L), ("fixture_id", L), ("event_id", L),
                               ("minutes", I), ("total_points", I), ("goals_scored", I), ("assists", I),
                               ("clean_sheets", I), ("goals_conceded", I), ("expected_goals", D),
                               ("expected_assists", D), ("expected_goal_involvements", D),
                               ("expected_goals_conceded", D), ("ingested_at_utc", T)),
    "player_future_fixtures": _s(("player_id", L), ("fixture_id", L), ("event_id", L), ("is_home", B),
                                 ("opponent_team", L), ("kickoff_time", T), ("difficulty", I), ("ingested_at_utc", T)),
    "player_expected_points": _s(("player_id", L), ("event_id", L), ("xmins", D), ("xpts", D), ("xpts_att", D),
                                 ("xpts_def", D), ("xpts_app", D), ("computed_at_utc", T)),
    "last_fetches": _s(("request_key", S), ("endpoint", S), ("last_fetched", T)),
}

KEYS: dict[str, list[str]] = {
    "teams": ["id"],
    "element_types": ["id"],
    "events": ["id"],
    "players": ["id"],
    "fixtures": ["id"],
    "player_match_history": ["player_id", "fixture_id_effective"],
    "player_future_fixtures": ["player_id", "fixture_id"],
    "player_expected_points": ["player_id", "event_id"],
    "last_fetches": ["request_key"],
}

#: Columns whose largest value wins for a key, whichever delta it came with; other tables go by the delta alone.
GREATEST = {"last_fetches": ["last_fetched"]}

STAMP = {t: ("computed_at_utc" if t == "player_expected_points" else "ingested_at_utc") for t in KEYS if t != "last_fetches"}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("players", "team_id", "teams", "id"),
    ("players", "element_type_id", "element_types", "id"),
    ("fixtures", "team_h", "teams", "id"),
    ("fixtures", "team_a", "teams", "id"),
    ("player_match_history", "player_id", "players", "id"),
    ("player_future_fixtures", "player_id", "players", "id"),
    ("player_future_fixtures", "fixture_id", "fixtures", "id"),
    ("player_expected_points", "player_id", "players", "id"),
    ("player_expected_points", "event_id", "events", "id"),
]


class IntegrityError(RuntimeError):
    """A write would store child rows whose parent key does not exist."""


# ------------------------------------------------------------------ upsert
def latest_per_key(source: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Keep the last row per key (largest ``order_cols``); later rows of one batch win."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order_cols])
    return source.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    order_cols: list[str],
    stamp: tuple[str, str] | None = None,
) -> DataFrame:
    """Insert, or replace every non-key column on key conflict; rows absent from
    the source are kept. ``order_cols`` decide the winner among source rows of
    one key (the later one, as in one batch); ``stamp`` = (column, timestamp
    literal) stamps written rows.

    Plan: one window over the source (a partial ``WindowGroupLimit`` keeps one
    row per key per map task, so a hot key does not land whole in one task),
    one anti-join of the target on the keys (Spark broadcasts the batch's keys
    only under its size threshold, else sort-merge on the keys), one union.
    """
    src = conform(latest_per_key(source, keys, order_cols), target.schema, stamp)
    kept = target.join(src.select(*keys), keys, "left_anti")
    return kept.unionByName(src)


def conform(rows: DataFrame, schema: StructType, stamp: tuple[str, str] | None = None) -> DataFrame:
    """Rows with exactly the columns of ``schema``: cast, NULL where missing, stamped."""
    if stamp is not None:
        col, ts = stamp
        rows = rows.withColumn(col, F.lit(ts).cast("timestamp_ntz"))
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def fk_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """Child rows whose non-NULL ``fk`` has no parent row (anti-join on the key)."""
    c = child.where(F.col(fk).isNotNull())
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return c.join(p, c[fk] == p["_pk"], "left_anti")


def all_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphans of all foreign keys whose two tables are given: ``fk``, ``child_key`` (key columns, colon-joined), ``value``."""
    out = None
    for child, fk, parent, pk in FOREIGN_KEYS:
        if child in tables and parent in tables:
            key = F.concat_ws(":", *[F.col(k).cast("string") for k in KEYS[child]])
            bad = fk_violations(tables[child], fk, tables[parent], pk)
            bad = bad.select(F.lit(f"{child}.{fk}").alias("fk"), key.alias("child_key"), F.col(fk).cast("bigint").alias("value"))
            out = bad if out is None else out.unionByName(bad)
    return out


# ------------------------------------------------------------------ table store
_FOLDER = re.compile(r"^(delta|base)=(\d{10}-[0-9a-f]{8})$")
_SEQ = StructField("_seq", StringType())
#: Folders that make up a bucket before a job compacts it.
MOST_DELTAS = 16


class DescriptorError(RuntimeError):
    """A table on disk has another key, other columns or no descriptor."""


class TableStore:
    """Keyed and append-only Parquet tables under one root folder (local or shared FS).

    ``buckets`` is the number of buckets of tables that this store creates.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._described: dict[str, int] = {}

    # -------------------------------------------------------------- folders
    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _match(self, pattern: str) -> list[tuple[str, ...]]:
        """Last two names of every path under the root that matches, from one listing."""
        fs, to_path = self._fs()
        found = fs.globStatus(to_path(f"{self.root}/{pattern}")) or []
        return sorted((st.getPath().getParent().getName(), st.getPath().getName()) for st in found)

    def _complete(self, table: str) -> list[str]:
        """Names of the table's finished folders, in order."""
        return [folder for folder, _ in self._match(f"{table}/*/_SUCCESS") if "=" in folder]

    def _held(self, table: str) -> dict[int, list[tuple[str, bool, str]]]:
        """For each bucket all finished folders: number, whether a base, path."""
        done, held = set(self._complete(table)), {}
        for name, sub in self._match(f"{table}/*/_bucket=*"):
            m = _FOLDER.match(name)
            if m and name in done:
                held.setdefault(int(sub[8:]), []).append((m.group(2), m.group(1) == "base", f"{self.root}/{table}/{name}/{sub}"))
        return held

    @staticmethod
    def _current(folders: list[tuple[str, bool, str]]) -> list[tuple[str, bool, str]]:
        base = max((f for f in folders if f[1]), default=None)
        return [f for f in folders if base is None or f == base or (not f[1] and f[0][:10] > base[0][:10])]

    def _bucket_folders(self, table: str) -> dict[int, list[str]]:
        """For each bucket the folders that make its state: the latest base and the deltas after it."""
        return {bucket: [f[2] for f in self._current(folders)] for bucket, folders in self._held(table).items()}

    def _next(self, table: str) -> str:
        last = max((m.group(2)[:10] for _, n in self._match(f"{table}/*") if (m := _FOLDER.match(n))), default="0" * 10)
        return f"{int(last) + 1:010d}-{uuid.uuid4().hex[:8]}"

    def exists(self, table: str) -> bool:
        fs, to_path = self._fs()
        return fs.exists(to_path(f"{self.root}/{table}"))

    def init(self, tables: list[str] | None = None) -> None:
        """Create the folder of every missing table and its descriptor; what exists is left alone."""
        fs, to_path = self._fs()
        for t in tables or list(SCHEMAS):
            fs.mkdirs(to_path(f"{self.root}/{t}"))
            if t in KEYS:
                self._bucket_count(t)

    # ----------------------------------------------------------- descriptor
    def _descriptor(self, table: str, buckets: int) -> dict:
        return {"columns": [f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[table]], "key": KEYS[table], "buckets": buckets}

    def _bucket_count(self, table: str) -> int:
        """The table's number of buckets by its descriptor, which is written if the table is new."""
        if table in self._described:
            return self._described[table]
        fs, to_path = self._fs()
        path = to_path(f"{self.root}/{table}/_descriptor")
        if not fs.exists(path):
            if self._complete(table):
                raise DescriptorError(f"table {table} has data and no descriptor: its number of buckets is unknown")
            self._create_text(path, json.dumps(self._descriptor(table, self.buckets)))
        lines = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(fs.open(path)))
        try:
            found = json.loads(lines.readLine())
        finally:
            lines.close()
        if found != self._descriptor(table, found["buckets"]):
            raise DescriptorError(f"table {table} was created as {found}")
        self._described[table] = found["buckets"]
        return found["buckets"]

    def _create_text(self, path, text: str) -> None:
        """Write a small file unless another writer has been faster."""
        fs, to_path = self._fs()
        own = to_path(f"{path.toString()}-{uuid.uuid4().hex}")
        out = fs.create(own)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(path) or not fs.rename(own, path):
            fs.delete(own, False)

    # -------------------------------------------------------------- reading
    def _state(self, table: str, paths: list[str]) -> DataFrame:
        schema = SCHEMAS[table]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema.fields, _SEQ])).parquet(*paths)
        return latest_per_key(rows, KEYS[table], [*GREATEST.get(table, []), "_seq"]).drop("_seq")

    def read(self, table: str) -> DataFrame:
        if not self.exists(table):
            raise FileNotFoundError(f"table {table} not initialised under {self.root}")
        if table in KEYS:
            return self._state(table, [p for paths in self._bucket_folders(table).values() for p in paths])
        parts = [f"{self.root}/{table}/{n}" for n in self._complete(table)]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMAS[table])

    # -------------------------------------------------------------- writing
    def _write(self, table: str, kind: str, seq: str, rows: DataFrame, marked: bool = True) -> str:
        bucket = F.pmod(F.xxhash64(*KEYS[table]), F.lit(self._bucket_count(table))).cast("int")
        path = f"{self.root}/{table}/{kind}={seq}"
        # a bucket's rows come together, so a folder has as many files as its bytes need, not one per bucket and task
        out = rows.withColumn("_seq", F.lit(seq)).withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket")
        out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(marked).lower()).parquet(path)
        return path

    def upsert(
        self,
        table: str,
        source: DataFrame,
        order_cols: list[str],
        as_of: str | None = None,
        orphans: str = "reject",
        check: Check | None = None,
    ) -> int:
        """Keyed upsert into ``table``; returns the number of input rows.

        Of source rows with one key the one that is last by ``order_cols``
        wins; ties go by the whole row, so the result does not depend on the
        layout. Empty input writes nothing. Rows whose parent does not exist:
        ``reject`` raises :class:`IntegrityError` before anything is written,
        ``quarantine`` writes them to ``_orphans/{table}`` and stores the rest,
        ``ignore`` stores them.

        ``check`` looks at the batch before it counts: its metrics are observed
        in the pass that writes the delta, and the delta gets its marker only
        if ``check`` accepts them; else its folder is removed, the table is as
        it was and the error goes to the caller.
        """
        stamp = (STAMP[table], as_of) if as_of is not None and table in STAMP else None
        columns = SCHEMAS[table].names
        ties = [c for c in source.columns if c in columns and c not in KEYS[table]]
        counted = Observation()
        held: list[DataFrame] = []
        try:
            if orphans == "ignore":
                n = source.count()
                if n:
                    self.init([table])
                rows = conform(latest_per_key(source, KEYS[table], [*order_cols, *ties]), SCHEMAS[table])
            else:
                # read by the FK checks and the write: kept for this write only, a row per key in the partitions of
                # the shuffle, not in those of the input, of which one may hold a whole file; the pass that fills it counts the input
                seen_rows = source.observe(counted, F.count(F.lit(1)).alias("n"))
                rows = conform(latest_per_key(seen_rows, KEYS[table], [*order_cols, *ties]), SCHEMAS[table]).persist()
                held.append(rows)
                n = counted.get["n"] if rows.count() else 0
                if n:
                    self.init([table])
                    rows = self._with_parents(table, rows, orphans, held)
            if n == 0:
                return 0
            rows = conform(rows, SCHEMAS[table], stamp)
            if check is None or not check.metrics(table):
                self._write(table, "delta", self._next(table), rows)
                return n
            seen = Observation()
            path = self._write(table, "delta", self._next(table), rows.observe(seen, *check.metrics(table)), marked=False)
            fs, to_path = self._fs()
            try:
                check.accept(table, seen.get)
            except Exception:
                fs.delete(to_path(path), True)  # never counted: it has no marker
                raise
            fs.create(to_path(f"{path}/_SUCCESS")).close()
            return n
        finally:
            for frame in held:
                frame.unpersist()

    def _ids(self, table: str, pk: str) -> DataFrame:
        """Values of a key column in any folder of the table: which of a key's rows is the latest does not matter here."""
        if KEYS[table] != [pk]:
            return self.read(table).select(pk)
        paths = [p for folders in self._bucket_folders(table).values() for p in folders]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths).select(pk) if paths else self.spark.createDataFrame([], SCHEMAS[table]).select(pk)

    def _with_parents(self, table: str, rows: DataFrame, orphans: str, held: list[DataFrame]) -> DataFrame:
        """The rows that have their parents; what is kept for the write, beside the rows, is added to ``held``."""
        for child, fk, parent, pk in FOREIGN_KEYS:
            if child != table or fk not in rows.columns or not self.exists(parent):
                continue
            # found in one pass over the parents: looked at, written and taken out
            bad = fk_violations(rows, fk, self._ids(parent, pk), pk).persist()
            held.append(bad)
            if not bad.count():
                continue
            if orphans == "reject":
                raise IntegrityError(f"{table}.{fk} has values missing from {parent}.{pk}")
            conform(bad, SCHEMAS[table]).withColumn("_fk", F.lit(f"{fk}->{parent}.{pk}")).write.mode("append").parquet(f"{self.root}/_orphans/{table}")
            rows = rows.join(bad.select(*KEYS[table]), KEYS[table], "left_anti")
        return rows

    def compact(self, table: str, most_deltas: int = MOST_DELTAS) -> list[int]:
        """Fold the buckets that have more than ``most_deltas`` folders into a base; returns those buckets.

        The base has the number of the last folder it covers. Run it while
        nobody else writes to the table; the jobs and the stream do so after
        their own write.
        """
        full = {b: p for b, p in self._bucket_folders(table).items() if len(p) > most_deltas}
        if full:
            last = max(m.group(2)[:10] for n in self._complete(table) if (m := _FOLDER.match(n)))
            rows = self._state(table, [p for paths in full.values() for p in paths])
            self._write(table, "base", f"{last}-{uuid.uuid4().hex[:8]}", rows)
        return sorted(full)

    def remove_superseded(self, table: str) -> int:
        """Remove the bucket folders that a base stands for; returns how many. No reader may be at work on an older state."""
        fs, to_path = self._fs()
        gone = 0
        for folders in self._held(table).values():
            current = self._current(folders)
            for folder in folders:
                if folder not in current:
                    gone += bool(fs.delete(to_path(folder[2]), True))
        return gone

    def append(self, table: str, rows: DataFrame, part: str | None = None) -> None:
        """Add rows to an append-only table; a ``part`` written before is replaced."""
        conform(rows, SCHEMAS[table]).write.mode("overwrite").parquet(f"{self.root}/{table}/part={part or uuid.uuid4().hex}")

    def log_fetches(self, log: DataFrame, part: str | None = None) -> None:
        """Append to the ingestion log and keep the last fetch of every key beside it.

        ``last_fetches`` has one row per key, the largest time wins, so a
        replayed part changes nothing and selection never reads the whole log.
        """
        self.append("meta_ingestions", log, part)
        newest = log.groupBy("request_key").agg(F.max(F.struct("fetched_at_utc", "endpoint")).alias("f"))
        known = newest.where(F.col("request_key").isNotNull() & F.col("f.fetched_at_utc").isNotNull())
        self.upsert("last_fetches", known.select("request_key", F.col("f.endpoint").alias("endpoint"), F.col("f.fetched_at_utc").alias("last_fetched")), ["last_fetched"])


class Check:
    """What :meth:`TableStore.upsert` asks before a batch counts."""

    def __init__(self, metrics: Callable[[str], list[Column]], accept: Callable[[str, dict], None]):
        self.metrics, self.accept = metrics, accept
