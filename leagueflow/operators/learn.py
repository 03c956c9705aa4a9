"""Learned expected points: features, gradient-boosted trees, scoring.

Training rows are (player, past game) joined to its fixture, the player's
current snapshot and both teams' strengths; scoring rows are the same
(player × next period) grid as the explainable formula. The model is a Spark
ML ``Pipeline`` (``VectorAssembler`` → ``GBTRegressor``), so training and
inference run distributed; inference is one ``transform`` over the grid.

The fit sees each distinct feature vector once, with the mean of its labels
and their number as weight. Squared loss splits by sums of labels and weights
alone, in every boosting round, so the trees are those of the single rows; the
error is measured on the single rows. Games outnumber the vectors more the
longer they are collected: features are a player's snapshot, two strengths,
side and difficulty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leagueflow.functions.casts import round2
from leagueflow.functions.scoring import NEUTRAL_DIFFICULTY, att_def_share, expected_minutes, status_key
from leagueflow.operators.marts import not_finished
from leagueflow.operators.scoring import attach_periods, next_periods, side_lookup
from leagueflow.session import cut_lineage, maybe_broadcast

# Feature names and order (training and inference must agree).
FEATURES = [
    "element_type_id", "team_strength", "opponent_strength", "is_home", "difficulty",
    "form", "points_per_game", "minutes_per_game", "status_available",
]
LABEL = "total_points"
# Season length used for minutes per game, model size, minimum rows.
SEASON_GAMES = 38.0
N_TREES, MAX_DEPTH, LEARNING_RATE, MIN_ROWS = 100, 5, 0.1, 10
DEFAULT_POSITION, DEFAULT_STRENGTH = 3, 3


def _minutes_per_game(minutes):
    return F.least(F.coalesce(minutes, F.lit(0)).cast("double") / F.lit(SEASON_GAMES), F.lit(90.0))


def _available(status):
    return (status_key(status) == "a").cast("int")


def training_features(history: DataFrame, fixtures: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """One row per (player, past game) with the 9 features and the points label.

    Features use the player's current snapshot (not point-in-time). Difficulty
    is the player's side of the fixture, NULL → 3, clipped to 1..5.
    """
    h = history.where(F.col("total_points").isNotNull()).select("player_id", "event_id", "fixture_id_effective", "total_points")
    f = fixtures.where(F.col("team_h").isNotNull() & F.col("team_a").isNotNull()).select(
        F.col("id").alias("_fid"), "team_h", "team_a", "team_h_difficulty", "team_a_difficulty"
    )
    p = players.where(F.col("team_id").isNotNull()).select(
        F.col("id").alias("_pid"), "team_id", "element_type_id", "form", "points_per_game", "minutes", "status"
    )
    strength = maybe_broadcast(teams.select(F.col("id").alias("_tid"), F.col("strength").alias("_s")))
    j = h.join(f, h["fixture_id_effective"] == f["_fid"]).join(p, h["player_id"] == p["_pid"])
    own, th, ta = strength.alias("own"), strength.alias("th"), strength.alias("ta")
    j = (
        j.join(own, F.col("team_id") == F.col("own._tid"), "inner")
        .join(th, F.col("team_h") == F.col("th._tid"), "left")
        .join(ta, F.col("team_a") == F.col("ta._tid"), "left")
    )
    home = F.col("team_id") == F.col("team_h")
    diff = F.when(home, F.col("team_h_difficulty")).otherwise(F.col("team_a_difficulty"))
    opp = F.when(home, F.col("ta._s")).otherwise(F.col("th._s"))
    return j.select(
        "player_id",
        "event_id",
        F.col("fixture_id_effective").alias("game_id"),
        F.coalesce(F.col("element_type_id"), F.lit(DEFAULT_POSITION)).cast("int").alias("element_type_id"),
        F.coalesce(F.col("own._s"), F.lit(DEFAULT_STRENGTH)).cast("int").alias("team_strength"),
        F.coalesce(opp, F.lit(DEFAULT_STRENGTH)).cast("int").alias("opponent_strength"),
        home.cast("int").alias("is_home"),
        F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(diff, F.lit(NEUTRAL_DIFFICULTY)))).cast("int").alias("difficulty"),
        F.coalesce(F.col("form"), F.lit(0.0)).alias("form"),
        F.coalesce(F.col("points_per_game"), F.lit(0.0)).alias("points_per_game"),
        _minutes_per_game(F.col("minutes")).alias("minutes_per_game"),
        _available(F.col("status")).alias("status_available"),
        F.col("total_points").cast("int").alias(LABEL),
    )


def scoring_features(
    players: DataFrame, form: DataFrame, fixtures: DataFrame, events: DataFrame, teams: DataFrame, horizon: int = 3, n: int = 5
) -> DataFrame:
    """(player × next ``horizon`` periods) with the 9 features, raw position and expected minutes.

    A team without a fixture in a period gets difficulty 3, away, opponent
    strength 3. Difficulty is not clipped here; position 0/NULL → 3 and
    points per game 0/NULL → 0.
    """
    g, m = f"games_last{n}", f"minutes_last{n}"
    upcoming = fixtures.where(not_finished())
    p = players.select(
        F.col("id").alias("player_id"), "team_id", "element_type_id", "minutes", "points_per_game", "status", "form"
    )
    fm = form.select(F.col("player_id").alias("_fp"), g, m)
    per = p.join(fm, p["player_id"] == fm["_fp"], "left").drop("_fp")
    per = attach_periods(per, upcoming, events, horizon)
    per = per.withColumn("xmins", expected_minutes(g, m, "minutes", "finished_events", "status"))
    grid = per.withColumn("event_id", F.explode("_periods")).drop("_periods")
    lookup = side_lookup(upcoming).join(F.broadcast(next_periods(upcoming, horizon)), "event_id", "left_semi")
    strength = maybe_broadcast(teams.select(F.col("id").alias("_tid"), F.col("strength").alias("_s")))
    j = grid.join(maybe_broadcast(lookup), ["team_id", "event_id"], "left")
    own, opp = strength.alias("own"), strength.alias("opp")
    j = j.join(own, F.col("team_id") == F.col("own._tid"), "left").join(
        opp, F.col("opponent_team") == F.col("opp._tid"), "left"
    )
    found = F.col("difficulty").isNotNull()
    et = F.col("element_type_id")
    return j.select(
        "player_id",
        "event_id",
        F.col("element_type_id").alias("position"),
        "xmins",
        F.when(et.isNull() | (et == 0), F.lit(DEFAULT_POSITION)).otherwise(et).cast("int").alias("element_type_id"),
        F.coalesce(F.col("own._s"), F.lit(DEFAULT_STRENGTH)).cast("int").alias("team_strength"),
        F.when(found, F.coalesce(F.col("opp._s"), F.lit(DEFAULT_STRENGTH))).otherwise(F.lit(DEFAULT_STRENGTH)).cast("int").alias("opponent_strength"),
        F.when(found, F.col("is_home").cast("int")).otherwise(F.lit(0)).alias("is_home"),
        F.coalesce(F.col("difficulty"), F.lit(NEUTRAL_DIFFICULTY)).cast("int").alias("difficulty"),
        F.coalesce(F.col("form"), F.lit(0.0)).alias("form"),
        F.coalesce(F.col("points_per_game"), F.lit(0.0)).alias("points_per_game"),
        _minutes_per_game(F.col("minutes")).alias("minutes_per_game"),
        _available(F.col("status")).alias("status_available"),
    )


def in_validation(fraction: float, player: str = "player_id", game: str = "game_id"):
    """Whether a row is held out: by a hash of player and game, so the split does not depend on the layout."""
    text = F.concat_ws(":", F.col(player).cast("string"), F.col(game).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") < int(fraction * 2**32)


#: Rows in a partition of the fit as long as there are more cores than partitions, and the most in one. Every boosting
#: round runs jobs over all partitions, so few cost little, and one more than the cores would double each job's time.
ROWS_PER_PARTITION, MOST_PER_PARTITION = 100_000, 5_000_000


@dataclass(frozen=True)
class Fit:
    """A fitted pipeline, its error on the held-out rows, and what went in."""

    model: PipelineModel
    mae: float
    n_train: int
    n_val: int
    n_vectors: int


def weighted_vectors(rows: DataFrame) -> DataFrame:
    """Distinct feature vectors with the mean label and the number of rows (``_weight``); summed before the shuffle."""
    return rows.groupBy(*FEATURES).agg(F.avg(F.col(LABEL).cast("double")).alias(LABEL), F.count(F.lit(1)).cast("double").alias("_weight"))


def fit_partitions(n: int, cores: int) -> int:
    """Partitions for ``n`` rows: fewer than the cores for few rows, else a whole number of waves."""
    few = -(-n // ROWS_PER_PARTITION)
    return max(1, few) if few < cores else cores * -(-n // (cores * MOST_PER_PARTITION))


def train(features: DataFrame, validation_fraction: float = 0.2, seed: int = 0, max_iter: int = N_TREES) -> Fit:
    """Fit the pipeline on the rows that are not held out.

    The features are checkpointed once: the joins behind them run once, not
    for the counts, the fit and the evaluation each. Raises ``ValueError`` with
    fewer than 10 rows.
    """
    rows = cut_lineage(features.select(*FEATURES, LABEL, in_validation(validation_fraction).alias("_val")))
    sizes = {r["_val"]: r["count"] for r in rows.groupBy("_val").count().collect()}
    n_train, n_val = sizes.get(False, 0), sizes.get(True, 0)
    if n_train + n_val < MIN_ROWS:
        raise ValueError(f"not enough training rows ({n_train + n_val}); need at least {MIN_ROWS}: ingest history first")
    parts = fit_partitions(n_train, rows.sparkSession.sparkContext.defaultParallelism)
    vectors = cut_lineage(weighted_vectors(rows.where(~F.col("_val"))).repartition(parts))
    n_vectors = vectors.count()
    pipe = Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="_x"),
            GBTRegressor(featuresCol="_x", labelCol=LABEL, weightCol="_weight", maxIter=max_iter, maxDepth=MAX_DEPTH,
                         stepSize=LEARNING_RATE, seed=seed),
        ]
    )
    model = pipe.fit(vectors)
    scored = model.transform(rows.where("_val").select(*FEATURES, F.col(LABEL).cast("double").alias(LABEL)))
    mae = RegressionEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="mae").evaluate(scored)
    return Fit(model, mae, n_train, n_val, n_vectors)


def save_model(model: PipelineModel, path: str) -> str:
    """Save (overwrite) to ``path`` (a folder on the shared file system)."""
    model.write().overwrite().save(path)
    return path


def load_model(spark, path: str) -> PipelineModel:
    """Load from ``path`` (or ``path.json``); a clear error names the training step."""
    jvm = spark._jvm
    for cand in (path, path + ".json"):
        p = jvm.org.apache.hadoop.fs.Path(cand)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return PipelineModel.load(cand)
    raise FileNotFoundError(f"model not found at {path}; train it first (learn.train + learn.save_model)")


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Expected points from the model: xpts = max(0, round(pred, 2)), att/def
    split by position, appearance part 0."""
    pred = model.transform(features)
    xpts = F.greatest(F.lit(0.0), round2(F.col("prediction")))
    att, dfn = att_def_share(F.col("position"))
    return pred.select(
        "player_id",
        "event_id",
        round2("xmins").alias("xmins"),
        xpts.alias("xpts"),
        round2(xpts * att).alias("xpts_att"),
        round2(xpts * dfn).alias("xpts_def"),
        F.lit(0.0).alias("xpts_app"),
    )
