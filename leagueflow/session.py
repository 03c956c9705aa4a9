"""Session helpers: a configured SparkSession, the shared checkpoint folder and
size-checked broadcast decisions.

Nothing here is specific to the league model; every job in the package takes a
``SparkSession`` from the caller and only falls back to :func:`get_spark` in
tests and scripts.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes under which a side may be broadcast: by the optimizer's estimate, or by
# its counted rows where a table has been written. A side that grows with the
# data is shuffled instead of being shipped to every executor.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def get_spark(app: str = "leagueflow", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and scripts. On a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; a
        # larger fused stage would run interpreted (10x slower on wide
        # projections such as the swap evaluation), so split it instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEAGUEFLOW_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only in a local session (tests) where it
    is unset a fresh scratch folder is created and registered; a cluster without
    the setting is an error, as a folder of the driver would not be shared.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="leagueflow-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def _estimated_bytes(df: DataFrame) -> int | None:
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        size = int(str(stats.sizeInBytes()))
        return size
    except Exception:  # pragma: no cover - defensive, plan API is internal
        return None


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when the optimizer's size estimate is small enough to broadcast.

    Free: no job runs while a plan is built. A side whose estimate is unknown or
    large gets no hint; adaptive execution still broadcasts it when its real
    size, measured at run time, is under the session's threshold.
    """
    est = _estimated_bytes(df)
    return est is not None and est <= max_bytes


def keyed(df: DataFrame) -> DataFrame:
    """A side that grows with the data: its next join shuffles both sides by the key, whatever the optimizer thinks of their size.

    The estimates come from compressed files and from widths that are set for
    a type, and know nothing of the rows that ``explode`` makes of one: 200,000
    players were taken for 0.2 MB and broadcast as 18 MB, the members of parsed
    documents for less than their requests. Such a table is not collected on
    the driver for that.
    """
    return df.hint("merge")


def maybe_broadcast(df: DataFrame, **kw) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise leave the join to AQE."""
    return F.broadcast(df) if fits_broadcast(df, **kw) else df
