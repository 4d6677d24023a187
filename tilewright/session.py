"""Session helpers shared by every operator: table reading, shared checkpoints, bounded collects."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tilewright", cores: str | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Parquet keeps filter and column pruning at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``; only a local master (tests, a laptop) may leave it unset, then a
    folder of its own is used. Checkpoint files are shared, so the loss of an executor loses nothing.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tilewright-ckpt-"))
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, bound: int, what: str) -> list:
    """Collect a table whose size has a proven bound; a broken proof fails loudly instead of filling the driver."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows")
    return rows


def small_enough(df: DataFrame, bound: int) -> bool:
    """Whether a side has at most ``bound`` rows; reads no more than ``bound + 1`` of them."""
    return len(df.select(*df.columns[:1]).limit(bound + 1).collect()) <= bound


def collect_at_most(df: DataFrame, bound: int) -> list | None:
    """The rows, if there are at most ``bound``; None otherwise, having read no more than ``bound + 1``."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


KEPT = 3  # states that a Python worker keeps
_STATE: dict[tuple[str, str], object] = {}


class Shared:
    """A broadcast, and what a Python worker builds from it: once per process instead of once per task."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast, self.key = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value

    def state(self, make, kind: str = ""):
        """``make(value)``, built at the first call in this process; only the latest few are kept."""
        key = (self.key, kind)
        if key not in _STATE:
            while len(_STATE) >= KEPT:
                _STATE.pop(next(iter(_STATE)))
            _STATE[key] = make(self.value)
        return _STATE[key]


def beside(df: DataFrame, bound: int) -> DataFrame:
    """A lookup side for a join: broadcast if it has at most ``bound`` rows, else left to the planner."""
    return F.broadcast(df) if small_enough(df, bound) else df


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores where its files make fewer splits than that; large inputs pass unchanged.

    For operators whose work is far heavier than their bytes. ``df`` should be narrow already and free of shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def respread(df: DataFrame) -> DataFrame:
    """Spread an aggregate over the session's shuffle partitions, whatever few bytes it has: the next step is heavy."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
