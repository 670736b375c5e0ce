"""Session helpers: defaults for a local run, and lineage cutting that survives lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.caseSensitive": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, app: str = "siftline") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", "12g")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    return builder.getOrCreate()


#: Rows and bytes of an Arrow batch at most, where a Python function makes much more of a text than the text itself.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches() -> None:
    """Bound the Arrow batches of the active session, so that a Python worker's memory does not grow with the rows of a task;
    smaller settings stay."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = re.fullmatch(r"(\d+)([kmg]?)b?", (spark.conf.get(key, None) or "").lower())
        number = int(held[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[held[2]] if held else 0
        if not 0 < number <= most:
            spark.conf.set(key, str(most))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; on a local master, a temporary one where none is set."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    target = configured or tempfile.mkdtemp(prefix="siftline-checkpoint-")
    sc.setCheckpointDir(target)
    return target


#: Tasks to a core where rows are dealt out, so that none takes as long as the whole job.
TASKS = 4


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for work that is heavy per row, when the input has fewer splits than cores.

    Large inputs have more splits than cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(TASKS * cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that loops neither grow their plan nor lose work with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
