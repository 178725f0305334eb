"""Session settings and lineage cutting."""
from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytes of a file or of a shuffle that a task reads at most inside ``small_tasks``, and rows as far as single keys allow.
TASK_BYTES, TASK_ROWS = 16 << 20, 500_000


def build_session(app: str = "quartier", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution sizes shuffles from the data (start high, coalesce at run time), turns
    joins with a small measured side into broadcast joins and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # geometry work is heavy per byte: keep small shuffles spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        # checkpoints of finished rounds go once nothing refers to them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a local one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="quartier-checkpoint-")
    sc.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so later steps neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Settings for steps that sort or group short rows, which take many times their compressed bytes of memory.

    What runs inside (a checkpoint, say) reads TASK_BYTES a task instead of Spark's 64 or 128 MB, and shuffles of
    ``rows`` rows have a partition for every TASK_ROWS of them. So a task's memory doesn't grow with the input. Smaller settings of the session stay.
    """
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    most = {k: TASK_BYTES for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")}
    wanted = {k: str(v) for k, v in most.items() if as_bytes(spark.conf.get(k)) > v}
    parts = "spark.sql.shuffle.partitions"
    wanted |= {parts: str(-(-rows // TASK_ROWS))} if rows > TASK_ROWS * int(spark.conf.get(parts)) else {}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
