"""Session helpers: a tuned local session for tests/bench, checkpoint-dir policy,
and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_SHIPPED = False


def ship_package() -> None:
    """Let Python workers unpickle functions defined in this package.

    The Arrow kernels (``mapInArrow`` / ``applyInArrow``) live in ``quarry``;
    when the package is not installed on executors (nor shipped with
    ``--py-files``), functions from it are pickled by value.
    """
    global _SHIPPED
    if _SHIPPED:
        return
    import pyspark.cloudpickle as cloudpickle

    import quarry

    cloudpickle.register_pickle_by_value(quarry)
    _SHIPPED = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and streaming state.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode
    session without that setting (tests) gets a folder of our own; on a
    cluster a machine-local folder would not survive executor loss, so an
    unset setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this cluster")
    local = tempfile.mkdtemp(prefix="quarry-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench.  On a cluster, use the provided session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName("quarry")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # partial WindowGroupLimit for the 10,000-bucket facet caps as well
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "20000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package()
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name: str = "stage", path: str | None = None):
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, and
    survives the loss of any executor."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
