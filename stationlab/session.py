"""Session helpers: building a session for tests/bench and finding the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# Runtime SQL settings this library relies on; each is applied only where the submitter has not
# set it.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Static settings given to the builder, so they hold from the moment the context starts: no web
# UI server and no console progress bar.
STATIC = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "stationlab",
              driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects.

    On a cluster the submitter supplies master, memory, shuffle partitions and the checkpoint
    folder; this only fills in what is unset (``DEFAULTS``), and sets the shuffle partition count
    only when asked to (local runs: bench, tools, tests).  AQE stays on: it coalesces small
    shuffle partitions and splits skewed join partitions, which the per-key joins rely on when a
    station holds a large share of the rows.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in STATIC.items():
        builder = builder.config(k, v)
    if driver_memory:
        # local mode runs every task inside the driver JVM, so its heap is the executors' memory;
        # it only takes effect when this call starts the JVM
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    conf = spark.sparkContext.getConf()
    for k, v in DEFAULTS.items():
        if not conf.contains(k):
            try:
                spark.conf.set(k, v)
            except Exception:  # noqa: BLE001  (static settings of a running context cannot change)
                pass
    if shuffle_partitions is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, reading the cluster's setting first.

    Only a local-mode session without any setting gets a private temporary folder; a cluster
    session without ``spark.checkpoint.dir`` is an error, because a machine-local folder would
    not survive the loss of the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for this cluster")
    path = tempfile.mkdtemp(prefix="stationlab-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def env_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
