"""Session construction and cluster-safe settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session clock, AQE on (coalesce small
# shuffle partitions, split skewed join partitions), Arrow for pandas UDFs.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # partition sizing: AQE coalesces small post-shuffle partitions toward
    # the advisory size and splits skewed ones (a hot key) into several tasks
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    # stream state beyond the heap, and typed state variables
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Arrow batches for pandas functions (blocked top-k, folds) stay bounded
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int) -> dict:
    """Settings for a cluster run sized from the input volume: ~256 MB
    scan splits, an initial shuffle width of ~128 MB per partition (AQE
    coalesces it) and at least two waves of tasks."""
    slots = executors * cores_per_executor
    parts = max(2 * slots, input_bytes // (128 * 1024 * 1024))
    return {"spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
            "spark.sql.shuffle.partitions": str(int(parts)),
            "spark.default.parallelism": str(2 * slots)}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vigil", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the jobs expect.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that the
    Python functions of the jobs can be imported there from any folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    d = tempfile.mkdtemp(prefix="vigil-ship-")  # served to the executors until the application ends
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    tree = os.path.join(d, "tree")
    shutil.copytree(here, os.path.join(tree, "vigil"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(d, "vigil"), "zip", tree))
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is only read;
    with executors elsewhere and no such setting this fails.  Only a local
    master gets a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect session: the server owns the checkpoint folder
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d and sc is not None and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="vigil-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - static on some deployments; the context setting below suffices
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def local_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
