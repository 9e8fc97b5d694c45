"""Session construction and lineage helpers.

Scale notes
-----------
* AQE stays on (partition coalescing and skew-join splitting); the fact
  joins against per-key aggregates rely on ``skewJoin`` to split a hot key.
* Lineage is cut with reliable ``checkpoint()`` into the directory the
  cluster names in ``spark.checkpoint.dir``.  A private directory is only
  created when the session has none *and* runs in local mode (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their RDD is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "vitrine", extra: dict | None = None) -> SparkSession:
    """Session used by tests and the bench (local mode)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "10g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20,
                 max_partitions: int = 100_000) -> dict:
    """Settings for a cluster session sized from the input volume.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (at least 3 waves of the cores), capped at ``max_partitions``
    because shuffle blocks grow as map tasks x reduce partitions; shuffled
    data is far smaller than the scanned input after pruning and partial
    aggregation, and AQE coalesces small partitions and splits skewed ones
    (over 4x the median and 256 MB) at runtime.  File splits follow the
    target, so a scan task holds a bounded slice of input.
    """
    waves = 3 * max(1, total_cores)
    parts = min(max(waves, -(-int(input_bytes) // target_partition_bytes)), max(max_partitions, waves))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, creating one only locally."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) sessions: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: set it to a shared folder for the cluster")
    local_dir = tempfile.mkdtemp(prefix="vitrine-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vitrine`` importable in the Python workers (once per context).

    Pandas-UDF kernels and helpers are pickled by module reference, so the
    workers need the package on their path wherever the driver runs from.
    The package is zipped on the driver and handed to ``addPyFile`` (the
    ``--py-files`` mechanism), which distributes it to every executor.
    """
    import zipfile
    try:
        sc = spark.sparkContext
        key = id(sc._jsc)
    except Exception:  # remote (Connect) session
        sc, key = None, ("connect", id(spark))
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="vitrine-pyfiles-"), "vitrine.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (tables, streams)."""
    import uuid
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: writes the frame and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: cuts the lineage like
    ``materialize``, but in compressed columns, of which readers take only theirs.
    For frames with texts or many rows."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
