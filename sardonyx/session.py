"""Session helpers: a local session for tests/bench and the checkpoint folder.

On a cluster the checkpoint folder must be a shared path given by the cluster
(``spark.checkpoint.dir``); we only pick a scratch folder ourselves when the
session runs in local mode and nothing was configured.
"""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sardonyx") -> SparkSession:
    """A local session configured like the cluster jobs (AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared folder is required on a cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sardonyx-ckpt-"))
    return sc.getCheckpointDir()


_OPEN = threading.local()


def _scopes() -> list[list[str]]:
    """The open scratch scopes of this thread, outermost first."""
    return _OPEN.__dict__.setdefault("scopes", [])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes():
        _scopes()[-1].append(path)
    return path


class scratch_scope:
    """Delete the intermediate tables written inside the block, except those kept.

    Use around a job whose result is itself a written table (or a driver-side
    value): once that result exists, the inputs written on the way (rank
    inputs, feature tables) are garbage -- at scale, whole copies of the data.
    What a scope keeps belongs to the scope around it, if there is one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: set[str] = set()

    def keep(self, path: str) -> str:
        self.kept.add(path)
        return path

    def __enter__(self):
        _scopes().append([])
        return self

    def __exit__(self, *exc):
        created = _scopes().pop()
        for path in created:
            if path not in self.kept:
                delete_path(self.spark, path)
            elif _scopes():
                _scopes()[-1].append(path)
        return False


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the cluster file system (the same one Spark wrote to)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folder_mark(spark: SparkSession, path: str) -> int:
    """A number that changes when a file directly in ``path`` (or in a folder in it) changes."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return hash(tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime())
                             for s in fs.listStatus(fs_path(path)))))


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the checkpoint folder and read it back.

    Used where a plan reads the same input twice (count pass + rank pass):
    the input is computed once, lineage is cut (a lost executor re-reads the
    shared files instead of recomputing upstream joins) and the count pass
    reads only the columns it needs.
    """
    return df.sparkSession.read.parquet(write_table(df, name))


def write_table(df, name: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as parquet to a fresh folder under the checkpoint folder; return the path.

    ``partition_by`` lays the table out in directories by low-cardinality
    columns (e.g. the split), so later filters on them prune whole directories.
    """
    path = scratch_dir(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run sized to the input (apply when building the session).

    Scan splits and shuffle partitions aim at ``target_partition_bytes`` so a
    task's data fits in executor memory with room for sorting (windows) and
    aggregation maps; AQE then merges small shuffle partitions and splits
    skewed ones at runtime.  The shuffle-partition count is an upper bound
    derived from the input size, not a guess of 200.
    """
    import math

    shuffle_parts = max(200, math.ceil(input_bytes / target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.codegen.cache.maxEntries": "1000",   # long-lived drivers reuse compiled stages
    }
