"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench (no UI, UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfrank")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files of DataFrames no longer referenced are deleted
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def scale_conf(input_bytes: int, cores: int, partition_bytes: int = 256 << 20,
               shuffled_share: float = 0.25) -> dict[str, str]:
    """Runtime SQL settings for a cluster run over ``input_bytes`` of fact data
    on ``cores`` executor cores (pass them to the session builder or
    ``spark.conf.set``).

    * scan splits of ``partition_bytes`` (256 MiB: about 400k tasks for 100 TB);
    * shuffle partitions: one per 256 MiB of the bytes that the largest shuffle
      moves, ``shuffled_share`` of the input, and three waves of the cores at
      least. Aggregates send partial sums, far less; but the joins of the fact
      with dimensions too large to broadcast send its needed columns, about a
      quarter of it. AQE coalesces small stages to the advisory size and splits
      skewed join partitions;
    * broadcast joins only below 64 MiB: of our joins only fixed dimensions
      (months, store names, one-row totals) are hinted.

    Set at start-up as well: ``spark.checkpoint.dir`` (shared storage) and
    ``spark.cleaner.referenceTracking.cleanCheckpoints=true``.
    """
    shuffle = max(3 * cores, int(-(-input_bytes * shuffled_share // (256 << 20))))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage. Only a local-mode
    session (tests, bench) with the setting unset gets a fresh folder under
    the system temp; a cluster session without it is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...)")
        d = tempfile.mkdtemp(prefix="shelfrank-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def persist_table(df, spark: SparkSession, name: str):
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts lineage so a lost executor only recomputes from the written table;
    used for marts that several outputs reuse. ``drop_table`` deletes it; what
    is left goes when the driver ends.
    """
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``scratch_path`` named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df) -> None:
    """Deletes the files of a ``persist_table`` result; nothing may read it (or
    a frame built on it) afterwards."""
    drop_path(df.sparkSession, df._scratch_path)


def materialize(df):
    """Reliable checkpoint of ``df`` to the shared checkpoint folder (never
    ``localCheckpoint``): later branches read the same rows, and a lost
    executor recomputes nothing before this point."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the session's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p))
