"""Session settings, table access and shared-folder materialisation."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


#: Folders made here, by application, where the session names none.
_own_dir: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the engine's defaults, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loomwork")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.driver.memory": "6g"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local one is made and set on a local master (tests); on a cluster, whose executors wouldn't share it, that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or _own_dir.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.sparkContext.setCheckpointDir(found)
        _own_dir[spark.sparkContext.applicationId] = found
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Cuts the lineage at a copy that survives the loss of any executor and, unlike a checkpoint, lets later
    stages read single columns. The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(path: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    try:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may already be gone
        pass


def core_count(spark: SparkSession) -> int:
    """Task slots of the running application."""
    return max(1, spark.sparkContext.defaultParallelism or os.cpu_count() or 1)
