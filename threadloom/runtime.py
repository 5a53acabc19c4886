"""Session-wide helpers: shared scratch tables, table loading, size checks.

Intermediate results that are read more than once are written as Parquet into the folder
the cluster names in ``spark.checkpoint.dir``; a lost executor then costs nothing but a
re-read.  Nothing here uses executor-local storage.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read.  Taken from the session; a temporary one only where it is unset and all threads are of one machine (tests)."""
    base = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{_CONF} must name a folder that all executors of {master} share")
        base = os.environ.get("THREADLOOM_TEST_DIR") or tempfile.mkdtemp(prefix="threadloom-")
        os.environ["THREADLOOM_TEST_DIR"] = base
    return base.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/threadloom/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that have not been written yet need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        drop_scratch(spark)
    except Exception:  # the JVM may be gone
        pass


_registered: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table in the shared folder; all of an application's are deleted when its driver ends."""
    root = _scratch(spark)
    if root not in _registered:
        _registered.add(root)
        atexit.register(_drop_at_exit, spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
