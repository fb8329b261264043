"""Session helpers: local sessions, the package on executors, and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reclink")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RECLINK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' path, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_reclink_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="reclink-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "reclink_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._reclink_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where all run in one process, a new local one.

    On a cluster without that setting it raises: a machine's own folder would be another one on each executor.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_reclink_shared", None)
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="reclink-shared-")
        atexit.register(shutil.rmtree, path, True)
        sc._reclink_shared = found = f"file://{path}"
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/reclink/{label}-{uuid.uuid4().hex}"


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join on ids: never sent whole to driver and executors.

    Sizes of stored tables are those of their compressed columns, and rows that are exploded or collected from them aren't seen in
    Spark's estimates, so that a side with a row for each mention may pass for one that is small enough to broadcast.
    """
    return df.hint("merge")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows read from a table in the shared folder, which executors that are lost don't take along."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables of ``written`` frames that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {os.path.dirname(f) for df in frames for f in df.inputFiles()}:
        if "/reclink/" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
