"""Session factory and the few cluster settings the library reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(app: str = "murmura", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested with.

    On a cluster, build the session there and pass it in; nothing in the
    library needs this function.
    """
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset and the master
    is local, as in tests, a temporary folder becomes the checkpoint folder; on a
    cluster no local folder will do, so there it has to be set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="murmura-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of intermediate tables that this process has named, in order.
_scratch: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, in the folder that all share."""
    path = f"{shared_dir(spark)}/murmura-{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch folders named from number ``since`` on, once what was read from them has been written elsewhere; how many are left."""
    while len(_scratch) > since:
        remove(spark, _scratch.pop())
    return len(_scratch)


def scratch_count() -> int:
    return len(_scratch)


def cut(df):
    """``df`` read back from the checkpoint folder: its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, in whichever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """While this lasts, Spark drops the shuffle files of a query when the query has ended.

    For work of many steps, each of which writes its result: else the files stay
    until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
