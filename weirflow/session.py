"""Session helpers: table access, shared scratch folder, durable cuts of the lineage."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "weirflow", cores: str = "*", **conf: object) -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from outside."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), str(v))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of intermediate data that this process made, by the folder they are in; removed at its end.
_made: set[str] = set()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent and driver and executors are one process (tests, a laptop) a local folder is made and set;
    on a cluster its executors would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weirflow-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this process below the shared folder."""
    at = f"{shared_dir(spark)}/weirflow/{spark.sparkContext.applicationId}-{os.getpid()}"
    if not _made:
        atexit.register(clear_scratch, os.getpid())
    _made.add(at)
    return at


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(owner: int | None = None) -> None:
    """Remove all intermediate data of this process; frames made from it can't be read any more. Runs at the end of the process, not of its forks."""
    for at in list(_made) if owner in (None, os.getpid()) else []:
        _made.discard(at)
        try:
            remove_tree(at)
        except Exception:  # noqa: BLE001 - the session or its file system may be gone already
            logging.getLogger(__name__).warning("couldn't remove %s", at)


def remove_tree(uri: str) -> None:
    """Remove a folder through the running session, which knows every file system of the cluster; without one through pyarrow."""
    session = SparkSession.getActiveSession()
    if session is not None and session._jsc is not None and session._jsc.sc() is not None and not session._jsc.sc().isStopped():
        path = session._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
        return
    place, inner = opened(uri)
    from pyarrow import fs

    if place.get_file_info(inner).type != fs.FileType.NotFound:
        place.delete_dir(inner)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan is cut and survives lost executors."""
    spark = df.sparkSession
    to = scratch(spark, label)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def opened(uri: str):  # noqa: ANN201
    """File system and inner path of a place in the shared folder, for readers outside of the JVM."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
