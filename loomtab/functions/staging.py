"""Written intermediate tables in the shared checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_SESSION_FOLDERS: dict[str, str] = {}
_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master only.

    The setting is fixed when a session starts, so the temporary folder is remembered here, not written back.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        root = _LOCAL_ROOTS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="loomtab-")
        _LOCAL_ROOTS[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def staging_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _SESSION_FOLDERS:
        _SESSION_FOLDERS[app] = f"{checkpoint_root(spark)}/loomtab/{app}"
    return _SESSION_FOLDERS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back: fixes non-deterministic layouts and cuts lineage.

    The table lives in shared storage, so a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge_staging(spark: SparkSession) -> None:
    """Drop what this application staged."""
    folder = _SESSION_FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
