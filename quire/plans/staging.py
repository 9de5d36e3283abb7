"""Staged tables: Parquet in the folder that all executors share.

Staging cuts the lineage where a result is used more than once. Any executor can read the
files again, so a lost one costs no recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_used: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; it goes when the program ends.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster executors would not share it, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[:] = _own or [f"file://{tempfile.mkdtemp(prefix='quire-shared-')}"]
        folder = _own[0]
    path = f"{folder.rstrip('/')}/quire-{spark.sparkContext.applicationId}"
    if path not in _used:
        _used[path] = spark
        atexit.register(_delete, spark, _own[0] if _own and path.startswith(_own[0]) else path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc
        found = jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(conf.hadoopConfiguration()).delete(found, True)
    except Exception:  # the JVM may be gone already
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``staged`` made and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.staged_at)
