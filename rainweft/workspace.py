"""Tables written between the stages of one operator.

Stages that are read more than once are written as Parquet under the folder of
``spark.checkpoint.dir``, which every executor shares, so a lost executor costs
a task and not the lineage. Only a local session (tests, one machine) gets a
folder of its own where the setting is absent; on a cluster that is an error.
``cleared`` deletes what a session has written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rainweft.errors import DataModelError

_SETTING = "spark.checkpoint.dir"
_live: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``; made and set once per session where a local session lacks it."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise DataModelError(f"{_SETTING} is not set; name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rainweft-")
        spark.conf.set(_SETTING, found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return a reader of that table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rainweft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _live.add(path)
    out.__dict__["_rainweft_path"] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _live.discard(path)


def dropped(df: DataFrame) -> None:
    """Delete the table behind a reader from ``written``, once nothing to come reads it."""
    path = df.__dict__.pop("_rainweft_path", None)
    if path:
        _delete(df.sparkSession, path)


def cleared(spark: SparkSession) -> int:
    """Delete all intermediate tables of this process; results read from them must have been used. Returns their number."""
    paths = list(_live)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def require(df: DataFrame, *names: str) -> DataFrame:
    """Select just ``names``, so further columns of the input never clash."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise DataModelError(f"columns {lacking} are missing; there are {df.columns}")
    return df.select(*[df[n] for n in names])
