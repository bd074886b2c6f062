"""Session helpers shared by every job: as-of time, shared scratch folder, checkpoints."""

from __future__ import annotations

import atexit
import datetime as dt
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_of_time(as_of: dt.datetime | str | None = None) -> dt.datetime:
    """The run's reference time as zone-less UTC; a zone-less input is taken as UTC."""
    if as_of is None:
        return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        return as_of
    return as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)


def ntz(value: dt.datetime | str | None = None) -> Column:
    """``value`` as a TIMESTAMP_NTZ literal, independent of the session zone."""
    text = as_of_time(value).isoformat(sep=" ", timespec="microseconds")
    return F.expr(f"timestamp_ntz'{text}'")


def cutoff(as_of: dt.datetime | str | None, hours: float) -> Column:
    """Start of the look-back window as a literal, so the comparison reaches the scan."""
    return ntz(as_of_time(as_of) - dt.timedelta(hours=hours))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Where it is unset a session of one machine gets a folder of its own that is dropped with
    it; on a cluster that is an error, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder.rstrip("/")
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per Spark context.

    Needed where it is not installed on the executors; jobs may start in any folder.
    """
    context = spark.sparkContext
    if getattr(context, "_gleanery_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(root)
    folder = tempfile.mkdtemp(prefix="gleanery-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "gleanery.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    archive.write(os.path.join(where, name), os.path.relpath(os.path.join(where, name), parent))
    context.addPyFile(path)
    context._gleanery_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/gleanery/{name}-{uuid.uuid4().hex}"


def freeze_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from there.

    This cuts the lineage. Values that may differ when a lost task is run again
    (sampled sort bounds, generated ids) must be frozen before another job relies
    on them; results that several jobs read are frozen so as to be computed once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
