"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of this package expects.  Skewed joins are split by
# AQE, also where the split costs one more shuffle downstream.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_SHIPPED: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings, send the package to the workers, hand the session back."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="stowage-package-")) / "stowage.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(bundle))
    _SHIPPED.add(context.applicationId)


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read, as the cluster names it in the session.

    A machine-local folder is only made for a local master, where there is one
    machine, and only where the session names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="stowage-")
    return _LOCAL_FOLDERS[context.applicationId]


def through_table(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write a frame to a shared folder and read it back.

    Cuts the lineage with files that outlive any executor.  With a folder of the
    caller's the table is replaced on every call, so a job that runs in batches
    keeps one copy; otherwise each call makes a new table in the shared folder,
    which stays until `drop_tables`.
    """
    spark = df.sparkSession
    path = f"{folder}/{label}" if folder else f"{_tables_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete every table this application wrote between its steps.

    For the end of a job, when its results are stored: frames made from such
    tables can not be read afterwards.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
