"""Session settings, shared folders and written stages."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from functools import cache
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

# Static and runtime settings the jobs are written for. Partition counts are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The default, INT96, carries no statistics, so a cutoff could skip no row group of a written table.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Rows of a text column decoded at a time; 4096 long texts would fill a task's memory.
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "shelflife", **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_base() -> str:
    """A folder for local mode that goes when the process ends."""
    base = tempfile.mkdtemp(prefix="shelflife-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run below the checkpoint folder every executor can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/shelflife/{purpose}-{uuid.uuid4().hex}"


def mounted_path(uri: str) -> str:
    """The path by which tasks open files of a folder on a mount every executor sees."""
    parts = urlsplit(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"files are read and deleted through a mount, not through {parts.scheme}://")
    return unquote(parts.path) if parts.scheme else uri


def is_written(spark: SparkSession, path: str) -> bool:
    """True if a write job has committed ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _folder(spark: SparkSession, name: str):
    """A folder given by its path or, as files report it, by its URI."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(spark._jvm.java.net.URI(name)) if urlsplit(name).scheme else hadoop(name)


def local_name(spark: SparkSession, uri: str) -> str:
    """The path, as readers take it, of a folder given by its URI."""
    return _folder(spark, uri).toString()


def folder_exists(spark: SparkSession, name: str) -> bool:
    target = _folder(spark, name)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop_folder(spark: SparkSession, name: str) -> bool:
    target = _folder(spark, name)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, making the folders above its new place."""
    old, new = _folder(spark, source), _folder(spark, target)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(old):
        return
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def bound_run_dir(spark: SparkSession, run_dir: str | None, purpose: str, **arguments) -> str:
    """The folder of a run, a new one if none is given, bound to the run's arguments.

    A folder that holds a run with other arguments is refused, since its stages would be taken for this run's.
    """
    run_dir = run_dir or shared_dir(spark, purpose)
    wanted = json.dumps({"purpose": purpose, **arguments}, sort_keys=True, default=str)
    found = write_once(spark.createDataFrame([(wanted,)], "arguments string").coalesce(1), f"{run_dir}/arguments").first()[0]
    if found != wanted:
        raise ValueError(f"{run_dir} holds another run: {found}")
    return run_dir


def write_once(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), **options) -> DataFrame:
    """Write ``df`` to ``path`` unless an earlier attempt of the run committed it, then read it.

    A stage read back from a written table has no lineage to recompute, so a lost executor
    never repeats the listing or the side effect behind it.
    """
    spark = df.sparkSession
    if not is_written(spark, path):
        df.write.mode("overwrite").options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
