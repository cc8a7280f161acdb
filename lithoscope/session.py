"""Session helpers: table loading, shared scratch folder, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Paths of the steps that this driver has written.
_SCRATCH: list[str] = []


def build_session(cores: int | str = "*", app: str = "lithoscope", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only in local mode (tests) and where that is unset a folder of this machine is made,
    which is removed at the end. On a cluster executors couldn't read each other's part
    of such a folder, so there an unset folder is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not got:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            got = jsc.get()
        elif spark.sparkContext.master.startswith("local"):
            got = tempfile.mkdtemp(prefix="lithoscope-")
            atexit.register(shutil.rmtree, got, ignore_errors=True)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(got)
    return got


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    path = os.path.join(shared_dir(spark), f"{tag}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the written steps of this driver, once their results aren't needed any more; how many there were."""
    n, conf = len(_SCRATCH), spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def materialise(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write a step to the shared folder and read it again: cuts the lineage.

    The copy is in the shared folder, so it outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only where at most `max_rows` rows were counted.

    The count stops one row after the bound; larger sides keep the join that
    the optimizer picks.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
