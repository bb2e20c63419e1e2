"""Session helpers: a local session for tests, table loading, and the folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "kelindan", **conf: str) -> SparkSession:
    """A local session with the settings that every result here assumes (UTC, AQE, Arrow)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan that comes in fewer splits than there are cores, as a small file does, is spread over them, for queries whose work per row is large. A
    scan of many splits stays as it is: what it reads, by the files' sizes, fills the cores anyway. The rows are the same either way."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in ``spark.checkpoint.dir``, or the application by ``setCheckpointDir``. Where both are unset, a
    local session, whose executors are this machine, gets a temporary folder; any other raises, as executors would each write to a disk of their own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="kelindan-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/kelindan-{label}-{uuid.uuid4().hex}"
    if jvm := getattr(spark, "_jvm", None):
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back, so that a lost executor costs no recomputation
    of what came before and a table that is used twice is computed once."""
    spark = df.sparkSession
    path = scratch(spark, label) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
