"""Session helpers: configuration, checkpoints and the shared work folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of the files in the work folder, which hold copies of texts and ids.
COMPRESSION = "zstd"


def build_session(app: str = "memlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job of this package assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local folder only on a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-memlake-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def work_folder(spark: SparkSession) -> str:
    """Folder all executors share: the checkpoint folder of this application, removed when it ends."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, ends the plan's growth."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared work folder as Parquet, and read from there.

    Unlike a checkpoint, which runs the last stage a second time and keeps whole rows, the
    files are packed by column and a reader takes the columns and row groups it asks for.
    The order and the partitions of ``df`` are not kept.
    """
    path = f"{work_folder(df.sparkSession)}/written/{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of finished steps to which nothing refers any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
