"""Session defaults and the checkpoint folder used to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "sameas", **conf) -> SparkSession:
    """A session with the settings the operators count on. Cluster sizing
    (shuffle partitions, memory, checkpoint folder) stays with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. Only a local
    master, where driver and executors share one disk, gets one in its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(f"{warehouse.rstrip('/')}/checkpoints")     # Spark adds a folder for each run
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are on shared storage when this returns."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is not broadcast: both sides are dealt out by key and sorted. For rows behind an
    explode or a Python step, which Spark takes for as many as went in, and for tables whose files are much smaller than their rows."""
    return df.hint("merge")
