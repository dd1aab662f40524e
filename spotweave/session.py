"""Session helpers: defaults for a fresh session and durable cut points for long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from spotweave.checks import InputError

_OWN_DIRS: dict[str, str] = {}


def build_session(app_name: str = "spotweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on; on a cluster every value can be overridden by spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` when the cluster names one.

    Only on a local master, where driver and executors are one process, a local folder is made where that setting is absent, once per
    application. On a cluster that would scatter the files over machines, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise InputError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN_DIRS[app]


def materialise(df: DataFrame, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Lost executors then cost a re-read only, and the planner sees the real size and can prune columns. With `by`, a column by which the
    rows of `df` are dealt into `buckets` partitions already, the planner also learns that they lie together: groupings and windows by
    that column and any others move nothing. The files are in the shared folder all the same, the catalogue of the session has a name more.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(f"stored_{name}")
    return spark.table(f"stored_{name}")
