"""Session helpers: scratch tables that cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "rememora",
                  shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A UTC session with adaptive execution; cluster settings win where present."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # plans of finished queries are long and of no use; by default a driver keeps a thousand
        .config("spark.sql.ui.retainedExecutions", "10")
        .config("spark.ui.retainedJobs", "20")
        .config("spark.ui.retainedStages", "20")
        .config("spark.ui.retainedTasks", "500")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that
    folder would be invisible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="rememora-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Three effects at once: lineage is cut, a lost executor costs nothing, and
    the planner sees the true size, so it broadcasts the table only when it is
    below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Like ``settle``, but dealt into buckets of ``keys``, so that joins and groups on them need no shuffle.

    There are as many buckets as shuffle partitions, the number a cluster sets for its data. The files
    lie in the scratch folder; the session's catalog names them only until they are resolved.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys)
     .option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name))
    table = spark.table(name)
    # the plan holds files and buckets; an external table's files outlive its name
    spark.sql(f"DROP TABLE `{name}`")
    return table
