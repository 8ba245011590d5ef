"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC because every instant is an epoch number; AQE because skewed keys are split at run time.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Shuffled bytes a task takes together, and stored bytes of input for each first partition: a compressed column file
#: grows about fourfold when its rows are shuffled.
TASK_BYTES = 16 << 20
INPUT_BYTES_A_PARTITION = 4 << 20


def build_session(app_name: str = "faultlens", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or join) a session; cluster deployments pass their own master and sizes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else started."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_tasks(spark: SparkSession, *inputs: str) -> SparkSession:
    """Let the number of tasks grow with the input, so that what a task sorts does not.

    A task takes shuffled rows up to AQE's target, a multiple of which it holds in memory; below one first partition it
    cannot go, so a large input gets more of those than the session names.
    """
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in inputs]
    size = sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    first, named = -(-size // INPUT_BYTES_A_PARTITION), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if first > named:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", first)
    else:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage; the cluster names it in spark.checkpoint.dir.

    A session that names none takes a folder of its warehouse. That must not lie on one machine while executors run
    on others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    master = spark.sparkContext.master
    local = master == "local" or master.startswith("local[")
    if not local and warehouse.startswith(("file:", "/")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return warehouse


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that this session cut its lineage with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_dir(spark: SparkSession) -> str:
    """This session's own folder in the shared one."""
    return f"{shared_dir(spark)}/faultlens-{spark.sparkContext.applicationId}"
