"""Session settings the operators rely on."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

#: Bytes of rows that Python workers get at once. Spark's own bound, 64 MB, is held several times over by a task and its worker.
BATCH_BYTES = 4 << 20


def local_session(cores: str = "8", memory: str = "12g", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cinderframe")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows pass to and from the session's Python workers in batches of about BATCH_BYTES, unless it asks for another size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from `spark.checkpoint.dir`.

    A folder of our own is made only where the setting is absent, which is the case in
    single-machine tests; a cluster without the setting gets an error instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="cinderframe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{os.urandom(6).hex()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a parquet table in the shared folder.

    For costly results that several branches of a plan read: they are computed once, each branch reads
    only its columns, and a lost executor costs no recomputation.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return _at(path, df.sparkSession.read.schema(df.schema).parquet(path))


def dealt(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The rows of `df` as a written table in buckets by `keys`, so that grouping and cogrouping by them move its rows no more.

    The files lie in the shared folder; the catalog's entry goes, for the plan holds what it needs of it.
    """
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{os.urandom(6).hex()}"
    path = new_folder(spark, name)
    df.repartition(count, *keys).write.format("parquet").bucketBy(count, *keys).option("path", path).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return _at(path, found)


def _at(path: str, table: DataFrame) -> DataFrame:
    """The table, with the folder that `dropped` takes away."""
    table._written_to = path
    return table


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Take away written tables that no later step reads, and the shuffle files of steps that have ended.

    The caller sees to it that all that was computed from the tables is written itself. Other tables stay. Spark removes shuffle files once the
    driver's garbage collector finds them unused, which in a long query may come after many more steps, so it is asked to look.
    """
    for path in (getattr(table, "_written_to", None) for table in tables):
        if path is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    spark._jvm.System.gc()
