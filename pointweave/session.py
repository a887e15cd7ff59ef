"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_HOMES: set[str] = set()


def local_session(cores: int | str = 8, app: str = "pointweave", **extra: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where driver and executors are one process (tests, a laptop) and it is
    unset do the tables go below the session's warehouse; a cluster must name
    its shared folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    root = named or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A new path below the scratch folder; the session's own folder is removed when its JVM ends."""
    home = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        _files(spark, home).deleteOnExit(_path(spark, home))
    return f"{home}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, where: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)


def _files(spark: SparkSession, where: str):
    return _path(spark, where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: rows of the tables that loops write take about this many times their place in a file
UNPACKED = "8.0"


@contextmanager
def _true_sizes(spark: SparkSession) -> Iterator[None]:
    """While a loop's table is planned, tables count by their size in memory, so that Spark's broadcast threshold means that."""
    key = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(float(before), float(UNPACKED))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "t", partition_by: list[str] | None = None, **watch: Column) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The written table ends the lineage (a lost executor re-reads files, it does
    not recompute the chain), and its file sizes let Catalyst decide by a known
    size whether a side is small enough to broadcast.

    ``watch`` names aggregates that the write itself collects, so that a loop
    needs no second job to see whether it is done; they come back as ``seen``.
    In loops Spark plans by sizes in memory: what a loop broadcasts in every
    round has to fit the driver as often as the loop turns.
    """
    spark = df.sparkSession
    observation = Observation() if watch else None
    if watch:
        df = df.observe(observation, *[c.alias(k) for k, c in watch.items()])
    path = scratch_path(spark, name)
    schema = df.schema
    with _true_sizes(spark) if watch else nullcontext():
        writer = df.write.option("compression", "snappy")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._scratch = path
    back.seen = observation.get if watch else {}
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more (the earlier rounds of a loop)."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _files(df.sparkSession, path).delete(_path(df.sparkSession, path), True)


def is_empty(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) == 0
