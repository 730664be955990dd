"""Session construction and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession

# Paths written within each open scratch_scope, outermost first.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def get_session(app: str = "tarnish", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on (all can be overridden)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # stages here compute much per byte: small partitions are worth a task
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: ``spark.checkpoint.dir``, else one in the warehouse.

    Every Spark session names a warehouse, and all executors share it; a machine's own
    temporary folder is never used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tarnish-scratch"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a plan reads the same expensive intermediate several times. The written table
    survives the loss of any executor and keeps column pruning, unlike a cached partition.
    Inside :func:`scratch_scope` it goes when the scope ends; :func:`discard` removes it sooner.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tarnish/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _SCOPES.get():
        scope.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialise` wrote, and nothing else."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Remove, at the end, every table that was materialised inside.

    What the caller still needs must have been written by then.
    """
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in mine:
            _delete(spark, path)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a stage that computes much per input byte: a task per core at least.

    Adaptive execution merges partitions by size, which would leave such a stage with few tasks.
    The volume decides through ``spark.sql.shuffle.partitions``, as for every other shuffle.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
