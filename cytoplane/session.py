"""Session settings, lineage cuts and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Spark deletes what a statement has shuffled as soon as it ends, instead of when the driver next collects garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that the steps of ``cut_alone`` under way in this thread have written, the innermost last.
_PASSING = threading.local()


def get_spark(app: str = "cytoplane", master: str | None = None) -> SparkSession:
    """Session with the settings the operators expect; ``master`` only for tests."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        cores = os.environ.get("BENCH_CPUS", "8")
        builder = (
            builder.master(master)
            .config("spark.driver.memory", "16g")
            .config("spark.sql.shuffle.partitions", cores)
        )
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for code in tasks."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cytoplane-")) / "cytoplane_src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only for a local master (tests): on a
    cluster, lost executors could not read it back.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="cytoplane-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows.

    One pass over the input; what follows has no lineage behind it, survives
    lost executors, and is planned with the table's real size. What the pass
    has shuffled is deleted with its end.
    """
    path = workspace(df.sparkSession, "cut")
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    for written in getattr(_PASSING, "steps", [])[-1:]:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``cut(make())``, after which the tables that ``make`` has cut on its way are deleted.

    ``make`` must hand out nothing but its result.
    """
    steps = _PASSING.__dict__.setdefault("steps", [])
    steps.append([])
    try:
        made = make()
    except BaseException:
        steps.pop()
        raise
    passed = steps.pop()
    out = cut(made)
    for path in passed:
        _delete(spark, path)
    return out


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables passed between stages."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def _tables(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has passed between stages; call it once results are written."""
    _delete(spark, _tables(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan out to all cores if it has too few splits.

    For row-by-row work that costs far more than moving the row; a table with
    enough splits is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
