"""Session helpers: settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def get_session(app: str = "thermocline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and modest shuffle settings; conf overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that they need no installation.

    The driver serves the archive; nothing is read from its folder by others.
    """
    context = spark.sparkContext
    if not getattr(context, "_thermocline_shipped", False):
        top = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="thermocline-code-"), "thermocline.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        context.addPyFile(archive)
        context._thermocline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    On a cluster spark.checkpoint.dir names it, and it is an error where nothing does. Only with a
    local master (tests, one machine) a local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="thermocline-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(shared_dir(spark), f"thermocline-{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str, by: str | None = None, batch: int | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors.

    With `by`, a column of few values, each of its values has a folder of its own, which alone is read
    where a filter asks for that value. The column then stands last. With `batch`, the Python tasks of
    the write get no more rows than that in an Arrow batch, which bounds the memory of rows with texts.

    Its shuffles end with the write, so their files go at once; the table goes with forget(), with the
    step that it serves (see finished()) or, at the latest, when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _released_shuffles(spark), _small_batches(spark, batch):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    _tables(spark).add(path)
    columns = [f for f in df.schema if f.name != by] + [f for f in df.schema if f.name == by]
    return spark.read.schema(StructType(columns)).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    for name in _places(df):
        _delete(df.sparkSession, name)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a table; all tables that were written on the way to it are deleted."""
    before = set(_tables(spark))
    result = written(make(), name)
    own = {os.path.basename(x) for x in _places(result)}
    for path in _tables(spark) - before:
        if os.path.basename(path) not in own:
            _delete(spark, path)
    return result


def _places(df: DataFrame) -> set[str]:
    """The folders of the tables made by written() that df reads."""
    found = set()
    for x in df.inputFiles():
        while x and x != os.path.dirname(x):
            x = os.path.dirname(x)
            if os.path.basename(x).startswith("thermocline-") and len(os.path.basename(x)) > 24:
                found.add(x)
                break
    return found


def _tables(spark: SparkSession) -> set[str]:
    """The paths of the tables that written() made and nobody deleted."""
    context = spark.sparkContext
    if not hasattr(context, "_thermocline_tables"):
        context._thermocline_tables = set()
    return context._thermocline_tables


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)
    known = _tables(spark)
    known -= {x for x in known if os.path.basename(x) == os.path.basename(path)}


def _released_shuffles(spark: SparkSession):
    """Shuffle files of the queries run inside are removed when each query ends."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _small_batches(spark: SparkSession, rows: int | None):
    """Python tasks get Arrow batches of up to `rows` rows (None: as the session has it), fewer where the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(key))
    return nullcontext() if rows is None or 0 < own <= rows else _setting(spark, key, str(rows))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
