"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def by_value(module: str) -> None:
    """Sends a module's classes by value: a stream's state is prepared in a worker beside the driver, which has no shipped files."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, with the settings that the queries expect."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows and bytes of an Arrow batch, so that neither side holds many long texts at once; lists of values that reach a scan.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "1m", "spark.sql.parquet.pushdown.inFilterThreshold": "80"}


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches; without it a batch holds 10,000 texts, however long."""
    for name, value in ARROW_BATCHES.items():
        spark.conf.set(name, value)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, wherever they run, and bounds Arrow batches."""
    app = spark.sparkContext.applicationId
    bound_batches(spark)
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        staged = Path(folder, "staged")
        shutil.copytree(root, staged / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(), f"{root.name}-{app}")), "zip", staged)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    A session on one machine without either gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            path = found.get()
        elif context.master.startswith("local"):
            path = "file://" + tempfile.mkdtemp(prefix="sparloom-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df):
    """df without its lineage, by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df, name: str):
    """df written to the shared folder and read from there, so that plans know its size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
