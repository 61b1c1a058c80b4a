"""Session helpers: configuration for tests and benches, lineage cuts for clusters."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "clausespark") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    shuffle = str(cores) if str(cores).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per session, so they can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_clausespark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="clausespark-pkg-"), "clausespark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(target)
    context._clausespark_shipped = True


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session, whose executor is the driver itself, gets a temporary folder, one per
    process. On a cluster such a folder would be split over the machines, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local_folder()
    return folder


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="clausespark-")


class Scratch:
    """Tables that ``cut_lineage`` writes while this scope is open; all but what ``keep`` returns go when it ends.

    Scopes nest: what is kept belongs to the scope around, or stays if there is none. Nothing may read the
    other tables afterwards, so what leaves the scope must have come through ``keep``.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scratch.open.remove(self)
        for path in self.paths:
            self._delete(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as a table that outlives the scope."""
        above = Scratch.open[:Scratch.open.index(self)]
        path, kept = _written(df)
        if above:
            above[-1].paths.append(path)
        return kept

    def drop(self, df: DataFrame) -> None:
        """Delete the tables of this scope that ``df`` reads, if nothing needs them any more."""
        read = df.inputFiles()
        for path in [p for p in self.paths if any(p.split("/")[-1] in f for f in read)]:
            self.paths.remove(path)
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    path = f"{scratch_folder(df.sparkSession).rstrip('/')}/clausespark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Later steps that read it several times neither repeat the work nor lose it with an executor, and
    the planner sees its true size, which lets it choose broadcasts on its own. Inside a ``Scratch`` scope
    the table goes when the scope ends.
    """
    path, table = _written(df)
    if Scratch.open:
        Scratch.open[-1].paths.append(path)
    return table
