"""Session defaults, lineage cuts and scratch tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(name: str = "quern", **conf: str) -> SparkSession:
    """A session with the library's defaults; settings given by the caller win."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where none is set, a local session (everything on one machine, as in tests) gets a temporary one; on a cluster it is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quern-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df with a reliable checkpoint, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder for one job, which are removed together when it no longer needs them.

    They are compressed and columnar, so they take less room than checkpoints, and a reader takes the columns it needs only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
        self.n = 0

    def add(self, df: DataFrame, name: str | None = None, *, by: list[str] | None = None) -> DataFrame:
        """df written and read again; rows are appended to those that the table of this name has. by: folders by these columns."""
        self.n += 1
        to = f"{self.path}/{name or self.n}"
        writer = df.write.mode("append").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(to)
        return self.spark.read.schema(df.schema).parquet(to).select(*df.columns)

    def drop(self, name: str | None = None) -> None:
        """Remove one table, or all."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; they need no path to it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quern", "zip", package.parent, package.name))
        _shipped.add(app)
