"""Session helpers shared by all operators: table access and lineage cutting."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "gleanstone") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that checkpoints go to.

    It comes from ``spark.checkpoint.dir``, which a cluster points at storage that every executor
    sees. Where the setting is absent, a local session takes a temporary folder and a cluster a
    folder in its warehouse, never one of a single machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            alone = sc.master == "local" or sc.master.startswith("local[")
            folder = tempfile.mkdtemp(prefix=f"gleanstone-{os.getpid()}-") if alone else spark.conf.get("spark.sql.warehouse.dir") + "/gleanstone-checkpoints"
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application, by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        here, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        place = f"{checkpoint_folder(spark)}/gleanstone.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(place)
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(packed.getvalue())
        out.close()
        sc.addPyFile(place)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (one file or a folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there, so that a lost executor never loses the data."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def range_ordered(df: DataFrame, *by: str) -> DataFrame:
    """``df`` sorted over all partitions by the columns ``by`` and cut there.

    Equal sort keys share a partition and a hot leading key is spread over as many
    partitions as its rows need. The checkpoint pins the boundaries, so that later
    passes see the same partitions; ``spark_partition_id()`` numbers them in order.
    """
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by))
