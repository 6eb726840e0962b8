"""Session helpers: the shared scratch folder, lineage cuts that survive lost executors, shipping of this package."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) a folder inside the warehouse is set; on a cluster that is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/allelix-checkpoints")
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut`` for wide rows: by columns and packed, in the same folder, of which later readers take the columns they name."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(rows: DataFrame) -> DataFrame:
    """``rows``, whose columns are worked out once each: a filter is not pushed below them, where it would work them out again for each name in it."""
    return rows.select(F.inline(F.array(F.struct("*"))))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context; Spark serves the archive from the driver."""
    context = spark.sparkContext
    if getattr(context, "_allelix_shipped", False):
        return
    archive = os.path.join(context._temp_dir, "allelix.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    context._allelix_shipped = True
