"""Tables between the steps of an operator: they cut lineage, outlive lost executors, and go when no later step reads them."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which driver and executors share; where none is
    set, a temporary one, if all runs on one machine."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='meridian-')).rstrip('/')}/flow-{name}-{uuid.uuid4().hex}"


@dataclass
class Stored:
    rows: DataFrame
    path: str

    def remove(self) -> None:
        sc = self.rows.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str, before: Stored | None = None) -> Stored:
    """df written and read again; the table of the step before goes then."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if before is not None:
        before.remove()
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)
