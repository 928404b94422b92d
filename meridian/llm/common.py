"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where the session names none and all of it runs on one machine (tests) is a temporary
    folder set; on a cluster its executors would write where the driver can't read.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="meridian-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Scratch tables of this process that are still there, oldest first.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _scratch.append(f"{shared_dir(spark)}/meridian-{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def scratch_tables() -> list[str]:
    return list(_scratch)


def remove_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no later job reads: whoever calls it has written what came of them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _scratch.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; it survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, *names: str) -> list[str]:
    """Column names for working columns that do not clash with those of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
