"""What every operator needs of a session: tables, partitions and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir`` (a file or a directory of files)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names.

    Where none is named and all executors live in this process, as in tests, a local folder is made and deleted at the
    end; on a cluster a folder of this machine would be of no use to the others, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomstone-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared checkpoint folder; it is deleted when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back.

    A lost executor costs no recomputation, later plans read only the columns that they need, and Catalyst knows the
    size of what it joins.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, by Catalyst's statistics; no job is run for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core, for stages that compute much on few bytes.

    A scan that has partitions enough by its size stays as it is; only a small one is dealt out anew.
    """
    spark = df.sparkSession
    want = per_core * spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if input_bytes(df) >= want * split else df.repartition(want)
