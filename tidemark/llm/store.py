"""Where operators keep intermediate tables: the shared checkpoint folder that the session names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set, as in tests on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and stored in the shared checkpoint folder; the plan starts anew from there,
    and a lost executor costs nothing that has been stored."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared checkpoint folder and read again. For loops: checkpoint() carries the
    optimizer's size estimates over, which joins multiply, so that their digits grow with each round."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(stored: DataFrame) -> None:
    """Remove a table that written() has stored and nobody reads any more."""
    jvm = stored.sparkSession.sparkContext._jvm
    for folder in {file.rsplit("/", 1)[0] for file in stored.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that nobody refers to any more. It does so after a garbage collection of the
    driver, which comes late where the driver has little to do, while the files fill the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_hot_keys(left: DataFrame, right: DataFrame, key: str, copies: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of a stored table with one row a key, which counts the left's rows of its key in ``copies``. Keys with more
    than 1/``share`` of all ``total`` rows can't be more than ``share``: these are broadcast, and the rest are shuffled."""
    hot = F.col(copies) * share > total
    many = F.broadcast(right.where(hot))
    rest = left.join(many.select(key), key, "left_anti").join(right.where(~hot), key, "left")
    return left.join(many, key).unionByName(rest)


def dealt(spark: SparkSession, n_bytes: int | None, each: int = 4 << 20) -> int:
    """Into how many groups to deal what is made of so many bytes of text, so that a group stays small at any size."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (n_bytes or 0) // each + 1)


def drawn(key: Column, share: Column | float) -> Column:
    """Whether a row is in a sample of this share, by 62 bits of the hash of its key: shares as small as 1e-18 still draw."""
    return F.shiftrightunsigned(key, 2) < (F.lit(share) * float(1 << 62)).cast("long")
