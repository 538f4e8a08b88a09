"""Tables written so that running a job again changes nothing: partitioned shards, merges, append-only ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a finished table, asked through Spark's own file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, with multiplicity: one aggregate over both, no row reaches the driver."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        return False
    both = a.select(*columns, F.lit(1).alias("_n")).union(b.select(*columns, F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty()


def append_raw(df: DataFrame, path: str) -> None:
    """Append responses as gzipped JSON lines."""
    df.write.mode("append").option("compression", "gzip").json(path)


def rebuild(df: DataFrame, path: str, by: list[str]) -> None:
    """Write a derived table anew, partitioned; nothing of an earlier build stays."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def publish_shard(df: DataFrame, path: str, by: list[str]) -> bool:
    """Write an immutable, partitioned shard once. Running again with equal rows changes nothing and gives False; rows that
    differ raise ValueError. Spark's committer makes the folder visible as a whole."""
    spark = df.sparkSession
    if not _there(spark, path):
        df.write.option("maxRecordsPerFile", 250_000).partitionBy(*by).parquet(path)
        return True
    if not same_rows(df, spark.read.schema(df.schema).parquet(path)):
        raise ValueError(f"shard {path} is there with other rows")
    return False


def merge_into(new: DataFrame, path: str, keys: list[str]) -> int:
    """Add the rows whose key a table lacks and give their number. The merged table is written beside the old one, and the folder
    that readers take (``path``/version=<n>, the largest) changes by one write, so a crash leaves the old one."""
    from .landed import merge_new

    spark = new.sparkSession
    last = latest_version(spark, path)
    old = spark.read.schema(new.schema).parquet(f"{path}/version={last}") if last else new.limit(0)
    merged, added = merge_new(old, new, keys)
    merged.write.parquet(f"{path}/version={last + 1}")
    return added.first().added


def latest_version(spark: SparkSession, path: str) -> int:
    """The largest finished version of a merged table, 0 if there is none; one listing, however many there are."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return max((int(f.getPath().getParent().getName().removeprefix("version=")) for f in files or []), default=0)


def record_run(row: DataFrame, path: str, run_id: str) -> None:
    """Write a run's results once; a second record of the same run fails."""
    row.write.mode("errorifexists").json(f"{path}/run={run_id}")


def resume_plan(df: DataFrame, by: list[str], since: int, t: str = "t") -> DataFrame:
    """First and last time of each series, and whether it goes on from there or has to be filled back."""
    return df.groupBy(*by).agg(F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.when(F.max(t) >= since, "incremental").otherwise("backfill").alias("mode"))


def merged_series(parts: list[DataFrame], key: str) -> DataFrame:
    """One daily series of overlapping parts; raises ValueError if parts disagree on a key or a key is missing."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    values: list[Column] = [F.col(c) for c in every.columns if c != key]
    each = every.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("_d"), F.min(F.struct(*values)).alias("_v"))
    seen = each.agg(F.max("_d").alias("d"), (F.max(key) - F.min(key) + 1 - F.count("*")).alias("gaps")).first()
    if (seen.d or 1) > 1 or (seen.gaps or 0) > 0:
        raise ValueError(f"parts disagree ({seen.d}) or days are missing ({seen.gaps})")
    return each.select(key, "_v.*")
