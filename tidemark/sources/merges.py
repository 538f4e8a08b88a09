"""Tables that are merged by partition: a merge writes the partitions whose rows change and no other, and moves a pointer.

A table at ``path`` has data/shard=<hash>/<by>=<value>/ and manifest/version=<n>/, one row a partition: (part, shard, digest, rows).
The largest finished version is the table; shards are named by what they hold and are never changed, so a merge that
dies leaves the old table, and the same merge later finds or replaces its own shard. Of two merges at once, one fails on the version.
Manifests are read by the driver: a row for each partition (day, month), not for each file."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.store import stored
from .landed import merge_new
from .sinks import _there, latest_version

_MANIFEST = "part string, shard string, digest string, rows long"


def digests(df: DataFrame, by: str) -> DataFrame:
    """(part, digest, rows) of each partition: a hash of the sums of its rows' MD5s, which doesn't depend on order or files and
    combines before the shuffle. Equal rows count as often as they occur."""
    text = F.md5(F.to_json(F.struct(*sorted(c for c in df.columns)), {"ignoreNullFields": "false"}))
    half = lambda k: F.sum(F.conv(F.substring(text, k, 16), 16, 10).cast("decimal(20,0)"))
    sums = df.groupBy(F.col(by).cast("string").alias("part")).agg(half(1).alias("a"), half(17).alias("b"), F.count("*").alias("rows"))
    return sums.select("part", F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("a", "b", "rows"))), 256), 1, 32).alias("digest"), "rows")


def manifest(spark: SparkSession, path: str) -> dict[str, Row]:
    """The current partitions by their value; empty if there is no table yet."""
    n = latest_version(spark, f"{path}/manifest")
    return {r.part: r for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={n}").collect()} if n else {}


def _rows(spark: SparkSession, path: str, parts: list[Row], schema: StructType, by: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    x = spark.read.schema(StructType([*schema.fields, StructField("shard", StringType())])).option("basePath", f"{path}/data").parquet(*sorted({f"{path}/data/shard={r.shard}" for r in parts}))
    mine = F.concat_ws("/", "shard", F.col(by).cast("string")).isin([f"{r.shard}/{r.part}" for r in parts])  # on folders alone, so others are not read
    return x.where(mine).select(*schema.names)


def read_table(spark: SparkSession, path: str, schema: StructType, by: str, parts: list[str] | None = None) -> DataFrame:
    """The current rows, of some partitions or of all."""
    now = manifest(spark, path)
    return _rows(spark, path, [r for p, r in now.items() if parts is None or p in parts], schema, by)


def merge_partitions(new: DataFrame, path: str, keys: list[str], by: str) -> dict[str, int]:
    """Adds the rows whose key the table lacks (one a key) and tells how many were ``added`` and how many partitions ``written``. ``by``
    is one of the keys and is never null. Only partitions that new rows belong to are read; nothing is written for those that stay
    as they are. A finished shard of the same name with other rows raises ValueError."""
    if by not in keys:
        raise ValueError(f"{by} has to be one of the keys")
    spark, new = new.sparkSession, stored(new)
    touched = [r.part for r in new.select(F.col(by).cast("string").alias("part")).distinct().collect()]
    if None in touched:
        raise ValueError(f"{by} has rows without a value")
    now, version = manifest(spark, path), latest_version(spark, f"{path}/manifest")
    old = _rows(spark, path, [now[p] for p in touched if p in now], new.schema, by)
    merged = stored(merge_new(old, new, keys)[0])
    fresh = {r.part: r for r in digests(merged, by).collect()}
    changed = sorted(p for p, r in fresh.items() if p not in now or now[p].digest != r.digest)
    if not changed:
        return {"added": 0, "written": 0}
    name = hashlib.sha256("|".join(f"{p}={fresh[p].digest}" for p in changed).encode()).hexdigest()[:32]
    shard = f"{path}/data/shard={name}"
    if not _there(spark, shard):
        merged.where(F.col(by).cast("string").isin(changed)).repartition(by).write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy(by).parquet(shard)
    elif differing(spark, path, new.schema, by, [Row(part=p, shard=name, digest=fresh[p].digest) for p in changed]):
        raise ValueError(f"shard {shard} is there with other rows")
    rows = [(p, r.shard, r.digest, r.rows) for p, r in now.items() if p not in changed] + [(p, name, fresh[p].digest, fresh[p].rows) for p in changed]
    spark.createDataFrame(sorted(rows), _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest/version={version + 1}")
    return {"added": sum(fresh[p].rows - (now[p].rows if p in now else 0) for p in changed), "written": len(changed)}


def differing(spark: SparkSession, path: str, schema: StructType, by: str, parts: list[Row] | None = None) -> list[str]:
    """Partitions whose rows no longer give the digest they were written with."""
    want = list(manifest(spark, path).values()) if parts is None else parts
    have = {r.part: r.digest for r in digests(_rows(spark, path, want, schema, by), by).collect()}
    return sorted(r.part for r in want if have.get(r.part) != r.digest)
