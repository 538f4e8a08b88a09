"""Exact quantiles of groups of any size by refinement: rows are counted in buckets between a group's extremes, and only the
buckets that hold a wanted rank are counted again, until a bucket has one value or few rows. What meets in a task is a
group's buckets, or the few rows of a last bucket, never its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: Buckets of a round, rows of a bucket that are sorted at once, and rows of the largest group up to which Spark's own aggregate is used.
BUCKETS, FEW, DIRECT = 1024, 4096, 1_000_000


def _ranks(kind: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """The ranks (from 1) between which a quantile lies, and how far it is from the first."""
    if kind == "disc":
        rank = F.greatest(F.lit(1), F.ceil(n * p)).cast("long")
        return rank, rank, F.lit(0.0)
    at = (n - 1) * p
    return (F.floor(at) + 1).cast("long"), (F.ceil(at) + 1).cast("long"), at - F.floor(at)


def at_ranks(rows: DataFrame, targets: DataFrame, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(g, rank, value) for the ranks of targets (g, rank) in the stored rows (g, v); v: finite doubles."""
    span = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    open_ = stored(targets.join(span, "g").select("g", "rank", F.col("rank").alias("k"), "lo", "hi", "n"))
    found = open_.where("lo = hi").select("g", "rank", F.col("lo").alias("value"))
    while True:
        last = open_.where(f"lo < hi and n <= {few}")
        found = found.unionByName(_sorted(rows, last))
        open_ = open_.where(f"lo < hi and n > {few}")
        if open_.isEmpty():
            return found
        cells = open_.select("g", "lo", "hi").distinct()
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).alias("bucket")
        inside = rows.join(cells, "g").where("v between lo and hi").select("g", "lo", "hi", bucket, "v")
        counts = inside.groupBy("g", "lo", "hi", "bucket").agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = Window.partitionBy("g", "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # some buckets a cell
        counts = counts.withColumn("upto", F.sum("m").over(before))
        hit = open_.drop("n").join(counts, ["g", "lo", "hi"]).where("k <= upto and k > upto - m")
        open_ = stored(hit.select("g", "rank", (F.col("k") - F.col("upto") + F.col("m")).alias("k"), F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("m").alias("n")))
        found = found.unionByName(open_.where("lo = hi").select("g", "rank", F.col("lo").alias("value")))


def _sorted(rows: DataFrame, last: DataFrame) -> DataFrame:
    """The values of ranks whose cells have few rows."""
    cells = last.select("g", "lo", "hi").distinct()
    inside = rows.join(cells, "g").where("v between lo and hi")
    placed = inside.withColumn("k", F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("v")).cast("long")).select("g", "lo", "hi", "k", F.col("v").alias("value"))
    return last.select("g", "rank", "lo", "hi", "k").join(placed, ["g", "lo", "hi", "k"]).select("g", "rank", "value")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]], direct: int = DIRECT, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(by..., n, names...): exact quantiles of a numeric column as doubles; wanted: name -> ("cont" for interpolated or "disc" for the
    nearest rank, share). Null and NaN values are left out; a group without any other value has n = 0 and nulls."""
    key = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    v = F.col(value).cast("double")
    rows = stored(df.select(key.alias("g"), F.when(~F.isnan(v), v).alias("v")))
    sizes = stored(rows.groupBy("g").agg(F.count("v").alias("n")))
    fields = [F.col(f"g.{c}").alias(c) for c in by]
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= direct:
        own = [F.expr(f"percentile_{kind}({p}) within group (order by v)").alias(name) for name, (kind, p) in wanted.items()]
        return rows.groupBy("g").agg(F.count("v").alias("n"), *own).select(*fields, "n", *wanted)
    rows = rows.where("v is not null")
    ranks = [r for kind, p in wanted.values() for r in _ranks(kind, p, F.col("n"))[:2]]
    targets = sizes.where("n > 0").select("g", F.explode(F.array_distinct(F.array(*ranks))).alias("rank"))
    values = at_ranks(rows, targets, buckets, few).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # a few ranks a group
    out = []
    for name, (kind, p) in wanted.items():
        low, high, share = _ranks(kind, p, F.col("n"))
        a, b = F.element_at("at", low), F.element_at("at", high)
        out.append(F.when(F.col("n") > 0, a + (b - a) * share).alias(name))
    return sizes.join(values, "g", "left").select(*fields, "n", *out)
