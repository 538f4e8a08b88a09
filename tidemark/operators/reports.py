"""Aggregates that tell of a table: manifests, fingerprints, quantile summaries, trade and series reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import ordered


def manifest(df: DataFrame, step: int, digest: list[Column], by: list[str] | None = None, t: str = "t") -> DataFrame:
    """Rows, first and last time, expected and missing bars, and a content digest: the sum of the first eight hex digits of each
    row's MD5, so that neither order nor partitioning counts."""
    text = F.md5(F.concat_ws("|", *digest))
    part = F.conv(F.substring(text, 1, 8), 16, 10).cast("long")
    expected = F.floor((F.max(t) - F.min(t)) / step) + 1
    return df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.min(t).alias("first_t"), F.max(t).alias("last_t"), expected.alias("expected"), (expected - F.count("*")).alias("missing"), F.sum(part).alias("content"))


def source_digest(ledger: DataFrame, by: list[str], period: str, sha: str, at: str) -> DataFrame:
    """sha256 over the sorted lines "period sha" of each period's latest row; periods are few."""
    latest = ledger.groupBy(*by, period).agg(F.max_by(sha, at).alias("_sha"))
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", F.col(period).cast("string"), F.col("_sha"))))
    return latest.groupBy(*by).agg(F.count("*").alias("periods"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def nearest_ranks(df: DataFrame, by: list[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """n, min, nearest-rank quantiles, max, sum, sum of absolute values and mean of an exact decimal. Equal values are counted
    before they are ranked, so a group's distinct values, not its rows, meet in one window."""
    counted = df.groupBy(*by, value.alias("_v")).agg(F.count("*").alias("_n"))
    seen = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    x = counted.withColumns({"_seen": seen, "_total": total})
    ranks = [F.min(F.when(F.col("_seen") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_total"))), F.col("_v"))).alias(k) for k, q in quantiles.items()]
    return x.groupBy(*by).agg(F.sum("_n").alias("n"), F.min("_v").alias("min"), *ranks, F.max("_v").alias("max"), F.sum(F.col("_v") * F.col("_n")).alias("sum"), F.sum(F.abs("_v") * F.col("_n")).alias("sum_abs")).withColumn("mean", F.col("sum").cast("double") / F.col("n"))


def drawdown(df: DataFrame, keys: list[str], value: str, t: str = "t") -> DataFrame:
    """Largest fall of the running sum below its running maximum (which starts at the first value), by series."""
    from .bars import prefix

    x = prefix(df, keys, {"_sum": ("sum", value)}, t)
    x = prefix(x, keys, {"_top": ("max", "_sum")}, t)
    return x.groupBy(*keys).agg(F.max(F.col("_top") - F.col("_sum")).alias("max_drawdown"))


def trade_summary(trades: DataFrame, by: list[str], net: str, status: str, holding: Column) -> DataFrame:
    """Count, mean and median net, win rate, rates of each outcome, holding time and profit factor of closed trades."""
    x = F.col(net)
    lost = -F.sum(F.when(x < 0, x).otherwise(0.0))
    rates = [F.avg((F.col(status) == s).cast("int")).alias(f"{s}_rate") for s in ("take", "stop", "timeout")]
    return trades.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean_net"), F.median(x).alias("median_net"), F.avg((x > 0).cast("int")).alias("win_rate"), *rates, F.avg(holding).alias("mean_holding"), F.when(lost > 0, F.sum(F.when(x > 0, x).otherwise(0.0)) / lost).alias("profit_factor"))


def lags(df: DataFrame, by: list[str], lag: Column, accuracy: int = 10_000) -> DataFrame:
    """Exact counts and extremes of delays, and mergeable approximate quantiles."""
    x = df.select(*by, lag.alias("_lag"))
    return x.groupBy(*by).agg(F.count("_lag").alias("n"), F.count_if(F.col("_lag") < 0).alias("negative"), F.min("_lag").alias("min"), F.max("_lag").alias("max"), F.percentile_approx("_lag", [0.5, 0.99], accuracy).alias("q"))


def complete_series(df: DataFrame, key: str, values: list[Column], period: Column) -> DataFrame:
    """Of fragments of a daily series: rows, days, whether equal days agree in all values and whether no day is missing."""
    each = df.groupBy(period.alias("period"), F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.count_distinct(F.struct(*values)).alias("_d"))
    return each.groupBy("period").agg(F.sum("_n").alias("rows"), F.count("*").alias("days"), (F.max("_d") == 1).alias("consistent"), (F.max("_k") - F.min("_k") + 1 == F.count("*")).alias("gapless"))


def stale_runs(df: DataFrame, keys: list[str], stale: Column, t: str = "t") -> DataFrame:
    """Runs of consecutive stale rows: start, end and length."""
    x = ordered(df.withColumn("_s", stale.cast("int")), keys, {"_p": ("lag", "_s")}, t)
    from .bars import prefix

    x = prefix(x.withColumn("_new", (F.coalesce(F.col("_p"), F.lit(-1)) != F.col("_s")).cast("int")), keys, {"_run": ("sum", "_new")}, t)
    return x.where("_s = 1").groupBy(*keys, "_run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("bars")).drop("_run")
