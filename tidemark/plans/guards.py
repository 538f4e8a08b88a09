"""Checks before a job runs: observable columns, declared columns, sealed time ranges."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL_PREFIX = "fwd_"


def observable(df: DataFrame) -> DataFrame:
    """The frame itself; fails if a column looks into the future."""
    ahead = [c for c in df.columns if c.startswith(LABEL_PREFIX)]
    if ahead:
        raise ValueError(f"label columns among features: {ahead}")
    return df


def declared(df: DataFrame, known: Collection[str]) -> DataFrame:
    """The frame itself; fails at columns that nobody declared."""
    odd = sorted(set(df.columns) - set(known))
    if odd:
        raise ValueError(f"undeclared columns: {odd}")
    return observable(df)


def split(df: DataFrame, bounds: dict[str, tuple[int, int | None]], name: str, sealed: Collection[str] = (), acknowledged: bool = False, t: str = "t") -> DataFrame:
    """Rows of a named split [start, end); the last may be open. A sealed split must be acknowledged."""
    if name in sealed and not acknowledged:
        raise PermissionError(f"split {name} is sealed")
    start, end = bounds[name]
    out = df.where(F.col(t) >= start)
    return out if end is None else out.where(F.col(t) < end)


def below_seal(df: DataFrame, cutoff: int, t: str = "t") -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and a one-row account of kept and dropped rows."""
    before = F.col(t) < cutoff
    return df.where(before), df.agg(F.count_if(before).alias("kept"), F.count_if(~before).alias("dropped"))


def sealed_input(df: DataFrame, seal: int, t: str = "t") -> DataFrame:
    """The frame itself; fails if it looks ahead or if a row lies at or behind the seal (one aggregate tells)."""
    observable(df)
    last = df.agg(F.max(t)).first()[0]
    if last is not None and last >= seal:
        raise ValueError(f"rows up to {last} lie behind the seal at {seal}")
    return df


def complete_cases(df: DataFrame, columns: Collection[str]) -> DataFrame:
    """Rows whose named columns are all there and finite numbers."""
    kinds, ok = dict(df.dtypes), F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            ok = ok & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return df.where(ok)


def coverage_gate(df: DataFrame, keys: list[str], period: Column, valid: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows of periods whose share of valid rows is at least ``least``, and the excluded periods of each series."""
    x = df.withColumn("_period", period)
    share = x.groupBy(*keys, "_period").agg((F.count_if(valid) / F.count("*") >= least).alias("_ok"))
    kept = x.join(share.where("_ok"), [*keys, "_period"], "left_semi").drop("_period")
    return kept, share.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col("_period")))).alias("excluded"))


def reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules (conditions that must not hold) that a row breaks."""
    return F.filter(F.array(*(F.when(broken, name) for name, broken in rules.items())), lambda x: x.isNotNull())


def available(df: DataFrame, registry: dict[str, str]) -> DataFrame:
    """The frame with each column's availability from a registry (name -> when its value is known) as metadata; fails at columns
    that it lacks or that look ahead."""
    declared(df, registry)
    return df.select(*(F.col(f"`{c}`").alias(c, metadata={"available": registry[c]}) for c in df.columns))


def availability(df: DataFrame) -> dict[str, str | None]:
    """What available() wrote, by column."""
    return {f.name: f.metadata.get("available") for f in df.schema.fields}
