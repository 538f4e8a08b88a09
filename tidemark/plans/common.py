"""What the registered queries share: bars in both engines, stored tables, and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import BAR, bars
from ..operators.store import checkpoint_folder, stored  # noqa: F401

#: The same bars for DuckDB.
BARS_SQL = f"""b as (select event_type as symbol, (epoch_us(ts) // 1000000 - epoch_us(ts) // 1000000 % {BAR}) as t, arg_min(value, (ts, event_id)) as open,
 max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as volume, sum(value::decimal(18,6))::double as volume_quote,
 count(*) filter (where user_id % 2 = 0) as taker_volume, coalesce(sum(value::decimal(18,6)) filter (where user_id % 2 = 0), 0)::double as taker_quote
 from (select event_type, value, user_id, ts, event_id from events) group by 1, 2)"""


def with_bars(sql: str, *more: str) -> str:
    return "with " + ", ".join([BARS_SQL, *more]) + " " + sql


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(events(spark, sf_dir))


def r6(c: Column) -> Column:
    return F.round(c, 6)
