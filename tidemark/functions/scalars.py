"""Column functions: null-safe arithmetic, clocks, candle shapes, carry and contract formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d where d is positive, else null."""
    return F.when(d > 0, n / d)


def positive(c: Column) -> Column:
    """Physically impossible values (zero, negative, NaN) become null."""
    return F.when((c > 0) & ~F.isnan(c), c)


def simple_return(now: Column, before: Column) -> Column:
    return F.when(before != 0, now / before - 1)


def log_return(now: Column, before: Column) -> Column:
    return F.when((before > 0) & (now > 0), F.ln(now / before))


def clipped(c: Column, bound: float = 10.0) -> Column:
    return F.greatest(F.least(c, F.lit(bound)), F.lit(-bound))


def clock(t: Column) -> dict[str, Column]:
    """Phase columns of a time in epoch seconds (UTC, weeks from Monday)."""
    return {
        "minute_15": (F.floor(t / 60) % 15).cast("int"),
        "minute": (F.floor(t / 60) % 60).cast("int"),
        "hour": (F.floor(t / 3600) % 24).cast("int"),
        "weekday": ((F.floor(t / 86400) + 3) % 7).cast("int"),
    }


def harmonics(t: Column) -> dict[str, Column]:
    """Time of day and day of week as points on circles, and a weekend flag."""
    day, week = 2 * F.pi() * (t % 86400) / 86400, 2 * F.pi() * ((t + 3 * 86400) % 604800) / 604800
    return {"day_sin": F.sin(day), "day_cos": F.cos(day), "week_sin": F.sin(week), "week_cos": F.cos(week), "weekend": ((F.floor(t / 86400) + 3) % 7 >= 5).cast("int")}


def candle(o: Column, h: Column, l: Column, c: Column) -> dict[str, Column]:  # noqa: E741
    """Range, place of the close and both wicks as shares of the range (null where high equals low)."""
    span = F.when(h > l, h - l)
    return {"span": h - l, "close_place": (c - l) / span, "upper_wick": (h - F.greatest(o, c)) / span, "lower_wick": (F.least(o, c) - l) / span}


def cost_aware_side(edge: Column, cost: Column) -> Column:
    """The edge's sign where it beats the cost, else 0; null and NaN are 0."""
    return F.when(~F.isnan(edge) & (F.abs(edge) > cost), F.signum(edge)).otherwise(F.lit(0)).cast("int")


def decimal_text_class(text: Column) -> Column:
    """absent, unparseable, non_positive or valid; only plain digits with one point count as a number."""
    clean = F.trim(text)
    return (
        F.when(text.isNull() | (clean == ""), "absent")
        .when(~text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), "unparseable")
        .when(F.try_to_number(F.lit("1"), F.lit("9")).isNull() | (text.try_cast("decimal(38,18)") <= 0), "non_positive")
        .otherwise("valid")
    )


def contract_quantity(size: Column, price: Column, value: Column, kind: Column) -> Column:
    """Base units of a number of contracts: value a contract in base, or in quote over the price; unknown kinds null."""
    return F.when(kind == "base", size * value).when((kind == "quote") & (price > 0), size * value / price)


def deviation(perp: Column, spot: Column, kappa: float, rate: Column, other: Column) -> Column:
    """kappa * (1 - exp(-(ln perp - ln spot))) - (rate - other); null rates give null."""
    return F.when((perp > 0) & (spot > 0), kappa * (1 - F.exp(-(F.ln(perp) - F.ln(spot)))) - (rate - other))


def no_arbitrage_bounds(kappa: float, cost: Column) -> tuple[Column, Column]:
    return kappa * F.log1p(-cost), kappa * F.log1p(cost)


def to_lot(quantity: Column, step: Column) -> tuple[Column, Column]:
    """Whole lots and what is left over."""
    lots = F.floor(quantity / step) * step
    return lots, quantity - lots


def position_size(capital: Column, reserve: Column, leverage: float, price: Column) -> Column:
    return (capital - reserve) * leverage / ((leverage + 1) * price)


def liquidation_fill(trigger: Column, high: Column, cap: Column) -> tuple[Column, Column]:
    """Fill price min(max(trigger, high), cap), and which of the three binds."""
    raw = F.greatest(trigger, high)
    return F.least(raw, cap), F.when(raw >= cap, "cap").when(high > trigger, "high").otherwise("trigger")


def band(value: Column, cuts: Sequence[float]) -> Column:
    """How many cut points are at or below the value."""
    out = F.lit(0)
    for c in cuts:
        out = out + (value >= c).cast("int")
    return F.when(value.isNotNull(), out)


def nearest_choice(value: Column, menu: Sequence[float]) -> Column:
    """The menu's value nearest to this one; of equals the smaller."""
    tries = F.transform(F.array(*map(F.lit, menu)), lambda m: F.struct(F.abs(value - m).alias("d"), m.alias("m")))
    return F.array_min(tries)["m"]


def era(t: Column, bounds: Sequence[tuple[str, int]]) -> Column:
    """Name of the last bound at or before the time, null before the first."""
    out = F.lit(None).cast("string")
    for name, start in bounds:
        out = F.when(t >= start, F.lit(name)).otherwise(out)
    return out


def logged(c: Column) -> Column:
    """ln of a positive value, else null."""
    return F.when((c > 0) & ~F.isnan(c), F.ln(c))


def side_of(mode: Column, driver: Column) -> Column:
    """1 or -1 of a side given in words: long, short, continuation (the driver's sign) or fade (against it); else null."""
    return F.when(mode == "long", 1).when(mode == "short", -1).when(mode == "continuation", F.signum(driver)).when(mode == "fade", -F.signum(driver)).cast("int")


def decimal_gap(a: Column, b: Column, scale: int = 12) -> dict[str, Column]:
    """Exact comparison of two numbers in text: equal, difference and basis points of the first."""
    x, y = (c.try_cast(f"decimal(26,{scale})") for c in (a, b))
    gap = (y - x).cast("double")
    return {"equal": x == y, "difference": gap, "bps": F.when(x != 0, gap / x.cast("double") * 10_000)}


def iso_week(ts: Column) -> Column:
    """The week's key, such as 2024-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def arrival_partition(ns: Column) -> dict[str, Column]:
    """Date and hour (UTC) of nanoseconds since the epoch."""
    s = F.floor(ns / F.lit(10**9).cast("long"))
    return {"arrival_date": F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int")), "arrival_hour": (F.floor(s / 3600) % 24).cast("int")}


def months_between(first: Column, last: Column) -> Column:
    """First days of all months from one date's to another's."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def known_costs(scenarios: dict[str, float | None]) -> dict[str, float]:
    """The scenarios themselves; refuses one whose rate is a placeholder (None)."""
    unknown = sorted(k for k, v in scenarios.items() if v is None)
    if unknown:
        raise ValueError(f"cost scenarios without a rate: {unknown}")
    return dict(scenarios)


def identity(*columns: str) -> Column:
    """sha256 over the row's columns as JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def sorted_json(text: Column, keys: Sequence[str]) -> Column:
    """A flat JSON object of whole numbers written again with its keys in order; null if it can't be read or lacks one."""
    parsed = F.from_json(text, ", ".join(f"`{k}` long" for k in sorted(keys)))
    whole = F.lit(True)
    for k in keys:
        whole = whole & parsed[k].isNotNull()
    return F.when(whole, F.to_json(parsed))
