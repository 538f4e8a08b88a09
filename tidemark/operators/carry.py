"""Two-leg carry trades: funding cash flows, margin paths, mark prices with their provenance, and landed rate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_after, interval_join

RAY = 10**27


def two_leg_fills(signals: DataFrame, bars: DataFrame, keys: list[str], cancel: int, capital: float, leverage: float, lot: float, least: float, t: str = "t") -> DataFrame:
    """Where both legs of a trade are filled: signals (keys, id, entry_signal, exit_signal) against bars (keys, unique time, spot_open,
    perp_open). A fill is the first bar strictly after its signal, at most ``cancel`` seconds later, that has both opens; bars
    without one of them are passed over.

    A trade without such a bar for its entry isn't opened. Its size is what ``capital`` pays for both legs, rounded down to lots; none or
    less than ``least`` of the perpetual isn't opened either. The exit is sought after the entry and its own signal; if there is none in
    time, the series' last bar with both legs counts, and if that isn't after the entry, the trade has no exit. Adds reason (null
    if opened), entry_t, spot_entry, perp_entry, quantity, residual, exit_kind (signal, last or none), exit_t, spot_exit and perp_exit."""
    both = bars.where((F.col("spot_open") > 0) & (F.col("perp_open") > 0)).select(*keys, t, "spot_open", "perp_open")
    last = both.groupBy(*keys).agg(F.max_by(F.struct(F.col(t).alias("t"), "spot_open", "perp_open"), t).alias("_last"))
    names = lambda side: {"match_t": f"{side}_t", "spot_open": f"spot_{side}", "perp_open": f"perp_{side}"}
    x = first_after(signals.withColumn(t, F.col("entry_signal")), both, keys, cancel, ["spot_open", "perp_open"], t).withColumnsRenamed(names("entry"))
    x = x.withColumn(t, F.greatest("exit_signal", "entry_t"))
    x = first_after(x, both, keys, cancel, ["spot_open", "perp_open"], t).withColumnsRenamed(names("exit")).join(last, keys, "left")
    raw = capital * leverage / ((leverage + 1.0) * F.col("spot_entry"))
    x = x.withColumn("quantity", F.floor(raw / lot) * lot).withColumn("residual", raw - F.col("quantity"))
    reason = F.when(F.col("entry_t").isNull(), "no_entry_fill").when(F.col("quantity") <= 0, "rounds_to_zero").when(F.col("quantity") * F.col("perp_entry") < least, "below_least")
    kind = F.when(F.col("exit_t").isNotNull(), "signal").when(F.col("_last.t") > F.col("entry_t"), "last").otherwise("none")
    x = x.withColumns({"reason": reason, "exit_kind": F.when(reason.isNull(), kind)})
    of = lambda own, field: F.when(F.col("exit_kind") == "signal", F.col(own)).when(F.col("exit_kind") == "last", F.col(f"_last.{field}"))
    ends = {"exit_t": of("exit_t", "t"), "spot_exit": of("spot_exit", "spot_open"), "perp_exit": of("perp_exit", "perp_open")}
    opened = {c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("entry_t", "spot_entry", "perp_entry", "quantity", "residual")}
    return x.withColumns(ends).withColumns(opened).select(*keys, "id", "entry_signal", "exit_signal", "reason", *opened, "exit_kind", *ends)


def funding_cash(trades: DataFrame, settlements: DataFrame, keys: list[str], bucket: int = 86400) -> DataFrame:
    """Cash of each trade (id, entry_t, exit_t, quantity) from settlements (t, rate, mark) with entry_t < t <= exit_t, and how
    many there were; a short perpetual receives a positive rate."""
    paid = interval_join(trades.select(*keys, "id", "entry_t", "exit_t", "quantity"), settlements, keys, "entry_t", "exit_t", "t", bucket, closed="right")
    sums = paid.groupBy("id").agg(F.sum(F.col("quantity") * F.col("mark") * F.col("rate")).alias("funding"), F.count("*").alias("settlements"))
    return trades.join(sums, "id", "left").withColumns({"funding": F.coalesce("funding", F.lit(0.0)), "settlements": F.coalesce("settlements", F.lit(0))})


def trade_pnl(df: DataFrame, per_side: float) -> DataFrame:
    """Adds cost of four fills and pnl of long spot and short perpetual, by legs and by basis; both must agree."""
    q = F.col("quantity")
    legs = q * (F.col("spot_exit") - F.col("spot_entry")) - q * (F.col("perp_exit") - F.col("perp_entry"))
    basis = q * ((F.col("perp_entry") - F.col("spot_entry")) - (F.col("perp_exit") - F.col("spot_exit")))
    cost = per_side * q * (F.col("spot_entry") + F.col("spot_exit") + F.col("perp_entry") + F.col("perp_exit"))
    return df.withColumns({"cost": cost, "pnl": legs + F.col("funding") - cost, "identity_ok": F.abs(legs - basis) < 1e-6})


def margin_path(bars: DataFrame, trade: str, order: str, margin: float, maintenance: float) -> DataFrame:
    """Margin of each trade's short leg bar by bar: rows (trade, order, quantity, entry, mark_high, mark_close, cash). Cash of a
    bar is booked first; the trade is liquidated at the first bar whose high leaves less than the maintenance share of
    the position. Until then the margin is a running sum, so the first such bar decides by itself."""
    w = Window.partitionBy(trade).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    worst = margin + F.sum("cash").over(w) + F.col("quantity") * (F.col("entry") - F.col("mark_high"))
    x = bars.withColumn("_worst", worst)
    hit = F.min(F.when(F.col("_worst") < maintenance * F.col("quantity") * F.col("mark_high"), F.col(order))).over(Window.partitionBy(trade))
    x = x.withColumn("_hit", hit)
    state = F.when(F.col(order) == F.col("_hit"), "liquidated").when(F.col(order) > F.col("_hit"), "closed").otherwise("open")
    return x.withColumn("state", state).select(trade, order, F.when(F.col("state") != "closed", F.col("_worst")).alias("worst_margin"), "state")


def resolved_mark(rest: Column, bar_open: Column, status: Column) -> dict[str, Column]:
    """The mark of a settlement: the published one if it is a positive number, else the bar's open if its path is whole,
    else none; with source and reason."""
    number = rest.try_cast("double")
    valid, path = number > 0, status.isin("complete", "repaired") & (bar_open > 0)
    reason = F.when(rest.isNull() | (F.trim(rest) == ""), "absent").when(number.isNull(), "unparseable").when(number <= 0, "non_positive").otherwise("valid")
    return {
        "mark": F.when(valid, number).when(path, bar_open),
        "mark_source": F.when(valid, "published").when(path, "bar_open").otherwise("unavailable"),
        "mark_reason": reason,
    }


def ray_rate(word: Column) -> Column:
    """A yearly rate from a hex word of 64 digits in units of 1e-27, null unless it is whole; read as two halves of its last
    28 digits, which hold any rate below 5e6."""
    digits = F.right(word, F.lit(28))
    number = F.conv(F.substring(digits, 1, 14), 16, 10).cast("double") * float(16**14) + F.conv(F.right(word, F.lit(14)), 16, 10).cast("double")
    return F.when(F.lower(word).rlike("^(0x)?0{36}[0-9a-f]{28}$"), number / float(RAY))


def daily_rates(rows: DataFrame, assets: list[str]) -> DataFrame:
    """Per date the mean rate over all assets, or null with a reason: missing assets, bad words or repeated assets."""
    rated = rows.withColumn("rate", ray_rate(F.col("word")))
    x = rated.where(F.col("asset").isin(assets)).groupBy("date").agg(F.collect_set("asset").alias("_seen"), F.count("*").alias("_n"), F.count("rate").alias("_ok"), F.avg("rate").alias("_mean"))
    reason = F.when(F.size("_seen") < len(assets), "missing_asset").when(F.col("_n") > len(assets), "repeated_asset").when(F.col("_ok") < F.col("_n"), "bad_word")
    return x.select("date", F.when(reason.isNull(), F.col("_mean")).alias("mean_apr"), reason.alias("reason"))


def mark_timeline(slots: DataFrame, probes: DataFrame, keys: list[str], stale: Column, t: str = "t") -> DataFrame:
    """Every slot of a grid (with ``present``) and its status: observed, stale_unverified, or for a gap what the registry of
    probes (keys, times, verdict) says of its time, else route_unverified. No slot is left out."""
    known = probes.select(*keys, F.explode("times").alias(t), "verdict").groupBy(*keys, t).agg(F.min("verdict").alias("_verdict"))
    status = F.when(F.col("present"), F.when(stale, "stale_unverified").otherwise("observed")).otherwise(F.coalesce("_verdict", F.lit("route_unverified")))
    return slots.join(known, [*keys, t], "left").withColumn("status", status).drop("_verdict")


def disposition(path_ok: Column, liquidations: Column, fee_known: Column) -> Column:
    """The first gate that holds a layer back, in their fixed order, or null."""
    return F.when(~path_ok, "liquidation_state_unknown").when((liquidations > 0) & ~fee_known, "liquidation_model_blocked")


def layer_fidelity(resolved: DataFrame, layers: list[str]) -> DataFrame:
    """Events and exact ones of each layer with its class; layers without events are listed too."""
    every = resolved.sparkSession.createDataFrame([(x,) for x in layers], "layer string")
    found = resolved.groupBy("layer").agg(F.count("*").alias("events"), F.count_if(F.col("source") == "published").alias("exact"))
    kind = F.when(F.col("events") == 0, "unknown_until_observed").when(F.col("exact") == F.col("events"), "exact").otherwise("partial_proxy")
    out = every.join(found, "layer", "left").withColumns({"events": F.coalesce("events", F.lit(0)), "exact": F.coalesce("exact", F.lit(0))})
    return out.withColumn("class", kind)


def series_class(row_ok: Column, integrity_error: Column, generation: Column, block: Column, transport_error: Column) -> Column:
    """Why a day of a landed series holds what it does, in fixed order."""
    return F.when(row_ok, "complete").when(integrity_error, "integrity_error").when(generation.isNull(), "missing_by_protocol").when(block.isNull() | transport_error, "transport_failure").otherwise("missing_by_protocol")


def hex_words(data: Column) -> Column:
    """Words of 32 bytes of a hex answer, without 0x; a last part of a word is left out."""
    body = F.regexp_replace(data, "^0x", "")
    n = F.floor(F.length(body) / 64).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(body, k * 64 + 1, F.lit(64)))).otherwise(F.array().cast("array<string>"))


def word_number(word: Column) -> Column:
    """A word as a whole number, null above 2**60."""
    return F.when(F.substring(word, 1, 49) == "0" * 49, F.conv(F.substring(word, 50, 15), 16, 10).cast("long"))


def address_of(word: Column) -> Column:
    """The address in a word: its last 20 bytes, null if the others aren't zero."""
    return F.when(F.substring(word, 1, 24) == "0" * 24, F.concat(F.lit("0x"), F.lower(F.substring(word, 25, 40))))


def ray_word(rate: Column) -> Column:
    """The word that holds a yearly rate below 9e6 in units of 1e-27, exact to about 1e-15: what ray_rate() reads."""
    high = F.floor(rate * (float(RAY) / 16.0**14))
    return F.concat(F.lit("0" * 36), F.lpad(F.lower(F.hex(high.cast("long"))), 14, "0"), F.lit("0" * 14))


def topped_margin(bars: DataFrame, trade: str, order: str, margin: float, reserve: float, trigger: float, target: float, maintenance: float) -> DataFrame:
    """As margin_path(), with a reserve: when the margin's share of the position falls below ``trigger`` at a bar's high, it is filled
    up to ``target`` as far as the reserve goes; if it still is at or below ``maintenance``, the trade is liquidated. Each filling
    rests on those before it, so a trade's bars are folded in order, by an aggregate over its sorted bars (a trade is short)."""
    w = Window.partitionBy(trade).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    equity = margin + F.sum("cash").over(w) + F.col("quantity") * (F.col("entry") - F.col("mark_high"))
    x = bars.select(trade, F.struct(F.col(order).alias("at"), equity.alias("equity"), (F.col("quantity") * F.col("mark_high")).alias("notional")).alias("_b"))
    kind = dict(bars.dtypes)[order]
    empty = F.array().cast(f"array<struct<at:{kind},topped:double,ratio:double,state:string>>")
    start = F.struct(F.lit(0.0).alias("paid"), F.lit(False).alias("gone"), empty.alias("rows"))

    def step(acc, b):
        short = ~acc["gone"] & (b["equity"] + acc["paid"] < trigger * b["notional"])
        more = F.when(short, F.least(F.greatest(target * b["notional"] - b["equity"] - acc["paid"], F.lit(0.0)), reserve - acc["paid"])).otherwise(0.0)
        ratio = (b["equity"] + acc["paid"] + more) / b["notional"]
        hit = ~acc["gone"] & (ratio <= maintenance)
        row = F.struct(b["at"].alias("at"), more.alias("topped"), F.when(~acc["gone"], ratio).alias("ratio"), F.when(acc["gone"], "closed").when(hit, "liquidated").otherwise("open").alias("state"))
        return F.struct((acc["paid"] + more).alias("paid"), (acc["gone"] | hit).alias("gone"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    folded = x.groupBy(trade).agg(F.array_sort(F.collect_list("_b")).alias("_b")).select(trade, F.explode(F.aggregate("_b", start, step)["rows"]).alias("r"))
    return folded.select(trade, F.col("r.at").alias(order), "r.topped", "r.ratio", "r.state")
