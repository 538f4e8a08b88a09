"""Fitted folds and their controls: logistic fits by group, signals thinned run by run, entries at random, stationary
bootstraps. Draws are hashes of (seed, repetition, key), so results don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import ordered, prefix
from .statistics import uniform
from .store import stored


def logistic_fits(df: DataFrame, by: list[str], features: list[str], label: str, penalty: float, steps: int = 25, tolerance: float = 1e-8) -> DataFrame:
    """(by..., n, mean, deviation, weights) a group: a ridge logistic fit of a label of 0 or 1 on features standardised in the group
    (population deviation, 1 if it is 0); weights has the free constant first. Rows with a null in features or label are left out.

    Each Newton step is one aggregate of sums by group, combined before the shuffle; what a group's solve sees is one row,
    and the driver only the largest change. df is read once a step, so store it first."""
    ok = df.select(*by, *(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_y")).na.drop(subset=[*features, "_y"])
    p = len(features) + 1
    means = ok.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.avg(f) for f in features)).alias("mean"), F.array(*(F.stddev_pop(f) for f in features)).alias("deviation"))
    means = means.withColumn("deviation", F.transform("deviation", lambda s: F.when(s > 0, s).otherwise(1.0)))
    state = stored(means.withColumns({"weights": F.array_repeat(F.lit(0.0), p), "_step": F.lit(float("inf"))}))
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    @F.pandas_udf("array<double>")
    def change(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for n, w, g, h in batches:
            out = []
            for k in range(len(n)):
                hess, ridge = np.zeros((p, p)), np.diag([0.0] + [penalty] * (p - 1))
                for (i, j), s in zip(upper, h[k], strict=True):
                    hess[i, j] = hess[j, i] = s / n[k]
                out.append(np.linalg.solve(hess + ridge, np.asarray(g[k]) / n[k] + ridge @ w[k]))
            yield pd.Series(out)

    for _ in range(steps):
        x = ok.join(state, by)
        z = [F.lit(1.0), *((F.col(f) - F.get("mean", F.lit(k))) / F.get("deviation", F.lit(k)) for k, f in enumerate(features))]
        score = sum((z[k] * F.get("weights", F.lit(k)) for k in range(1, p)), F.get("weights", F.lit(0)))
        x = x.withColumn("_p", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), score)))))
        heavy = F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-9))
        sums = x.groupBy(*by).agg(F.array(*(F.sum(z[k] * (F.col("_p") - F.col("_y"))) for k in range(p))).alias("_g"), F.array(*(F.sum(heavy * z[i] * z[j]) for i, j in upper)).alias("_h"))
        moved = state.join(sums, by).withColumn("_d", change("n", "weights", "_g", "_h"))
        moved = moved.select(*by, "n", "mean", "deviation", F.zip_with("weights", "_d", lambda a, b: a - b).alias("weights"), F.array_max(F.transform("_d", F.abs)).alias("_step"))
        state = stored(moved)
        if (state.agg(F.max("_step")).first()[0] or 0.0) < tolerance:
            break
    return state.drop("_step")


def chance(features: list[str]) -> Column:
    """The chance of a 1 by a row joined with its group's logistic fit; null if a feature is."""
    terms = (F.get("weights", F.lit(k + 1)) * (F.col(f) - F.get("mean", F.lit(k))) / F.get("deviation", F.lit(k)) for k, f in enumerate(features))
    return 1 / (1 + F.exp(-sum(terms, F.get("weights", F.lit(0)))))


def exposure_matched(df: DataFrame, by: list[str], fold: list[str], side: str, kept: str, seed: int, t: str = "t", chunk: int = 30 * 86400) -> DataFrame:
    """Adds control: runs of one side that is not 0 stay whole with the chance at which the fold's signals of ``side`` survive in
    ``kept``, else they are 0; so a fold's control has about the exposure of ``kept``, in runs as long as the signal's own.
    A run is drawn by its series and first time. ``by`` names a series within a fold, t is unique in it; a null side is 0."""
    x = df.withColumn("_s", F.coalesce(side, F.lit(0)))
    x = ordered(x, by, {"_b": ("lag", "_s")}, t, chunk, dealt=True)
    x = prefix(x.withColumn("_start", F.when(F.col("_b").isNull() | (F.col("_b") != F.col("_s")), F.col(t))), by, {"_run": ("max", "_start")}, t, chunk)
    rate = df.groupBy(*fold).agg((F.count_if(F.col(kept) != 0) / F.nullif(F.count_if(F.col(side) != 0), F.lit(0))).alias("_rate"))
    stays = uniform(seed, *(F.col(k) for k in by), F.col("_run")) < F.coalesce("_rate", F.lit(0.0))
    return x.join(rate, fold).withColumn("control", F.when(stays, F.col("_s")).otherwise(0)).select(*df.columns, "control")


def placed(df: DataFrame, by: list[str], order: str, name: str, chunk: int = 30 * 86400) -> DataFrame:
    """Adds the place from 1 of each row of its group in the order of a unique number, in two phases."""
    return prefix(df.withColumn("_one", F.lit(1)), by, {name: ("count", "_one")}, order, chunk).drop("_one")


def stationary_bootstrap(df: DataFrame, order: str, value: str, repetitions: int, block: float, seed: int, chunk: int = 30 * 86400) -> DataFrame:
    """(rep, mean) of a value over as many rows as there are, drawn in blocks of geometric length (``block`` on average), each
    from a place of its own on, around the end. Rows are in order of a unique number; nulls are left out.

    There are rows times repetitions draws; they are numbered in chunks, and joined with the rows by place."""
    x = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("_k"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    x = stored(placed(x, ["_k"], "_o", "_i", chunk).select("_i", "_v"))
    n = x.agg(F.count("*").alias("_n"))
    drawn = x.select("_i", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"))
    fresh = (F.col("_i") == 1) | (uniform(seed, F.col("rep"), F.col("_i")) < 1.0 / block)
    drawn = prefix(drawn.withColumn("_new", F.when(fresh, F.col("_i"))), ["rep"], {"_b": ("max", "_new")}, "_i", 100_000).crossJoin(F.broadcast(n))  # one row
    start = F.floor(uniform(seed + 1, F.col("rep"), F.col("_b")) * F.col("_n"))
    at = F.pmod(start + F.col("_i") - F.col("_b"), F.col("_n")) + 1
    return drawn.select("rep", at.alias("_i")).join(x, "_i").groupBy("rep").agg(F.avg("_v").alias("mean"))


def random_entries(trades: DataFrame, slots: DataFrame, kind: str, repetitions: int, seed: int, t: str = "t", chunk: int = 30 * 86400) -> DataFrame:
    """(rep, n, mean): each trade (id, ``kind``, for instance how long it is held) gets the outcome of a slot (``kind``, unique time, outcome) of
    its kind drawn anew in each repetition, so counts by kind stay. Draws are independent; a kind without slots has no outcome."""
    s = placed(slots.where(F.col("outcome").isNotNull()).select(kind, t, "outcome"), [kind], t, "_i", chunk)
    sizes = s.groupBy(kind).agg(F.max("_i").alias("_n"))
    x = trades.select("id", kind, F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep")).join(sizes, kind)
    x = x.withColumn("_i", F.floor(uniform(seed, F.col("rep"), F.col("id")) * F.col("_n")) + 1)
    return x.join(s, [kind, "_i"]).groupBy("rep").agg(F.count("*").alias("n"), F.avg("outcome").alias("mean"))


def least_detectable(n: Column, deviation: Column) -> Column:
    """Smallest mean that a two-sided t test at 5 % tells from 0: the 97.5th percentile of t with n - 1 degrees, from the normal one by
    its expansion in 1 / (n - 1) (to 4 digits from 10 degrees on), times the standard error; null below 3 rows."""
    z, v = 1.959963984540054, n - 1
    t = F.lit(z) + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v * v * v)
    return F.when(n >= 3, t * deviation / F.sqrt(n.cast("double")))


def exceedance(observed: DataFrame, null: DataFrame, by: list[str], value: str, suffix: str) -> DataFrame:
    """Adds k, exceed, p and detectable (the null's 95th percentile) of each cell's draws; exceed counts those that reach the observed.
    A cell without draws has k 0 and p 1. Null draws are left out."""
    x = null.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_draw")).join(observed.select(*by, F.col(value).alias("_seen")), by)
    counts = x.groupBy(*by).agg(F.count("*").alias(f"k{suffix}"), F.count_if(F.col("_draw") >= F.col("_seen")).alias(f"exceed{suffix}"), F.expr("percentile_cont(0.95) within group (order by _draw)").alias(f"detectable{suffix}"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = observed.join(counts, by, "left").withColumns({c: zero(c) for c in (f"k{suffix}", f"exceed{suffix}")})
    return out.withColumn(f"p{suffix}", (1 + F.col(f"exceed{suffix}")) / (1 + F.col(f"k{suffix}")))


def two_stages(observed: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], by: list[str], value: str, most: int, done: DataFrame | None = None) -> DataFrame:
    """Each cell's placebo test with few draws, and for those with at most ``most`` draws at or above the observed, with all draws.
    ``first`` and ``second`` give the draws (by..., value) of the cells they get (by...), so nothing is drawn for cells that can't reach
    the floor. Only the rank promotes, never the size of the effect; p is the second stage's where there is one.

    Cells of ``done``, an earlier result of this function, are not tested again but returned as they are, so a run that died goes on."""
    todo = observed.where(F.col(value).isNotNull())
    todo = stored(todo if done is None else todo.join(done.select(*by), by, "left_anti"))
    one = stored(exceedance(todo, first(todo.select(*by)), by, value, "_1")).withColumn("candidate", (F.col("k_1") > 0) & (F.col("exceed_1") <= most))
    up = one.where("candidate").select(*by, value)
    two = exceedance(up, second(up.select(*by)), by, value, "_2").drop(value)
    out = one.join(two, by, "left").withColumns({"p": F.coalesce("p_2", "p_1"), "detectable": F.coalesce("detectable_2", "detectable_1")})
    names = [*by, value, *(f"{k}_{s}" for s in (1, 2) for k in ("k", "exceed", "p")), "candidate", "p", "detectable"]
    return out.select(*names) if done is None else out.select(*names).unionByName(done.select(*names))
