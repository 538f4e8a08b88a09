"""Permutation, placebo and bootstrap tests, corrections for many tests, and ridge fits from Gram sums.

Draws are hashes of (seed, repetition, key), so results don't depend on partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) drawn by the keys: 32 bits of an MD5, which other engines draw alike."""
    text = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long") / float(1 << 32)


def ranked(df: DataFrame, by: list[str], draw: Column, key: str, name: str, buckets: int = 64, value: str = "_u") -> DataFrame:
    """Adds the rank (from 1) of each row by its draw in [0, 1] and key: rows are ranked within buckets of the draw, and the counts
    of buckets before it are added, so no task sorts all rows. ``value``: what the draw stands for, to rank by within them."""
    x = df.withColumn("_u", draw).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    sizes = x.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(value, key))
    return x.withColumn("_r", inner).join(before, [*by, "_b"]).withColumn(name, F.col("_r") + F.col("_before")).drop("_u", "_b", "_r", "_before")


def value_ranks(df: DataFrame, by: list[str], value: str, key: str, name: str, buckets: int = 256) -> DataFrame:
    """Adds the rank (from 1) of each row by a number and key within its group, over buckets that a mergeable sketch of the group's
    quantiles bounds, so that they hold about as many rows each whatever the distribution; equal values share one. Rows
    without the number are left out."""
    v = F.col(value).cast("double")
    bounds = df.groupBy(*by).agg(F.percentile_approx(v, [k / buckets for k in range(1, buckets)], 10_000).alias("_bounds"))
    draw = F.size(F.filter("_bounds", lambda b: b < v)) / buckets
    return ranked(df.where(v.isNotNull()).join(bounds, by), by, draw, key, name, buckets, value).drop("_bounds")


def group_effects(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's mean against the rest, with Welch's t; one aggregate, the rest by subtraction."""
    x = F.col(value)
    sums = [F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")]
    each = df.groupBy(group).agg(*sums)
    total = each.agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "s", "q")))
    rest = each.crossJoin(F.broadcast(total))  # one row
    mean = lambda n, s: s / n
    var = lambda n, s, q: (q - s * s / n) / (n - 1)
    n, s, q = (F.col(c) for c in ("n", "s", "q"))
    rn, rs, rq = (F.col(f"all_{c}") - F.col(c) for c in ("n", "s", "q"))
    effect = mean(n, s) - mean(rn, rs)
    error = F.sqrt(var(n, s, q) / n + var(rn, rs, rq) / rn)
    ok = (n > 1) & (rn > 1)
    return rest.select(group, "n", F.when(ok, effect).alias("effect"), F.when(ok & (error > 0), effect / error).alias("welch_t"))


def permutation_null(df: DataFrame, group: str, value: str, key: str, repetitions: int, seed: int) -> DataFrame:
    """(rep, largest): the largest absolute group mean less the total mean, groups dealt anew in each repetition: rows
    in order of their draw take the group of the row of that rank."""
    numbered = ranked(df.select(group, value, key), [], uniform(seed, F.lit(0), F.col(key)), key, "i")
    reps = df.select(F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"), value, key)
    drawn = ranked(reps, ["rep"], uniform(seed, F.col("rep"), F.col(key)), key, "i")
    dealt = drawn.join(numbered.select("i", group), "i")
    total = df.agg(F.avg(value).alias("m"))
    means = dealt.groupBy("rep", group).agg(F.avg(value).alias("_mean")).crossJoin(F.broadcast(total))  # one row
    return means.groupBy("rep").agg(F.max(F.abs(F.col("_mean") - F.col("m"))).alias("largest"))


def empirical_p(null: DataFrame, statistic: str, observed: float) -> DataFrame:
    """(1 + how many reach the observed) / (1 + all), and the null's 95th percentile."""
    return null.agg(((1 + F.count_if(F.col(statistic) >= observed)) / (1 + F.count("*"))).alias("p"), F.expr(f"percentile_cont(0.95) within group (order by {statistic})").alias("detectable"))


def cluster_bootstrap(clusters: DataFrame, key: str, repetitions: int, seed: int) -> DataFrame:
    """(rep, ratio): sum(num) / sum(den) over clusters drawn with replacement; clusters: (key, num, den), one row each.
    Each repetition's Poisson(1) weight of a cluster comes from its draw."""
    u = uniform(seed, F.col("rep"), F.col(key))
    weight, mass, term = F.lit(0), 0.0, np.exp(-1.0)
    for k in range(1, 9):
        mass += term
        weight = weight + (u >= mass).cast("int")
        term /= k
    reps = clusters.select(F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"), key, "num", "den").withColumn("w", weight)
    return reps.groupBy("rep").agg(F.when(F.sum(F.col("w") * F.col("den")) > 0, F.sum(F.col("w") * F.col("num")) / F.sum(F.col("w") * F.col("den"))).alias("ratio"))


def sign_flip_p(clusters: DataFrame, key: str, value: str, repetitions: int, seed: int) -> DataFrame:
    """Share of repetitions, signs of clusters drawn, whose absolute sum reaches the observed one."""
    sign = F.when(uniform(seed, F.col("rep"), F.col(key)) < 0.5, -1).otherwise(1)
    reps = clusters.select(F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"), key, value)
    sums = reps.groupBy("rep").agg(F.abs(F.sum(sign * F.col(value))).alias("s"))
    seen = clusters.agg(F.abs(F.sum(value)).alias("o"))
    return sums.crossJoin(F.broadcast(seen)).agg(((1 + F.count_if(F.col("s") >= F.col("o"))) / (1 + F.count("*"))).alias("p"))  # one row


def without_most_influential(clusters: DataFrame, key: str, value: str) -> DataFrame:
    """The clusters (a row each) but the one whose value is the largest in size; of equal ones the first goes."""
    top = clusters.where(F.col(value).isNotNull()).orderBy(F.desc(F.abs(value)), key).limit(1)
    return clusters.join(F.broadcast(top.select(key)), key, "left_anti")  # one row


def adjusted(tests: DataFrame, p: str = "p", name: str = "test") -> DataFrame:
    """Holm's and Benjamini-Hochberg's adjusted p of a family of tests (a short table); a missing p counts as 1."""
    x = tests.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    w = Window.partitionBy().orderBy("_p", name)
    x = x.withColumns({"_r": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy())})
    holm = F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * F.col("_p")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bh = F.least(F.lit(1.0), F.min(F.col("_m") * F.col("_p") / F.col("_r")).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return x.withColumns({"holm": holm, "bh": bh}).drop("_p", "_r", "_m")


def gram(df: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """Sums of products by fold: (by..., n, i, j, s) for features, target and the constant, i <= j. Plain sums, so partial
    results combine before the shuffle."""
    names = ["1", *features, target]
    columns = [F.lit(1.0), *(F.col(c) for c in [*features, target])]
    sums = [F.sum(columns[i] * columns[j]).alias(f"{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    return df.na.drop(subset=[*features, target]).groupBy(*by).agg(*sums)


def ridge(sums: DataFrame, by: str, features: list[str], penalty: float) -> DataFrame:
    """For each fold, weights learned from all other folds' sums, and the out-of-sample squared errors that follow from
    its own sums. The table has a row a fold."""
    p = len(features) + 1
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]

    def matrix(row) -> np.ndarray:
        m = np.zeros((p + 1, p + 1))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"{i}_{j}"]
        return m

    total = sums.agg(*(F.sum(f"{i}_{j}").alias(f"all_{i}_{j}") for i, j in pairs))

    def solve(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                own = matrix(row)
                train = matrix({f"{i}_{j}": row[f"all_{i}_{j}"] for i, j in pairs}) - own
                eye = np.eye(p) * penalty
                eye[0, 0] = 0
                w = np.linalg.solve(train[:p, :p] + eye, train[:p, p])
                mean = train[0, p] / train[0, 0]
                sse = own[p, p] - 2 * w @ own[:p, p] + w @ own[:p, :p] @ w
                sst = own[p, p] - 2 * mean * own[0, p] + mean * mean * own[0, 0]
                out.append((row[by], int(own[0, 0]), w.tolist(), float(sse), float(sst)))
            yield pd.DataFrame(out, columns=[by, "n", "weights", "sse", "sst"])

    kind = dict(sums.dtypes)[by]
    return sums.crossJoin(F.broadcast(total)).mapInPandas(solve, f"{by} {kind}, n long, weights array<double>, sse double, sst double")  # one row


def in_folds(df: DataFrame, folds: DataFrame, embargo: int = 0, t: str = "t") -> DataFrame:
    """Rows of each fold's training window [train_start, train_end - embargo); folds: a short list given by the caller."""
    inside = (F.col(t) >= F.col("train_start")) & (F.col(t) < F.col("train_end") - embargo)
    return df.join(F.broadcast(folds), inside)


def conditions_outcome(df: DataFrame, conditions: dict[str, tuple[Column, Column]], outcome: str, keys: list[str], overlap: int, apart: int, t: str = "t") -> DataFrame:
    """Each condition (name -> (mask, side)) evaluated over one pass: n, episodes (new after ``apart`` seconds without a hit),
    effect (mean of side times the outcome less its mean over all rows), t by the effective number of hits, and in how many thirds of
    the time the effect is positive. A condition that holds in a whole third has no effect there: what is left of its mean is rounding, which
    depends on the order of rows, and doesn't count. Rows without an outcome are left out; a null mask is false."""
    valid = df.where(F.col(outcome).isNotNull())
    span = valid.agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.avg(outcome).alias("mean"))
    third = F.least(F.lit(2), F.floor((F.col(t) - F.col("lo")) * 3 / (F.col("hi") - F.col("lo") + 1))).cast("int")
    x = valid.crossJoin(F.broadcast(span)).withColumn("third", third)  # one row
    means = x.groupBy("third").agg(F.avg(outcome).alias("third_mean"))
    x = x.join(F.broadcast(means), "third")  # three rows
    hits = F.filter(F.array(*(F.when(mask, F.struct(F.lit(k).alias("name"), side.cast("double").alias("side"))) for k, (mask, side) in conditions.items())), lambda h: h.isNotNull())
    x = x.select(*keys, t, "third", F.explode(hits).alias("h"), (F.col(outcome) - F.col("mean")).alias("y"), (F.col(outcome) - F.col("third_mean")).alias("y3"))
    x = x.select(*keys, t, "third", F.col("h.name").alias("name"), (F.col("h.side") * F.col("y")).alias("o"), (F.col("h.side") * F.col("y3")).alias("o3"))
    gap = F.col(t) - F.lag(t).over(Window.partitionBy("name", *keys).orderBy(t))
    x = x.withColumn("fresh", F.coalesce(gap >= apart, F.lit(True)).cast("int"))
    parts = x.groupBy("name", "third").agg(F.count("*").alias("n"), F.sum("o").alias("s"), F.sum(F.col("o") * F.col("o")).alias("q"), F.avg("o3").alias("m"), F.avg(F.abs("o3")).alias("size"), F.sum("fresh").alias("episodes"))
    out = parts.groupBy("name").agg(F.sum("n").alias("n"), F.sum("episodes").alias("episodes"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count_if(F.col("m") > F.col("size") * 1e-10).alias("positive_thirds"))
    mean, variance = F.col("s") / F.col("n"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    enough = F.least(F.col("n") / overlap, F.col("episodes"))
    return out.select("name", "n", "episodes", mean.alias("effect"), F.when((F.col("n") > 1) & (variance > 1e-18), mean / F.sqrt(variance) * F.sqrt(enough)).alias("t"), "positive_thirds")


def block_bootstrap(clusters: DataFrame, order: str, num: str, den: str, repetitions: int, block: int, seed: int) -> DataFrame:
    """(rep, ratio): sum(num) / sum(den) over circular blocks of ``block`` clusters in order, as many as cover them all; with a
    block of one it is the plain cluster bootstrap. Clusters are few (weeks, days) and numbered in one window."""
    x = clusters.select((F.row_number().over(Window.partitionBy().orderBy(order)) - 1).alias("i"), num, den, F.count("*").over(Window.partitionBy()).alias("size"))
    size = x.agg(F.max("size").alias("size"))
    reps = size.select("size", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep")).withColumn("j", F.explode(F.sequence(F.lit(1), F.ceil(F.col("size") / block).cast("int"))))
    start = F.floor(uniform(seed, F.col("rep"), F.col("j")) * F.col("size"))
    drawn = reps.withColumn("i", F.explode(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: F.pmod(start + k, F.col("size")).cast("int")))).drop("size")
    return drawn.join(F.broadcast(x.drop("size")), "i").groupBy("rep").agg((F.sum(num) / F.sum(den)).alias("ratio"))  # clusters are few


def residual(df: DataFrame, by: list[str], x: str, y: str, train: Column) -> DataFrame:
    """Adds residual: y less its projection on x and a constant, fitted by group on the training rows alone."""
    a, b = (F.when(train & F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y))
    fit = df.groupBy(*by).agg(F.regr_slope(b, a).alias("_slope"), F.regr_intercept(b, a).alias("_base"))
    return df.join(fit, by).withColumn("residual", F.col(y) - F.col("_slope") * F.col(x) - F.col("_base")).drop("_slope", "_base")


def day_shift_placebo(df: DataFrame, by: list[str], x: str, y: str, days: int, shifts: list[int], t: str = "t") -> DataFrame:
    """(by, shift, corr): correlation of y with x taken whole days earlier, around the circle of ``days`` days; shift 0 is the
    real one. Shifts are exploded on one side, so one join serves them all."""
    day, second = F.floor(F.col(t) / 86400), F.pmod(F.col(t), F.lit(86400))
    left = df.select(*by, F.pmod(day, F.lit(days)).alias("_day"), second.alias("_s"), F.col(y).alias("_y"))
    right = df.select(*by, F.pmod(day, F.lit(days)).alias("_d"), second.alias("_s"), F.col(x).alias("_x")).withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("_day", F.pmod(F.col("_d") + F.col("shift"), F.lit(days)))
    return left.join(right, [*by, "_day", "_s"]).groupBy(*by, "shift").agg(F.corr("_y", "_x").alias("corr"), F.count("*").alias("n"))


def standardised_on(df: DataFrame, by: list[str], columns: list[str], train: Column, bound: float = 10.0) -> DataFrame:
    """The columns less the training rows' mean over their population deviation, clipped; raises ValueError where a deviation is
    zero or missing."""
    stats = df.where(train).groupBy(*by).agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    bad = stats.where(" or ".join(f"coalesce(_s_{c}, 0) <= 0" for c in columns))
    if not bad.isEmpty():
        raise ValueError("a training column does not vary")
    z = {c: F.greatest(F.lit(-bound), F.least(F.lit(bound), (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))) for c in columns}
    return df.join(stats, by).withColumns(z).select(*df.columns)


def stability(effects: DataFrame, by: list[str], effect: str, part: str) -> DataFrame:
    """Whether a test's effect keeps its sign over parts of the data: n parts, share with the whole's sign, and a flag."""
    whole = effects.groupBy(*by).agg(F.sum(effect).alias("_all"), F.count(part).alias("parts"), F.count_if(F.col(effect) > 0).alias("_up"), F.count_if(F.col(effect) < 0).alias("_down"))
    same = F.when(F.col("_all") >= 0, F.col("_up")).otherwise(F.col("_down")) / F.col("parts")
    return whole.select(*by, "parts", same.alias("share"), (same >= 0.75).alias("stable"))


def batch_status(df: DataFrame, rules: list[str], outcome: str, least: int) -> DataFrame:
    """Each rule's mean of side times outcome in research and validation rows (column split), its research hits, and a status in
    fixed order: too_few, rejected, not_confirmed or survivor. Every rule has a row."""
    sides = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("side")) for k in rules))
    x = df.select("split", outcome, F.explode(sides).alias("s")).select("split", outcome, "s.*")
    e = F.when(F.col("side") != 0, F.col("side") * F.col(outcome))
    part = lambda k: F.when(F.col("split") == k, e)
    out = x.groupBy("rule").agg(F.count(part("research")).alias("n"), F.avg(part("research")).alias("research"), F.avg(part("validation")).alias("validation"))
    status = F.when(F.col("n") < least, "too_few").when(F.coalesce(F.col("research") <= 0, F.lit(True)), "rejected").when(F.coalesce(F.col("validation") <= 0, F.lit(True)), "not_confirmed").otherwise("survivor")
    return out.withColumn("status", status)
