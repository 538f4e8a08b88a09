"""Nested ridge fits A against A + X over folds of time, with the penalty of each chosen by an inner purged
cross-validation, and placebos of X that are shifted by whole days.

Only sums of products leave a task. Rows travel as blocks of a day (a matrix each); a block adds its products to each fold
and segment that it has rows in, and a fit needs a few small matrices a fold: prefixes of the training rows are sums of
segments, A is the upper-left block of A + X, and errors follow from the validation rows' own sums. A shifted X meets its
rows by one join of blocks, and only its own products are made: those of A alone are taken from the observed fit.

Folds are a short list given by the caller: (fold, train_start, train_end, test_start, test_end). A training row has
train_start <= t < train_end - embargo. Within them, bounds at quarters of the rows part four blocks; the last three
validate what is learned from the rows before them less ``purge`` rows. A split counts if more than ``least`` rows are on
both sides; without one the middle penalty is taken. Rows with a null in a, x or y are left out before rows are counted;
a placebo's rows without a source are left out of its fits of both A and A + X, and rows keep their segment.
A column that doesn't vary over a fold's training rows raises ValueError in the observed fit; a placebo's fit is left out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import prefix
from .store import stored

PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0)
CLIP, DAY = 10.0, 86400
#: Segments of a fold's rows in order of training: up to each split's last row, its gap, and so on; then the test rows.
TEST = 7


def complete_rows(df: DataFrame, by: list[str], columns: list[str], folds: Sequence[tuple], embargo: int, t: str = "t") -> DataFrame:
    """Rows without a null, with ``pos``, their number within the series from 0, and per fold the first training row's
    number and how many there are: arrays ``first`` and ``many``."""
    x = df.select(*by, t, *columns).na.drop().withColumns({c: F.col(c).cast("double") for c in columns})
    x = stored(prefix(x.withColumn("_one", F.lit(1)), by, {"pos": ("count", "_one")}, t).drop("_one").withColumn("pos", F.col("pos") - 1))
    inside = [(F.col(t) >= start) & (F.col(t) < end - embargo) for _, start, end, _, _ in folds]
    counts = x.groupBy(*by).agg(F.array(*(F.min(F.when(c, F.col("pos"))) for c in inside)).alias("first"), F.array(*(F.count_if(c) for c in inside)).alias("many"), F.min(F.floor(F.col(t) / DAY)).alias("day0"), (F.max(F.floor(F.col(t) / DAY)) - F.min(F.floor(F.col(t) / DAY)) + 1).alias("days"))
    return x.join(counts, by)


def day_blocks(rows: DataFrame, by: list[str], columns: list[str], t: str = "t") -> DataFrame:
    """One row a series and day: the day's times, numbers and columns, row after row."""
    day = F.floor(F.col(t) / DAY).alias("day")
    each = F.struct(F.col(t).alias("t"), F.col("pos").alias("pos"), F.array(*columns).alias("m"))
    x = rows.groupBy(*by, day, "day0", "days", "first", "many").agg(F.array_sort(F.collect_list(each)).alias("r"))
    return x.select(*by, "day", "day0", "days", "first", "many", F.col("r.t").alias("ts"), F.col("r.pos").alias("pos"), F.flatten("r.m").alias("m"))


def segments(pos: np.ndarray, first: int | None, many: int, purge: int, least: int) -> tuple[np.ndarray, list[int]]:
    """The segment of each training row, and the splits that count. Segment 2k - 1 is the gap before
    split k's block, 2k what follows up to the next gap. A gap that is wider than the block before it rules its split out."""
    bounds = [many * q // 4 for q in range(5)]
    edges = [max(bounds[k] - purge, 1) for k in (1, 2, 3)]
    splits = [k for k in (1, 2, 3) if edges[k - 1] > least and bounds[k + 1] - bounds[k] > least and edges[k - 1] >= bounds[k - 1]]
    cuts = [c for k in (1, 2, 3) for c in (max(edges[k - 1], bounds[k - 1]), bounds[k])]
    return np.searchsorted(cuts, pos - (first or 0), "right"), splits


class _Fold:
    def __init__(self, fold, start, end, test_start, test_end, embargo):
        self.fold, self.start, self.end, self.test_start, self.test_end = fold, start, end - embargo, test_start, test_end

    def masks(self, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (ts >= self.start) & (ts < self.end), (ts >= self.test_start) & (ts < self.test_end)


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Of each block: its place in the batch, times, numbers, matrix, and the source block's times and matrix."""
    unpack = lambda name, i: np.asarray(batch.column(name)[i].values.to_numpy(zero_copy_only=False))
    for i in range(len(batch)):
        source = "s_m" in batch.schema.names and batch.column("s_m")[i].is_valid
        yield i, unpack("ts", i), unpack("pos", i), unpack("m", i).reshape(-1, width), unpack("s_ts", i) if source else None, unpack("s_m", i).reshape(-1, width) if source else None


def _moved(x: np.ndarray, a: np.ndarray, ts: np.ndarray, s_ts: np.ndarray | None, s_a: np.ndarray | None, s_x: np.ndarray | None, gamma: np.ndarray | None) -> np.ndarray:
    """X of the source row at the same time of day, NaN without one; with gamma only what A doesn't explain is moved."""
    out = np.full_like(x, np.nan)
    if s_ts is None or not len(s_ts):
        return out
    at = np.minimum(np.searchsorted(s_ts % DAY, ts % DAY), len(s_ts) - 1)
    same = s_ts[at] % DAY == ts % DAY
    moved = s_x[at[same]]
    out[same] = moved if gamma is None else a[same] @ gamma + moved - s_a[at[same]] @ gamma
    return out


class NestedRidge:
    """The fit's parameters; ``fit`` gives results by series, variant, fold and part of the test rows."""

    def __init__(self, by: list[str], a: list[str], x: list[str], y: str, folds: Sequence[tuple], embargo: int = 0, purge: int = 0, least: int = 50, penalties: Sequence[float] = PENALTIES, part: int = 366 * DAY, t: str = "t"):
        self.by, self.a, self.x, self.y, self.t, self.part = by, a, x, y, t, part
        self.raw, self.folds = list(folds), [_Fold(*f, embargo) for f in folds]
        self.embargo, self.purge, self.least, self.penalties = embargo, purge, least, list(penalties)
        self.columns = [*a, *x, y]

    def blocks(self, df: DataFrame) -> DataFrame:
        return stored(day_blocks(complete_rows(df, self.by, self.columns, self.raw, self.embargo, self.t), self.by, self.columns, self.t))

    def _variants(self, blocks: DataFrame, shifts: Sequence[int], projected: bool, gammas: DataFrame | None) -> DataFrame:
        """Blocks with ``variant`` (the shift in days) and their source blocks; 0 has none. Shifts go round the series' days."""
        own = blocks.withColumn("variant", F.explode(F.array(*(F.lit(s) for s in [0, *shifts]))))
        source = blocks.select(*self.by, F.col("day").alias("from_day"), F.col("ts").alias("s_ts"), F.col("m").alias("s_m"))
        own = own.withColumn("from_day", F.when(F.col("variant") != 0, F.pmod(F.col("day") - F.col("day0") - F.col("variant"), F.col("days")) + F.col("day0")))
        own = own.join(source, [*self.by, "from_day"], "left").drop("from_day")
        return own.join(gammas, self.by, "left") if projected else own.withColumn("gamma", F.lit(None).cast("array<double>"))

    def _gamma(self, values, i: int, fold: int) -> np.ndarray | None:
        if values is None or not values[i].is_valid:
            return None
        size = len(self.a) * len(self.x)
        return np.asarray(values[i].values)[fold * size : (fold + 1) * size].reshape(len(self.a), len(self.x))

    def _sums(self, df: DataFrame, make, width: int) -> DataFrame:
        """Adds up what make() gives for each row of blocks: (variant, fold, segment, part) -> {place: number}."""
        key_types = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in self.by)

        def run(batches):
            for batch in batches:
                where, keys, values = [], [], []
                held: dict[tuple, np.ndarray] = {}
                series = list(zip(*(batch.column(c).to_pylist() for c in self.by), strict=True)) if self.by else [()] * len(batch)
                variants = batch.column("variant").to_pylist()
                for i, *arrays in _matrices(batch, len(self.columns)):
                    for key, sums in make(batch, i, *arrays):
                        full = (series[i], variants[i], *key)
                        held[full] = held[full] + sums if full in held else sums
                for (name, *key), sums in held.items():
                    where.append(name)
                    keys.append(key)
                    values.append(sums)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([w[k] for w in where], batch.schema.field(c).type) for k, c in enumerate(self.by)), *(pa.array([k[j] for k in keys], pa.int64()) for j in range(4)), pa.array(values, pa.list_(pa.float64()))],
                    names=[*self.by, "variant", "fold", "segment", "part", "sums"],
                )

        partial = df.mapInArrow(run, ", ".join(filter(None, [key_types, "variant long, fold long, segment long, part long, sums array<double>"])))
        keys = [*self.by, "variant", "fold", "segment", "part"]
        return partial.groupBy(*keys).agg(F.array(*(F.sum(F.get("sums", k)) for k in range(width))).alias("sums"))

    def _moments(self, variants: DataFrame) -> DataFrame:
        """(by, variant, moments): for all folds in a row, the number of training rows with a source, and means and
        deviations of [A, X, y] over them."""
        p, pa_ = len(self.columns), len(self.a)

        def make(batch, i, ts, pos, m, s_ts, s_m):
            for k, fold in enumerate(self.folds):
                train, _ = fold.masks(ts)
                if train.any():
                    z = self._variant(m, ts, s_ts, s_m, batch, i, k)[train]
                    z = z[~np.isnan(z[:, pa_:-1]).any(axis=1)]
                    yield (k, 0, 0), np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])

        sums = self._sums(variants, make, 1 + 2 * p)
        n = F.get("sums", 0)
        mean = [F.get("sums", 1 + j) / n for j in range(p)]
        spread = [F.sqrt(F.greatest(F.get("sums", 1 + p + j) / n - m * m, F.lit(0.0))) for j, m in enumerate(mean)]
        each = F.struct(F.col("fold"), F.array(n, *mean, *spread).alias("s"))
        empty = F.array_repeat(F.lit(None).cast("double"), 1 + 2 * p)
        by_fold = F.map_from_entries(F.collect_list(each))
        return sums.where(n > 0).groupBy(*self.by, "variant").agg(by_fold.alias("f")).select(*self.by, "variant", F.flatten(F.array(*(F.coalesce(F.element_at("f", F.lit(k).cast("long")), empty) for k in range(len(self.folds))))).alias("moments"))

    def _variant(self, m, ts, s_ts, s_m, batch, i, k) -> np.ndarray:
        """[A, X, y] of a block's rows with X as the variant has it."""
        if batch.column("variant")[i].as_py() == 0:
            return m
        pa_, out = len(self.a), m.copy()
        s_a, s_x = (None, None) if s_m is None else (s_m[:, :pa_], s_m[:, pa_:-1])
        out[:, pa_:-1] = _moved(m[:, pa_:-1], m[:, :pa_], ts, s_ts, s_a, s_x, self._gamma(batch.column("gamma"), i, k))
        return out

    def _products(self, variants: DataFrame, moments: DataFrame) -> DataFrame:
        """Sums of z z' (z: standardised and clipped [A, X], and y less its mean) and the number of rows, by fold, segment
        and part. A variant that lost no training row leaves out A with A and A with y there, which the observed one has."""
        p, pa_ = len(self.columns), len(self.a)
        observed = moments.where("variant = 0").select(*self.by, F.col("moments").alias("seen"))
        joined = variants.join(moments, [*self.by, "variant"]).join(observed, self.by)

        def make(batch, i, ts, pos, m, s_ts, s_m):
            stats = np.asarray(batch.column("moments")[i].values.to_numpy(zero_copy_only=False)).reshape(len(self.folds), -1)
            seen = np.asarray(batch.column("seen")[i].values.to_numpy(zero_copy_only=False)).reshape(len(self.folds), -1)
            firsts, many = batch.column("first")[i].as_py(), batch.column("many")[i].as_py()
            for k, fold in enumerate(self.folds):
                train, test = fold.masks(ts)
                n, mean, spread = stats[k, 0], stats[k, 1 : 1 + p], stats[k, 1 + p :].copy()
                if not (train.any() or test.any()) or np.isnan(n) or (spread[:-1] <= 0).any():
                    continue
                z = self._variant(m, ts, s_ts, s_m, batch, i, k)
                ok = ~np.isnan(z[:, pa_:-1]).any(axis=1)
                spread[-1] = 1.0
                z = (z - mean) / spread
                z[:, :-1] = np.clip(z[:, :-1], -CLIP, CLIP)
                segment = np.where(train, segments(pos, firsts[k], many[k], self.purge, self.least)[0], TEST)
                part = np.where(train, 0, ts // self.part)
                every = batch.column("variant")[i].as_py() == 0 or n != seen[k, 0]
                rows = np.flatnonzero((train | test) & ok)
                for s, q in set(zip(segment[rows].tolist(), part[rows].tolist(), strict=True)):
                    some = z[rows[(segment[rows] == s) & (part[rows] == q)]]
                    whole = every or s == TEST
                    g = some.T @ some if whole else np.zeros((p, p))
                    if not whole:
                        g[pa_:-1] = some[:, pa_:-1].T @ some
                        g[:, pa_:-1] = g[pa_:-1].T
                    yield (k, s, q), np.concatenate([[len(some), float(whole)], g.reshape(-1)])

        return self._sums(joined, make, 2 + p * p)

    def fit(self, df: DataFrame, shifts: Sequence[int] = (), projected: bool = False) -> DataFrame:
        """by..., variant (0: observed, else the shift in days), fold, part (test time over the parts' length), n, sse_a, sse_b,
        sst, penalty_a, penalty_b, beta_a, beta_b, and mean: predictions are mean + z beta."""
        blocks = self.blocks(df)
        variants = self._variants(blocks, shifts, projected, self.projections(blocks) if projected else None)
        moments = stored(self._moments(variants))
        p = len(self.columns)
        bad = moments.where("variant = 0").where(" or ".join(f"moments[{k * (1 + 2 * p) + 1 + p + j}] <= 0" for k in range(len(self.folds)) for j in range(p - 1)))
        if not bad.isEmpty():
            raise ValueError("a training column does not vary")
        products = stored(self._products(variants, moments))
        keys = [*self.by, "fold", "segment", "part"]
        seen = products.where("variant = 0").select(*keys, F.col("sums").alias("seen"))
        counts = blocks.select(*self.by, "many").distinct()
        means = moments.select(*self.by, "variant", "moments")
        joined = products.join(seen, keys).join(counts, self.by).join(means, [*self.by, "variant"])
        kinds = dict(joined.dtypes)
        schema = ", ".join([*(f"{c} {kinds[c]}" for c in self.by), "variant long, fold string, part long, n long, sse_a double, sse_b double, sst double, penalty_a double, penalty_b double, beta_a array<double>, beta_b array<double>, mean double"])
        return joined.groupBy(*self.by, "variant", "fold").applyInPandas(lambda pdf: self._solve(pdf), schema)

    def _solve(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """The fits of one variant and fold from its segments' sums."""
        p, pa_ = len(self.columns), len(self.a)
        k, many = int(pdf["fold"].iloc[0]), list(pdf["many"].iloc[0])
        own = np.ix_([*range(pa_), p - 1], [*range(pa_), p - 1])
        train, tests = np.zeros((TEST, p, p)), []
        for row in pdf.itertuples():
            sums, seen = np.asarray(row.sums), np.asarray(row.seen)
            g = sums[2:].reshape(p, p).copy()
            if not sums[1]:
                g[own] = seen[2:].reshape(p, p)[own]
            if row.segment == TEST:
                tests.append((int(row.part), int(sums[0]), g))
            else:
                train[int(row.segment)] += g
        _, splits = segments(np.zeros(0), 0, many[k], self.purge, self.least)

        def fitted(width: int) -> tuple[np.ndarray, float]:
            cut = np.array([*range(width)])
            solve = lambda g, penalty: np.linalg.solve(g[np.ix_(cut, cut)] + penalty * np.eye(width), g[cut, -1])
            errors = np.zeros(len(self.penalties))
            for s in splits:
                before, valid = train[: 2 * s - 1].sum(axis=0), train[2 * s : 2 * s + 2].sum(axis=0)
                for j, penalty in enumerate(self.penalties):
                    errors[j] += _error(valid, cut, solve(before, penalty))
            best = self.penalties[int(np.argmin(errors))] if splits else self.penalties[len(self.penalties) // 2]
            return solve(train.sum(axis=0), best), best

        (beta_a, alpha_a), (beta_b, alpha_b) = fitted(pa_), fitted(p - 1)
        mean = list(pdf["moments"].iloc[0])[k * (1 + 2 * p) + p]
        head = {c: pdf[c].iloc[0] for c in [*self.by, "variant"]}
        rows = [head | {"fold": str(self.folds[k].fold), "part": q, "n": n, "sse_a": _error(g, np.arange(pa_), beta_a), "sse_b": _error(g, np.arange(p - 1), beta_b), "sst": g[-1, -1], "penalty_a": alpha_a, "penalty_b": alpha_b, "beta_a": beta_a.tolist(), "beta_b": beta_b.tolist(), "mean": mean} for q, n, g in sorted(tests, key=lambda x: x[0])]
        return pd.DataFrame(rows, columns=[*self.by, "variant", "fold", "part", "n", "sse_a", "sse_b", "sst", "penalty_a", "penalty_b", "beta_a", "beta_b", "mean"])

    def projections(self, blocks: DataFrame) -> DataFrame:
        """(by, gamma): for all folds in a row, the least-squares weights of each X on A over the training rows, without a constant."""
        p, pa_ = len(self.columns), len(self.a)

        def make(batch, i, ts, pos, m, s_ts, s_m):
            for k, fold in enumerate(self.folds):
                train, _ = fold.masks(ts)
                if train.any():
                    z = m[train][:, :-1]
                    yield (k, 0, 0), (z[:, :pa_].T @ z).reshape(-1)

        sums = self._sums(blocks.withColumn("variant", F.lit(0)), make, pa_ * (p - 1))
        kinds = dict(sums.dtypes)

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            gamma = np.full((len(self.folds), pa_, p - 1 - pa_), np.nan)
            for row in pdf.itertuples():
                g = np.asarray(row.sums).reshape(pa_, p - 1)
                gamma[int(row.fold)] = np.linalg.lstsq(g[:, :pa_], g[:, pa_:], rcond=None)[0]
            return pd.DataFrame([{c: pdf[c].iloc[0] for c in self.by} | {"gamma": gamma.reshape(-1).tolist()}], columns=[*self.by, "gamma"])

        schema = ", ".join([*(f"{c} {kinds[c]}" for c in self.by), "gamma array<double>"])
        return stored((sums.groupBy(*self.by) if self.by else sums.groupBy()).applyInPandas(solve, schema))

    def residuals(self, df: DataFrame) -> DataFrame:
        """(by, fold, t, fitted, residual) of each row: X as A explains it with each fold's weights, and the rest; arrays over X."""
        rows = stored(complete_rows(df, self.by, self.columns, self.raw, self.embargo, self.t))
        gamma = self.projections(stored(day_blocks(rows, self.by, self.columns, self.t)))
        size = len(self.a) * len(self.x)
        folds = F.explode(F.array(*(F.struct(F.lit(str(f.fold)).alias("fold"), F.lit(k * size).alias("at")) for k, f in enumerate(self.folds))))
        x = rows.join(gamma, self.by).select("*", folds.alias("f"))
        fitted = [sum((F.col(a) * F.get("gamma", F.col("f.at") + i * len(self.x) + j) for i, a in enumerate(self.a)), F.lit(0.0)) for j in range(len(self.x))]
        return x.select(*self.by, "f.fold", self.t, F.array(*fitted).alias("fitted"), F.array(*(F.col(c) - v for c, v in zip(self.x, fitted, strict=True))).alias("residual"))


def _error(g: np.ndarray, cut: np.ndarray, beta: np.ndarray) -> float:
    """The squared errors of y by these weights, from sums of products whose last row is y's."""
    return float(g[-1, -1] - 2 * beta @ g[cut, -1] + beta @ g[np.ix_(cut, cut)] @ beta)


def delta_r2(fits: DataFrame, by: list[str]) -> DataFrame:
    """n, r2_a, r2_b and delta (B's R2 less A's) by the named columns of fit()'s results; each R2 is against the training mean."""
    sums = fits.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in ("sse_a", "sse_b", "sst")))
    return sums.select(*by, "n", (1 - F.col("sse_a") / F.col("sst")).alias("r2_a"), (1 - F.col("sse_b") / F.col("sst")).alias("r2_b"), ((F.col("sse_a") - F.col("sse_b")) / F.col("sst")).alias("delta"))


def leave_one_out(fits: DataFrame, by: list[str], part: str) -> DataFrame:
    """delta of each series and variant without one fold (or part) at a time."""
    each = fits.groupBy(*by, part).agg(*(F.sum(c).alias(c) for c in ("sse_a", "sse_b", "sst")))
    whole = Window.partitionBy(*by)  # a row a fold
    rest = {c: F.sum(c).over(whole) - F.col(c) for c in ("sse_a", "sse_b", "sst")}
    return each.withColumns({f"_{c}": v for c, v in rest.items()}).select(*by, part, ((F.col("_sse_a") - F.col("_sse_b")) / F.col("_sst")).alias("delta_without"))
