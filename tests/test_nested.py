"""Nested ridge fits against NumPy that holds all rows."""

import numpy as np
import pytest

from tidemark.operators.nested import CLIP, DAY, PENALTIES, NestedRidge, delta_r2

FOLDS = [("first", 0, 12 * DAY, 12 * DAY, 16 * DAY), ("second", 0, 16 * DAY, 16 * DAY, 20 * DAY)]
STEP, EMBARGO, PURGE, LEAST = 7200, 4 * 7200, 5, 20
A, X = ["a1", "a2"], ["x1", "x2"]


def made(seed=0, days=20, names=("p", "q"), spikes=True):
    rng, rows = np.random.default_rng(seed), []
    for k, s in enumerate(names):
        t = np.arange(0, days * DAY, STEP)
        a = rng.normal(size=(len(t), 2)) + 0.5
        x = a @ np.array([[0.6, -0.2], [0.1, 0.4]]) + rng.normal(size=(len(t), 2))
        if spikes:  # the clip binds
            x[rng.random(len(t)) < 0.01] *= 60
        y = a @ [0.5, -0.3] + x @ [0.2, 0.0] * (k == 0) + rng.normal(size=len(t))
        rows += [(s, int(ti), *ai, *xi, yi) for ti, ai, xi, yi in zip(t, a.tolist(), x.tolist(), y.tolist(), strict=True)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "s string, t long, a1 double, a2 double, x1 double, x2 double, y double").repartition(5)


def whole(rows, fold, moved=None):
    """One series and fold by NumPy: (penalties, betas, mean, errors of both, total), X replaced by ``moved``."""
    _, start, end, test_start, test_end = fold
    t = np.array([r[1] for r in rows])
    a, y = np.array([r[2:4] for r in rows]), np.array([r[6] for r in rows])
    x = np.array([r[4:6] for r in rows]) if moved is None else moved
    train, test = (t >= start) & (t < end - EMBARGO), (t >= test_start) & (t < test_end)
    m = np.hstack([a, x])
    mean, spread = m[train].mean(axis=0), m[train].std(axis=0)
    z, n = np.clip((m - mean) / spread, -CLIP, CLIP), int(train.sum())
    base = y[train].mean()
    zt, yt, bounds = z[train], y[train] - base, [n * q // 4 for q in range(5)]
    out = []
    for width in (2, 4):
        errors = []
        for penalty in PENALTIES:
            error = 0.0
            for k in (1, 2, 3):
                e = bounds[k] - PURGE
                if e > LEAST and bounds[k + 1] - bounds[k] > LEAST:
                    w = np.linalg.solve(zt[:e, :width].T @ zt[:e, :width] + penalty * np.eye(width), zt[:e, :width].T @ yt[:e])
                    error += ((yt[bounds[k] : bounds[k + 1]] - zt[bounds[k] : bounds[k + 1], :width] @ w) ** 2).sum()
            errors.append(error)
        best = PENALTIES[int(np.argmin(errors))]
        w = np.linalg.solve(zt[:, :width].T @ zt[:, :width] + best * np.eye(width), zt[:, :width].T @ yt)
        out.append((best, w, ((y[test] - base - z[test][:, :width] @ w) ** 2).sum()))
    return out, base, ((y[test] - base) ** 2).sum(), int(test.sum())


def projected(rows, fold, days):
    """X with what A doesn't explain moved by whole days around the circle."""
    t, a, x = np.array([r[1] for r in rows]), np.array([r[2:4] for r in rows]), np.array([r[4:6] for r in rows])
    train = (t >= fold[1]) & (t < fold[2] - EMBARGO)
    g = np.linalg.lstsq(a[train], x[train], rcond=None)[0]
    return a @ g + np.roll(x - a @ g, days * DAY // STEP, axis=0), np.roll(x, days * DAY // STEP, axis=0)


def same(got, want):
    (pa, wa, ea), (pb, wb, eb) = want[0]
    assert (got.penalty_a, got.penalty_b, got.n) == (pa, pb, want[3])
    for g, w in ((got.beta_a, wa), (got.beta_b, wb), (got.sse_a, ea), (got.sse_b, eb), (got.mean, want[1]), (got.sst, want[2])):
        assert np.allclose(g, w, rtol=1e-8)


def test_both_models_match_numpy(spark):
    rows = made()
    got = NestedRidge(["s"], A, X, "y", FOLDS, EMBARGO, PURGE, LEAST).fit(frame(spark, rows)).collect()
    assert len(got) == 4
    for r in got:
        same(r, whole([x for x in rows if x[0] == r.s], next(f for f in FOLDS if f[0] == r.fold)))


@pytest.mark.parametrize("keep_projection", [True, False])
def test_shifts_match_numpy(spark, keep_projection):
    rows, shifts = made(1), [3, 8]
    fitter = NestedRidge(["s"], A, X, "y", FOLDS, EMBARGO, PURGE, LEAST)
    got = fitter.fit(frame(spark, rows), shifts, keep_projection).collect()
    assert len(got) == 12
    for r in got:
        own, fold = [x for x in rows if x[0] == r.s], next(f for f in FOLDS if f[0] == r.fold)
        same(r, whole(own, fold, projected(own, fold, r.variant)[0 if keep_projection else 1] if r.variant else None))


def test_projection_keeps_what_a_explains(spark):
    rows = made(2, spikes=False)
    got = NestedRidge(["s"], A, X, "y", FOLDS, EMBARGO, PURGE, LEAST).residuals(frame(spark, rows)).where("s = 'p' and fold = 'first'").orderBy("t").collect()
    own = [x for x in rows if x[0] == "p"]
    kept, _ = projected(own, FOLDS[0], 0)
    assert np.allclose(np.array([r.fitted for r in got]) + np.array([r.residual for r in got]), kept)
    train = np.array([r.t < 12 * DAY - EMBARGO for r in got])
    a = np.array([x[2:4] for x in own])
    assert np.allclose(a[train].T @ np.array([r.residual for r in got])[train], 0, atol=1e-6)
    moved, naive = projected(own, FOLDS[0], 5)
    corr = lambda x: np.corrcoef(a[:, 0], x[:, 0])[0, 1]
    assert abs(corr(moved) - corr(kept)) < 0.15 < 0.3 < corr(kept) - corr(naive)


def test_missing_sources_drop_rows_of_both_models(spark):
    """A series without some slots: a shifted row without a source is in neither fit."""
    rows = [r for k, r in enumerate(made(3, names=("p",))) if k % 17 != 5]
    got = NestedRidge(["s"], A, X, "y", FOLDS, EMBARGO, PURGE, LEAST).fit(frame(spark, rows), [4]).where("variant = 4 and fold = 'first'").first()
    have = {r[1]: r for r in rows}
    test = [r for r in rows if 12 * DAY <= r[1] < 16 * DAY and (r[1] - 4 * DAY) % (20 * DAY) in have]
    assert got.n == len(test) < 48


def test_few_rows_take_the_middle_penalty_and_flat_columns_raise(spark):
    rows = made(4, names=("p",))
    got = NestedRidge(["s"], A, X, "y", FOLDS[:1], EMBARGO, PURGE, 1000).fit(frame(spark, rows)).first()
    assert (got.penalty_a, got.penalty_b) == (10.0, 10.0)
    flat = [(*r[:3], 1.0, *r[4:]) for r in rows]
    with pytest.raises(ValueError, match="does not vary"):
        NestedRidge(["s"], A, X, "y", FOLDS, EMBARGO, PURGE, LEAST).fit(frame(spark, flat))


def test_nulls_are_left_out_before_rows_are_counted(spark):
    rows = made(5, names=("p",))
    holes = [(*r[:4], None, *r[5:]) if k % 9 == 0 else r for k, r in enumerate(rows)]
    full = [r for r in holes if r[4] is not None]
    got = NestedRidge(["s"], A, X, "y", FOLDS[:1], EMBARGO, PURGE, LEAST).fit(frame(spark, holes)).first()
    same(got, whole(full, FOLDS[0]))


def test_delta_is_of_sums_and_a_useless_x_adds_nothing(spark):
    fits = NestedRidge(["s"], A, X, "y", FOLDS, EMBARGO, PURGE, LEAST, part=2 * DAY).fit(frame(spark, made(6)))
    by = {r.s: r for r in delta_r2(fits, ["s"]).collect()}
    assert by["p"].n == 96 and by["p"].delta > by["q"].delta and by["p"].delta == pytest.approx(by["p"].r2_b - by["p"].r2_a)
    assert fits.where("s = 'p'").count() == 4
