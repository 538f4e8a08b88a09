"""Queries of nested ridge fits and their placebos; the SQL writes down the solution for one column in A and one in X."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bars import BAR, at_offset, rolling
from ..operators.nested import CLIP, DAY, PENALTIES, TEST, NestedRidge, delta_r2, leave_one_out
from .common import with_bars
from .registry import query
from .statistics import labelled

KEYS, START, EMBARGO, PURGE, LEAST, WEEK = ["symbol"], 1704067200, 2 * BAR, 6, 50, 7 * DAY
#: (fold, train_start, train_end, test_start, test_end): training grows, tests are of six days.
FOLDS = [(k, START, START + d * DAY, START + d * DAY, START + (d + 6) * DAY) for k, d in enumerate((12, 18, 24))]
SHIFTS, LAG = [5, 9, 14, 20], 3


def fits(spark, d, x=("f2",), shifts=(), projected=False, rows=None, a=("f1",)):
    return NestedRidge(KEYS, list(a), list(x), "y", FOLDS, EMBARGO, PURGE, LEAST, part=WEEK).fit(labelled(spark, d) if rows is None else rows, shifts, projected)


def _rows(x: str, lag: int) -> list[str]:
    bar = lambda name, k: f"join b {name} on {name}.symbol = b.symbol and {name}.t = b.t + {k * BAR}"
    clip = lambda v: f"greatest(-3, least(3, ln({v})))"
    return [
        f"""f as (select b.symbol, b.t, {clip('b.close / p.close')} as f1, {clip('b.close / b.m')} as f2, {clip('b.volume / b.v')} as f3, {clip('greatest(n.close, 0.01) / b.close')} as y
        from (select *, avg(close) over w as m, avg(volume) over w as v from b window w as (partition by symbol order by t range between {6 * BAR} preceding and 1 preceding)) b {bar('p', -1)} {bar('n', 1)} where p.close > 0 and b.close > 0 and b.m > 0 and b.v > 0)""",
        f"l as (select f.symbol, f.t, f.f1 as a, o.{x} as x, f.f3 as c, f.y, row_number() over (partition by f.symbol order by f.t) - 1 as pos, f.t // {DAY} as day from f join f o on o.symbol = f.symbol and o.t = f.t - {lag * BAR})",
        "k(fold, start, stop, test, until) as (values " + ", ".join(f"({f}, {s}, {e - EMBARGO}, {ts}, {te})" for f, s, e, ts, te in FOLDS) + ")",
        "h as (select l.*, fold, t >= start and t < stop as train from l join k on (t >= start and t < stop) or (t >= test and t < until))",
        "m as (select symbol, fold, min(pos) as first, count(*) as many from h where train group by 1, 2)",
    ]


def nested_sql(x: str = "f2", lag: int = 0, shifts: list[int] = (), projected: bool = False) -> list[str]:
    """CTEs that end in e: the columns of NestedRidge.fit(), beta of A as ba and of A + X as bb and bx."""
    cut = lambda k: f"case when pos - first >= greatest(greatest(many * {k} // 4 - {PURGE}, 1), many * {k - 1} // 4) then 1 else 0 end + case when pos - first >= many * {k} // 4 then 1 else 0 end"
    sums = ", ".join(f"sum({p}) as s{n}" for n, p in {"aa": "a * a", "ax": "a * x", "xx": "x * x", "ay": "a * y", "xy": "x * y", "yy": "y * y"}.items())
    both = lambda where, name: ", ".join(f"sum(s{n}) filter (where {where}) as {name}{n}" for n in ("aa", "ax", "xx", "ay", "xy", "yy"))
    det = "((saa + l) * (sxx + l) - sax * sax)"
    solved = f"say / (saa + l) as ba, ((sxx + l) * say - sax * sxy) / {det} as bb, ((saa + l) * sxy - sax * say) / {det} as bx"
    error_a, error_b = "vyy - 2 * ba * vay + ba * ba * vaa", "vyy - 2 * bb * vay - 2 * bx * vxy + bb * bb * vaa + 2 * bb * bx * vax + bx * bx * vxx"
    moved = "a * g + s_x - s_a * g" if projected else "s_x"
    return [
        *_rows(x, lag),
        "g as (select symbol, fold, sum(a * x) / sum(a * a) as g from h where train group by 1, 2)",
        "days as (select symbol, min(day) as day0, max(day) - min(day) + 1 as days from l group by 1)",
        "v(variant) as (values " + ", ".join(f"({s})" for s in [0, *shifts]) + ")",
        f"""w as (select variant, h.symbol, h.fold, h.train, h.pos, h.t, h.a, h.y, h.x, o.a as s_a, o.x as s_x, g from h join days on days.symbol = h.symbol cross join v join g on g.symbol = h.symbol and g.fold = h.fold
        left join l o on variant != 0 and o.symbol = h.symbol and o.t = h.t - h.day * {DAY} + {DAY} * (day0 + (h.day - day0 - variant + 10 * days) % days))""",
        f"u as (select variant, symbol, fold, train, pos, t, a, y, case when variant = 0 then x else {moved} end as x from w)",
        "n as (select variant, symbol, fold, avg(a) as ma, stddev_pop(a) as da, avg(x) as mx, stddev_pop(x) as dx, avg(y) as mean from u where train and x is not null group by 1, 2, 3)",
        f"""z as (select u.variant, u.symbol, u.fold, m.many, mean, case when train then {cut(1)} + {cut(2)} + {cut(3)} else {TEST} end as seg, case when train then 0 else t // {WEEK} end as part,
        greatest(-{CLIP}, least({CLIP}, (a - ma) / da)) as a, greatest(-{CLIP}, least({CLIP}, (x - mx) / dx)) as x, y - mean as y from u join n using (variant, symbol, fold) join m using (symbol, fold) where x is not null)""",
        f"s as (select variant, symbol, fold, many, mean, seg, part, count(*) as n, {sums} from z group by all)",
        "p(l) as (values " + ", ".join(f"({x})" for x in PENALTIES) + ")",
        f"c as (select variant, symbol, fold, q, many, {both('seg <= 2 * q - 2', 's')}, {both('seg in (2 * q, 2 * q + 1) and seg < 7', 'v')} from s, (select unnest([1, 2, 3]) as q) group by 1, 2, 3, 4, 5)",
        f"cc as (select *, {solved} from c, p where greatest(many * q // 4 - {PURGE}, 1) > {LEAST} and many * (q + 1) // 4 - many * q // 4 > {LEAST} and greatest(many * q // 4 - {PURGE}, 1) >= many * (q - 1) // 4)",
        f"ce as (select variant, symbol, fold, l, sum({error_a}) as ea, sum({error_b}) as eb from cc group by 1, 2, 3, 4)",
        "best as (select variant, symbol, fold, arg_min(l, ea) as la, arg_min(l, eb) as lb from ce group by 1, 2, 3)",
        f"tot as (select variant, symbol, fold, {both(f'seg < {TEST}', 's')} from s group by 1, 2, 3)",
        f"fa as (select variant, symbol, fold, l as penalty_a, ba from (select t.*, la as l, {solved} from (select tot.*, coalesce(la, {PENALTIES[2]}) as la, coalesce(la, {PENALTIES[2]}) as l from tot left join best using (variant, symbol, fold)) t))",
        f"fb as (select variant, symbol, fold, l as penalty_b, bb, bx from (select t.*, {solved} from (select tot.*, coalesce(lb, {PENALTIES[2]}) as l from tot left join best using (variant, symbol, fold)) t))",
        f"""e as (select variant, symbol, fold, part, n, {error_a} as sse_a, {error_b} as sse_b, vyy as sst, penalty_a, penalty_b, ba, bb, bx, mean
        from (select variant, symbol, fold, part, mean, n, {', '.join(f's{n} as v{n}' for n in ('aa', 'ax', 'xx', 'ay', 'xy', 'yy'))} from s where seg = {TEST}) join fa using (variant, symbol, fold) join fb using (variant, symbol, fold))""",
    ]


_DELTA = "sum(n)::bigint as n, round(1 - sum(sse_a) / sum(sst), 6) as r2_a, round(1 - sum(sse_b) / sum(sst), 6) as r2_b, round((sum(sse_a) - sum(sse_b)) / sum(sst), 6) as delta"


def _delta(df, by):
    return delta_r2(df, by).withColumns({c: F.round(c, 6) for c in ("r2_a", "r2_b", "delta")})


@query("r10_nested_ridge", with_bars("select symbol, fold::varchar as fold, part, n, round(sse_a, 5) as sse_a, round(sse_b, 5) as sse_b, round(sst, 5) as sst, penalty_a::double as penalty_a, penalty_b::double as penalty_b, round(ba, 6) as of_a, round(bb, 6) as of_ab, round(bx, 6) as of_x, round(mean, 6) as mean from e", *nested_sql()))
def r10_nested(spark, d):
    """Both models' penalties by inner purged cross-validation, their weights, and errors by fold and week."""
    df = fits(spark, d)
    rounded = {c: F.round(c, 5) for c in ("sse_a", "sse_b", "sst")} | {"of_a": F.round(F.get("beta_a", F.lit(0)), 6), "of_ab": F.round(F.get("beta_b", F.lit(0)), 6), "of_x": F.round(F.get("beta_b", F.lit(1)), 6), "mean": F.round("mean", 6)}
    return df.withColumns(rounded).select("symbol", "fold", "part", "n", "sse_a", "sse_b", "sst", "penalty_a", "penalty_b", "of_a", "of_ab", "of_x", "mean")


@query("r10_nested_three")
def r10_three(spark, d):
    """Two columns in A and one in X; NumPy writes down what it must be in the tests."""
    return fits(spark, d, x=("f3",), a=("f1", "f2")).drop("variant")


@query("r12_nested_delta", with_bars(f"select symbol, fold::varchar as fold, {_DELTA} from e group by 1, 2 union all select symbol, 'all', {_DELTA} from e group by 1", *nested_sql()))
def r12_nested(spark, d):
    """What X adds to R2 out of sample, by fold and over all."""
    df = fits(spark, d)
    return _delta(df, ["symbol", "fold"]).unionByName(_delta(df.withColumn("fold", F.lit("all")), ["symbol", "fold"]))


@query("r12_nested_by_week", with_bars(f"select symbol, part, {_DELTA} from e group by 1, 2", *nested_sql()))
def r12_by_week(spark, d):
    return _delta(fits(spark, d), ["symbol", "part"])


@query("r12_nested_without_fold", with_bars("select symbol, fold::varchar as fold, round((sum(sum(sse_a)) over w - sum(sse_a) - sum(sum(sse_b)) over w + sum(sse_b)) / (sum(sum(sst)) over w - sum(sst)), 6) as delta_without from e group by 1, 2 window w as (partition by symbol)", *nested_sql()))
def r12_without_fold(spark, d):
    return leave_one_out(fits(spark, d), KEYS, "fold").withColumn("delta_without", F.round("delta_without", 6))


@query("r13_projection", with_bars(
    "select h.symbol, h.fold::varchar as fold, h.t, round(h.a * g.ga + h.c * g.gc, 6) as fitted, round(h.x - h.a * g.ga - h.c * g.gc, 6) as residual from l h join g using (symbol)",
    *_rows("f2", 0),
    "q as (select symbol, fold, sum(a * a) as aa, sum(a * c) as ac, sum(c * c) as cc, sum(a * x) as ax, sum(c * x) as cx from h where train group by 1, 2)",
    "g as (select symbol, fold, (cc * ax - ac * cx) / (aa * cc - ac * ac) as ga, (aa * cx - ac * ax) / (aa * cc - ac * ac) as gc from q)").replace("h.fold::varchar", "g.fold::varchar"))
def r13(spark, d):
    """What two columns explain of a third by each fold's training rows, and the rest, for all rows."""
    x = NestedRidge(KEYS, ["f1", "f3"], ["f2"], "y", FOLDS, EMBARGO, PURGE, LEAST).residuals(labelled(spark, d))
    return x.select("symbol", "fold", "t", F.round(F.get("fitted", F.lit(0)), 6).alias("fitted"), F.round(F.get("residual", F.lit(0)), 6).alias("residual"))


def _placebo(df):
    return _delta(df, ["symbol", "variant"])


@query("r14_projected_shifts", with_bars(f"select symbol, variant, {_DELTA} from e group by 1, 2", *nested_sql(shifts=SHIFTS, projected=True)))
def r14_projected(spark, d):
    """X keeps what A explains of it, and the rest moves by whole days around the circle."""
    return _placebo(fits(spark, d, shifts=SHIFTS, projected=True))


@query("r14_naive_shifts", with_bars(f"select symbol, variant, {_DELTA} from e group by 1, 2", *nested_sql(shifts=SHIFTS)))
def r14_naive(spark, d):
    return _placebo(fits(spark, d, shifts=SHIFTS))


@query("r14_sham", with_bars(f"select symbol, variant, {_DELTA} from e group by 1, 2", *nested_sql(x="f3")))
def r14_sham(spark, d):
    """A column without the information stands for X, on the same rows."""
    return _placebo(fits(spark, d, x=("f3",)))


@query("r14_extra_lag", with_bars(f"select symbol, variant, {_DELTA} from e group by 1, 2", *nested_sql(lag=LAG)))
def r14_lag(spark, d):
    """X some bars later than it was; the first rows have none and are left out, nothing goes round."""
    rows = rolling(labelled(spark, d), KEYS, {"late": at_offset("f2", -LAG * BAR)})
    return _placebo(fits(spark, d, x=("late",), rows=rows.where("late is not null")))


@query("r15_nested_p", with_bars(
    "select symbol, (1 + count(*) filter (where variant != 0 and delta >= seen)) / count(*)::double as p, round(quantile_cont(delta, 0.95) filter (where variant != 0), 6) as detectable from (select *, max(delta) filter (where variant = 0) over (partition by symbol) as seen from (select symbol, variant, (sum(sse_a) - sum(sse_b)) / sum(sst) as delta from e group by 1, 2)) group by 1",
    *nested_sql(shifts=SHIFTS, projected=True)))
def r15_nested(spark, d):
    """The observed gain's place among those of the projected shifts."""
    x = delta_r2(fits(spark, d, shifts=SHIFTS, projected=True), ["symbol", "variant"])
    seen = x.where("variant = 0").select("symbol", F.col("delta").alias("seen"))
    null = x.where("variant != 0").join(seen, "symbol")
    return null.groupBy("symbol").agg(((1 + F.count_if(F.col("delta") >= F.col("seen"))) / (1 + F.count("*"))).alias("p"), F.round(F.expr("percentile_cont(0.95) within group (order by delta)"), 6).alias("detectable"))
