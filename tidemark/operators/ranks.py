"""Ranks of each row among the rows before it, without pairs and without collected windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import with_halo


def count_below(ranks: np.ndarray, start: np.ndarray, end: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each query how many of ranks[start:end] are smaller than ``below``; all queries at once, one stable partition of
    the ranks a bit (a wavelet matrix), so n log n for any width of the ranges."""
    out = np.zeros(len(start), np.int64)
    top = max(int(ranks.max(initial=0)), int(below.max(initial=0)))
    for bit in reversed(range(top.bit_length())):
        zero = (ranks >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        a, b = zeros[start], zeros[end]
        up = (below >> bit) & 1 == 1
        out += np.where(up, b - a, 0)
        start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
        ranks = np.concatenate([ranks[zero], ranks[~zero]])
    return out


def below_before(df: DataFrame, keys: list[str], value: str, span: int, t: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds seen, how many rows of the series in [t - span, t) have a value, and below, how many of these values are
    smaller than the row's own (null if it has none; NaN counts as none). Rows of one time don't see each other;
    rows without a time are left out.

    Series are dealt into chunks of time with a halo of ``span`` (by default a quarter more rows); a task
    holds one chunk. Work is n log n in a chunk's rows."""
    parts = with_halo(df, keys, span, 0, chunk or max(4 * span, 86400), t)
    schema = parts.withColumns({k: F.lit(None).cast("long") for k in ("seen", "below")}).drop("_chunk", "_core").schema
    names = df.columns

    def rank(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(t)
        v = rows[value].to_pandas()
        has, at, core = v.notna().to_numpy(), rows[t].to_numpy(), rows["_core"].to_numpy()
        ranks = np.unique(v[has].to_numpy(), return_inverse=True)[1].astype(np.int64)
        own = np.zeros(len(at), np.int64)
        own[has] = ranks
        start, end = np.searchsorted(at[has], at[core] - span), np.searchsorted(at[has], at[core])
        below = pa.array(count_below(ranks, start, end, own[core]), mask=~has[core])
        return rows.filter(rows["_core"]).select(names).append_column("seen", pa.array(end - start)).append_column("below", below)

    return parts.groupBy(*keys, "_chunk").applyInArrow(rank, schema)
