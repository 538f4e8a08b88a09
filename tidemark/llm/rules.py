"""Quality rules with adaptive thresholds.

Counts per text are made by one pass over the data. Each statistic of each (language, source) is summed up in a
mergeable quantile sketch: a histogram over buckets that keep the five leading bits of the value (relative error
below 1/16), so partial sketches add up in any order and grow with the logarithm of the range, not with the rows.
Most texts have no symbols, repetitions or capitals at all, so a sketch is of the values above zero, and zero always
passes. Fences at ``reach`` times the middle half's width beyond the quartiles (a width of at least a sixteenth of the upper
one, the sketch's own error) replace fixed cutoffs; they are joined back to the rows by (language, source).

Defined results: a null or empty text has no words, fails the base rules and is not kept; null languages or sources
form groups of their own; repeated rows are judged each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textvec as tv
from .store import kept

#: Statistics that get fences: expression over the counts, and whether values below the lower fence fail too.
STATISTICS = {
    "mean_length": ("word_chars * 100 div n_words", True),
    "symbols": ("n_symbols * 1000 div n_words", False),
    "dup_lines": ("n_dup_lines * 1000 div n_lines", False),
    "repeats": ("n_repeat_words * 1000 div n_words", False),
    "capitals": ("n_capitals * 1000 div word_chars", False),
}
REACH = 3

_SYMBOL = np.array([chr(b) in "[#*$%&|<>]" and chr(b) not in "[]" for b in range(256)])
_CAPITAL = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
_NEWLINE = np.array([b == 0x0A for b in range(256)])


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Per text: words that lie in a window found at least twice in it."""
    g = tv.grams(hashes, window)
    at = np.flatnonzero(tv.within(first, window, len(g))) if len(g) else np.zeros(0, np.int64)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        text, key = tv.owner(first)[at], g[at]
        key = tv.mix(key + tv.mix(text.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + window, -1)
    return _sums(np.cumsum(covered)[:-1] > 0, first)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them that equal an earlier one."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(_NEWLINE[data])
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    worded = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends = begins[worded], ends[worded]
    text = np.searchsorted(offsets, begins, "right") - 1
    key = tv.hash_spans(data, begins, ends, tv.EXACT)
    lines = np.bincount(text, minlength=n)
    unique = np.unique(tv.mix(key + tv.mix(text.astype(np.uint64))), return_index=True)[1]
    return lines, lines - np.bincount(text[unique], minlength=n)


def counts(df: DataFrame, text: str = "text", *columns: str, window: int = 5) -> DataFrame:
    """The named columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)
    and n_capitals of each text."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tv.text_bytes(part.column(text))
        starts, ends, first = tv.word_spans(data, offsets, tv.NOT_SPACE)
        lines, dup = _dup_lines(data, offsets, starts)
        out = [
            np.diff(first),
            _sums(tv.NOT_SPACE[data] & _LEAD[data], offsets),
            _sums(_SYMBOL[data], offsets),
            dup,
            _repeat_words(tv.hash_words(data, starts, ends, tv.EXACT), first, window),
            lines,
            _sums(_CAPITAL[data], offsets),
        ]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(pa.array(x.astype(np.int64)) for x in out)], names=[*columns, *made])

    kinds = dict(df.dtypes)
    return tv.map_texts(df, text, make, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"{c} long" for c in made)]), *columns)


def _bucket(value: F.Column) -> F.Column:
    """The lower end of the value's bucket: its five leading bits, the rest zero."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, stat, bucket, n): histograms that merge by adding n."""
    pairs = F.array(*(F.struct(F.lit(k).alias("stat"), F.expr(e).alias("value")) for k, (e, _) in STATISTICS.items()))
    return (
        stats.where("n_words > 0 and word_chars > 0 and n_lines > 0")
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p"))
        .where("p.value > 0")
        .groupBy("lang", "source", F.col("p.stat").alias("stat"), _bucket(F.col("p.value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per (lang, source) with <stat>_low and <stat>_high, from quartiles by nearest rank."""
    by = ["lang", "source", "stat"]
    seen = F.sum("n").over(W.partitionBy(*by).orderBy("bucket"))
    total = F.sum("n").over(W.partitionBy(*by))
    quart = (
        sketch.select(*by, "bucket", seen.alias("seen"), total.alias("total"))
        .groupBy(*by)
        .agg(*(F.min(F.when(F.expr(f"seen * 4 >= total * {q}"), F.col("bucket"))).alias(f"q{q}") for q in (1, 3)))
        .withColumn("width", F.expr("greatest(q3 - q1, q3 div 16 + 1)"))
    )
    wide = [F.max(F.when(F.col("stat") == k, F.expr(e))).alias(f"{k}_{end}") for k in STATISTICS for end, e in (("low", f"q1 - {reach} * width"), ("high", f"q3 + {reach} * width"))]
    return quart.groupBy("lang", "source").agg(*wide)


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", reach: int = REACH) -> DataFrame:
    """doc_id, the counts, base_failed and kept (null counts never occur; see the module for edge cases)."""
    stats = kept(counts(df, text, doc_id, lang, source))
    limit = fences(sketches(stats, lang, source), reach).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    inside = F.lit(True)
    for k, (e, two) in STATISTICS.items():
        value = F.expr(e)
        inside = inside & ((value == 0) | ((value <= F.col(f"{k}_high")) & ((value >= F.col(f"{k}_low")) if two else F.lit(True))))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return stats.join(limit, stats[lang].eqNullSafe(limit.f_lang) & stats[source].eqNullSafe(limit.f_source), "left").select(
        F.col(doc_id).alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(F.coalesce(inside, F.lit(False))).alias("kept"),
    )
