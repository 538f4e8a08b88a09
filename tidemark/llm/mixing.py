"""Mixing sources to target weights: how often each document is taken so that sources come near their shares.

Sizes are summed by source, shares of the whole are cut at a multiple of what a source has and the excess is shared anew,
and a document is taken floor(rate) times, plus once more with the chance of the rate's fraction, drawn by a hash of its
id: no state, no order, the same draw on every run. Documents are never shuffled as texts; only ids and sizes are stored.

Defined results: null and blank texts have size 0 and are taken as others are, 0 words each; rows of a null source
are a source of their own, last in order; a source without words has target 0 and is not taken; rows of one id draw
alike, rows without id by their text; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import with_hot_keys, written

#: What parts words, the weights that repeat over sources in order, and how often a source may be repeated.
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, "mix"


def in_order(sources: DataFrame, column: str) -> DataFrame:
    """``place`` from 0 of each row by the column, nulls last: ranges are numbered by themselves and moved by what stands
    before them; only one count a range reaches the driver."""
    ranges = sources.repartitionByRange(F.asc_nulls_last(column)).sortWithinPartitions(F.asc_nulls_last(column))
    numbered = written(ranges.withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.shiftright("id", 33)))
    before, total = {}, 0
    for r in sorted(numbered.groupBy("range").count().collect()):
        before[r["range"]], total = total, total + r["count"]
    moved = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.create_map(F.lit(-1).cast("long"), F.lit(0))
    return numbered.withColumn("place", F.col("id").bitwiseAND((1 << 33) - 1) + F.element_at(moved, F.col("range"))).drop("id", "range")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``target`` of each row of (source, source_size): the share by weight of all sizes, at most ``repeats`` times the own.

    Whoever would get more than that is cut, and what is over goes to the others by weight, until nobody is above. A round
    is one sum over the sources; only that sum reaches the driver."""
    k = F.col("place") % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (k + 1).cast("int"))
    known = written(in_order(sources, "source").withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats))
    total, full, n_full = known.agg(F.sum("source_size")).first()[0] or 0, F.lit(False), -1
    while True:
        x = known.agg(F.sum(F.when(full, F.col("cap"))).alias("cut"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if x["n"] == n_full:
            return known.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(share)).drop("cap", "place", "weight")
        n_full = x["n"]
        share = F.col("weight").cast("double") * float(total - (x["cut"] or 0)) / float(x["weight"]) if x["weight"] else F.lit(0.0)
        full = F.col("cap") <= share


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 of 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each row."""
    t = F.col(f"`{text}`")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.md5(F.coalesce(t, F.lit(""))))
    size = F.coalesce(F.regexp_count(t, F.lit(NOT_SPACE)), F.lit(0)).cast("long")
    rows = written(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), draw(key, seed).alias("draw")))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # joins leave nulls out
    sums = written(targets(written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), weights, repeats).withColumn("name", named))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    total = sums.agg(F.sum("n")).first()[0] or 0
    out = with_hot_keys(rows.withColumn("name", named), sums.drop("source"), "name", "n", total).withColumn("rate", rate)
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents of mixed()'s plan, each as often as it is taken, with ``copy`` from 1. Ids must be unique and not null."""
    often = plan.where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    return docs.join(often, F.col(f"`{doc_id}`") == F.col("_id")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_id", "copies")
