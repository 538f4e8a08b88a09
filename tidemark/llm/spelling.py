"""Spelling variants: words that are one edit apart, grouped under the form that is far more frequent.

Candidates come from asymmetric q-chunks. The longer word of a pair (of equal ones either) gives two disjoint chunks, its
first and its second half; the other gives the grams of the same size at the positions that a chunk can have. One edit
leaves one chunk whole: the first where it is, the second shifted by the difference of lengths, one at most. Words
meet by (size, position, chunk) and are verified. A chunk that too many words share is split: its words must also agree
on one half of the rest, at the shift that the edit's place leaves, and so on until a single code point is open; such a
key fixes all others, so no more words share it than there are letters. No word is left out.

Defined results: null and empty texts have no words; a null id counts as an empty one in the damage's hash; repeated rows
count each; words of any length are kept whole; of forms equally frequent the first in code-point order is taken; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Letters of words, and the hash modulus of damaged places.
LETTERS = "A-Za-zÀ-ÿ"
DAMAGED = 31
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Pairs of a key beyond which it is split, and distinct words that a task holds before it passes them on.
PAIRS, HELD = 1000, 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def damaged(word: str, seed: int) -> str:
    """The word without the code point that its hash names, if the hash names one."""
    h = zlib.crc32(word.encode(), seed)
    if h % DAMAGED:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damage: bool = True, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points and how often they occur; damage changes words by id."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # damage only shortens: shorter runs can't count

    def batch_of(seen: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = runs.findall((t.as_py() or "").translate(_LOWER))
                if damage:
                    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                    found = [w for w in (damaged(w, seed) for w in found) if len(w) >= least_length]
                seen.update(found)
                if len(seen) >= HELD:
                    yield batch_of(seen)
                    seen = Counter()
        yield batch_of(seen)

    read = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _key(size: str = "size", gap: str = "gap") -> Column:
    """What the open stretch leaves of a word, with its place: behind it a word with a gap stands one to the left."""
    left, right = F.expr("substr(word, 1, lo)"), F.expr(f"substr(word, hi + 1 - {gap})")
    return F.xxhash64(size, "lo", "hi", left, right)


def _halves(rows: DataFrame) -> DataFrame:
    """Each open stretch as its two halves; the half that is not open any more must agree."""
    mid = F.expr("(lo + hi) div 2")
    both = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
    return rows.withColumn("part", F.explode(both)).select("word", "n", "size", "gap", "part.*")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n): each two words, of a stored table (word, n), that differ by one inserted, deleted or replaced code point; once."""
    sides = F.explode(F.array(F.lit(0), F.lit(1)))  # 0: its own chunks, and grams for words of its size; 1: grams for words longer by one
    rows = words.select("word", "n", sides.alias("gap")).withColumn("size", F.length("word") + F.col("gap"))
    rows, found = _halves(rows.withColumns({"lo": F.lit(0), "hi": F.col("size")})), []
    while True:
        keyed = rows.withColumn("key", _key())
        own, shorter = F.count_if(F.col("gap") == 0), F.count_if(F.col("gap") == 1)
        keys = keyed.groupBy("key").agg(own.alias("own"), shorter.alias("shorter"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        meet = F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("shorter")
        keys = keys.where(meet > 0).select("key", ((meet > pairs) & (F.col("open") > 1)).alias("hot"))
        met = written(keyed.join(keys, "key"))
        a = met.where("not hot and gap = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = met.where("not hot").select("key", "gap", F.col("word").alias("b"), F.col("n").alias("b_n"))
        near = a.join(b, "key").where("(gap = 1 or a < b) and levenshtein(a, b, 1) = 1")
        found.append(written(near.select("a", "a_n", "b", "b_n")))
        rows = met.where("hot")
        if rows.isEmpty():
            return reduce(DataFrame.union, found).distinct()  # a deletion in a run of equal letters has several places
        rows = _halves(rows)


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): the form of the form, and so on; reach doubles each round, and counts
    grow with each link, so that few rounds end it."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        step = now.alias("l").join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        now = written(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group(words: DataFrame, times: int = TIMES, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of a stored table (word, n)."""
    near = near_pairs(words, pairs)
    turned = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = near.select(F.explode(turned).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    form = F.when(-F.col("best.m") >= times * F.col("n"), F.col("best.other"))
    known = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n")))
    ends = roots(written(known.where("form is not null").select("word", "form")))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damage: bool = True, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """The groups of all words of the texts with at least the length and count."""
    return group(written(word_counts(docs, doc_id, text, damage, least_length).where(F.col("n") >= least_count)), times)
