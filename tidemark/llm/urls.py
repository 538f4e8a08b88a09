"""URL filter: rules first; where none fits, naive Bayes over words of host and path.

1. Hosts and paths are cut from the URLs; the longest rule that fits decides.
2. Words are counted over the text of all pages. The names in distinct hosts (runs of letters between dots, digits
   and hyphens) are joined to these counts through their substrings, and Viterbi's algorithm splits each name into
   the likeliest words.
3. Multinomial naive Bayes is trained on all pages that a rule decides: the rule's verdict is their label. Distinct hosts
   and distinct path words are scored, then joined back to the pages; pages that no rule decides get its verdict.

Pages are counted by host and words before anything is joined; hosts and words with over a thousandth of the pages (at
most a thousand of them) are broadcast, the rest is shuffled.
Defined results: a null URL or one without ``://`` has an empty host and path and is allowed; hosts without letters
are judged by the rest; tokens that no training page has say nothing; without training pages all others are allowed; a
score of exactly ``threshold`` is allowed; of rules of one length the first wins; repeated rows are judged each; an
empty table gives an empty result; other columns but the page text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import kept, with_hot_keys

#: The rules of the registered query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

LONGEST_WORD = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = re.compile(rb"<[^>]*>")
_NOT_LETTER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null; of equals the first."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last of these wins
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def word_counts(pages: DataFrame, text: str) -> DataFrame:
    """(word, n): ASCII letter words of all pages' text, tags left out."""

    def count(batches):
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                if t:
                    seen.update(_TAG.sub(b" ", t).translate(_NOT_LETTER).split())
            kept_words = [(w.decode(), n) for w, n in seen.items() if len(w) <= LONGEST_WORD]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept_words], pa.string()), pa.array([n for _, n in kept_words], pa.int64())], names=["word", "n"])

    return pages.select(F.col(f"`{text}`")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest split of a name; known: counts of its substrings by (start, length). A word that is not known
    costs as one count in ten to the power of its length times the total."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        tries = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = known.get((start, end - start), 0)
            cost = np.log(n / total) if n else -np.log(total) - (end - start) * np.log(10.0)
            tries.append((best[start][0] + cost, start))
        best.append(max(tries))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, tokens) for distinct names of letters."""
    place = F.explode(F.sequence(F.lit(1), F.length("name")))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("s") + 1)))
    parts = names.select("name", place.alias("s")).select("name", "s", size.alias("size")).withColumn("word", F.expr("substr(name, s, size)"))
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("s", "size", "n")).alias("known"))

    def split(batches):
        for batch in batches:
            tokens = [viterbi(name, {(k["s"] - 1, k["size"]): k["n"] for k in known or []}, total) for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], names=["name", "tokens"])

    return names.join(known, "name", "left").select("name", "known").mapInArrow(split, "name string, tokens array<string>")


def _pieces(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z]+"), lambda x: x != "")


def _split_words(words: Column) -> Column:
    return F.when(words != "", F.split(words, " ")).otherwise(F.array().cast("array<string>"))


def path_words(path: Column) -> Column:
    """Words of letters in lower case, and # for each run of digits, as one string."""
    text = F.regexp_replace(F.translate(path, _UPPER, _LOWER), "[0-9]+", " # ")
    return F.trim(F.regexp_replace(text, "[^a-z#]+", " "))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", text: str = "html", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the method's probability of block) of each row."""
    host, path = host_and_path(F.col(f"`{url}`"))
    slim = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    slim = kept(slim.withColumn("words", path_words(F.col("path"))).withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules)))
    counts = kept(word_counts(pages, text))
    total = max(counts.agg(F.sum("n")).first()[0] or 0, 1)
    kinds = kept(slim.groupBy("host", "words", F.col("r.verdict").alias("verdict")).agg(F.count("*").alias("n")))
    hosts = kinds.groupBy("host").agg(F.sum("n").alias("copies"))
    piece = hosts.select("host", F.posexplode(_pieces(F.col("host"))).alias("k", "name"))
    split = segmented(piece.select("name").distinct(), counts, total)
    hosts = hosts.join(piece.join(split, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "tokens"))), lambda x: x["tokens"])).alias("tokens")), "host", "left")
    hosts = kept(hosts.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))
    known = kinds.where("verdict is not null").join(hosts.drop("copies"), "host")
    marked = kept(known.select("n", (F.col("verdict") == "block").alias("bad"), F.concat("tokens", _split_words(F.col("words"))).alias("tokens")))
    by = {bool(r.bad): (r.pages, r.words or 0) for r in marked.groupBy("bad").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.size("tokens")).alias("words")).collect()}
    (good, good_words), (bad, bad_words) = by.get(False, (0, 0)), by.get(True, (0, 0))
    token = marked.select("n", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(*(F.sum(F.when(F.col("bad") == v, F.col("n")).otherwise(0)).alias(c) for v, c in ((True, "b"), (False, "g"))))
    token = kept(token)
    size = token.count() + 1
    odds = token.select("token", (F.log((F.col("b") + 1) / (bad_words + size)) - F.log((F.col("g") + 1) / (good_words + size))).alias("odds"))
    sums = lambda df, key, tokens: df.select(key, F.explode(tokens).alias("token")).join(odds, "token").groupBy(key).agg(F.sum("odds").alias(f"{key}_odds"))
    shapes = kinds.groupBy("words").agg(F.sum("n").alias("copies"))
    host_odds = kept(hosts.select("host", "copies").join(sums(hosts, "host", "tokens"), "host", "left"))
    word_odds = kept(shapes.join(sums(shapes, "words", _split_words(F.col("words"))), "words", "left"))
    rows = slim.count()
    both = with_hot_keys(slim, host_odds, "host", "copies", rows).drop("copies")
    both = with_hot_keys(kept(both), word_odds, "words", "copies", rows)
    z = F.lit(float(np.log((bad + 1) / (good + 1)))) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("words_odds", F.lit(0.0))
    score = F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(1 / (1 + F.exp(-z)))
    return (
        both.select("page_id", "host", "path", "r", score.alias("score"))
        .select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")
    )
