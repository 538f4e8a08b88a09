"""Quality classifier: a sparse ensemble of rules.

1. A bounded sample of labelled rows is learned from (``train_rows``, by a hash of the id; so many ids are broadcast).
   Statistics of their whole texts (shares of symbols, capitals, repeated words and so on) go to one task.
2. There a small forest of shallow trees is grown; each path from a root to a node is a rule, a conjunction of
   comparisons. Logistic regression with a lasso penalty over the rules' truth values keeps a few of them.
3. These compile into one Spark column expression, which scores all rows, in one pass over the texts.

The sample is sorted before it is learned from, so the rules don't depend on how rows are dealt.
Defined results: null and empty texts get statistics of zero and a score like any other text; labels that are null or
of documents that don't occur teach nothing; of several labels of one id the smallest teaches; with labels of one class
or none, or no rule, the score is that class's smoothed share; repeated rows are scored each; a very long text counts
whole; an empty table gives an empty result; labels, language, source and id are no inputs of the score; other columns,
whatever their names, are not read, and accepted() hands them on.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from . import textvec as tv
from .store import drawn

#: At most about so many labelled rows are learned from.
TRAIN_ROWS = 20_000
TREES, DEPTH, PENALTY = 24, 3, 0.001

_COUNTED = {"n_digits": "0123456789", "n_marks": "!?", "n_stops": ".", "n_bars": "|", "n_commas": ","}
_TABLES = {k: np.array([chr(b) in v for b in range(256)]) for k, v in _COUNTED.items()}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_distinct", *_COUNTED]

#: Inputs of the trees, over the counts.
STATISTICS = {
    "length": "ln(1 + n_words)",
    "mean_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "commas": "n_commas / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "line_words": "ln(1 + n_words / greatest(n_lines, 1))",
}


def statistics(df: DataFrame, text: str = "text", *columns: str) -> DataFrame:
    """The named columns and a struct ``_stats`` with STATISTICS of each text."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tv.text_bytes(part.column(text))
        starts, ends, first = tv.word_spans(data, offsets, tv.NOT_SPACE)
        words = tv.hash_words(data, starts, ends, tv.EXACT)
        lines, dup = rules._dup_lines(data, offsets, starts)
        one = np.unique(tv.mix(words + tv.mix(tv.owner(first).astype(np.uint64))), return_index=True)[1]
        distinct = np.bincount(tv.owner(first)[one], minlength=len(part))
        made = [np.diff(first), rules._sums(tv.NOT_SPACE[data] & rules._LEAD[data], offsets), rules._sums(rules._SYMBOL[data], offsets), dup, rules._repeat_words(words, first, 5), lines, rules._sums(rules._CAPITAL[data], offsets), distinct]
        made += [rules._sums(t[data], offsets) for t in _TABLES.values()]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in made], _COUNTS)], names=[*columns, "_stats"])

    kinds = dict(df.dtypes)
    counts = tv.map_texts(df, text, make, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "_stats struct<" + ",".join(f"{c}:long" for c in _COUNTS) + ">"]), *columns)
    inputs = [F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"_stats.\1", e)).cast("double").alias(k) for k, e in STATISTICS.items()]
    return counts.select(*(F.col(f"`{c}`") for c in columns), F.struct(*inputs).alias("_stats"))


Rule = list[tuple[str, str, float]]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> list[list[tuple[int, str, float]]]:
    """Paths to all nodes below the root of one tree: at each node a third of the columns, drawn anew, are tried at up to
    63 quantiles, and the split that lowers the weighted Gini impurity most is taken."""
    found: list[list[tuple[int, str, float]]] = []

    def split(at: np.ndarray, path: list[tuple[int, str, float]]) -> None:
        best = (1e-9, -1, 0.0)
        total, ones = w[at].sum(), (w[at] * y[at]).sum()
        for c in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False).tolist():
            v = x[at, c]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1], method="lower"))
            cuts = cuts[cuts < v.max()] if len(v) else cuts
            if not len(cuts):
                continue
            slot = np.searchsorted(cuts, v)  # v <= cuts[k] for slots up to k
            n = np.cumsum(np.bincount(slot, w[at], len(cuts) + 1))[:-1]
            p = np.cumsum(np.bincount(slot, w[at] * y[at], len(cuts) + 1))[:-1]
            ok = (n >= least) & (total - n >= least)
            gain = np.where(ok, p**2 / np.maximum(n, 1) + (ones - p) ** 2 / np.maximum(total - n, 1) - ones**2 / max(total, 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), c, float(cuts[k]))
        _, c, cut = best
        if c < 0:
            return
        low = x[at, c] <= cut
        for op, part in (("<=", at[low]), (">", at[~low])):
            found.append([*path, (c, op, cut)])
            if len(path) + 1 < depth:
                split(part, found[-1])

    split(np.arange(len(x)), [])
    return found


def truth(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, op, cut in rule:
        out &= (x[:, c] <= cut) if op == "<=" else (x[:, c] > cut)
    return out


def lasso(t: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the mean logistic loss plus ``penalty`` times the weights' absolute sum, by
    accelerated proximal steps."""
    n, m = t.shape
    one = np.concatenate([np.ones((n, 1), np.float32), t.astype(np.float32)], axis=1)
    v = np.ones(m + 1, np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(np.linalg.norm(one @ v) ** 2), 1e-9)
    w = z = np.zeros(m + 1)
    pace = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(one @ z.astype(np.float32), -50, 50)))
        new = z - rate * (one.T @ (p - y).astype(np.float32)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        following = (1 + (1 + 4 * pace**2) ** 0.5) / 2
        z = new + (pace - 1) / following * (new - w)
        w, pace = new, following
    return float(w[0]), w[1:]


def learned(x: np.ndarray, y: np.ndarray, trees: int, depth: int, penalty: float) -> tuple[float, list[tuple[float, Rule]]]:
    """Bias and weighted rules of a bounded sample; the same for any order of its rows."""
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order].astype(float)
    p = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return bias, []
    rng, paths = np.random.default_rng(7), {}
    for _ in range(trees):
        for path in grow(x, y, rng.poisson(1.0, len(y)).astype(float), depth, max(2, min(20, len(y) // 50)), rng):
            paths.setdefault(tuple(sorted(path)), path)
    found = [paths[k] for k in sorted(paths)]
    if not found:
        return bias, []
    bias, weights = lasso(np.stack([truth(x, r) for r in found], axis=1), y, penalty)
    names = [*STATISTICS]
    return bias, [(float(w), [(names[c], op, cut) for c, op, cut in r]) for w, r in zip(weights, found, strict=True) if abs(w) > 1e-6]


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, bound in rule:
        x = F.col(f"_stats.{name}")
        out = out & ((x <= bound) if op == "<=" else (x > bound))
    return out


class RuleEnsemble:
    """Weighted rules; score() is the column that they compile to."""

    def __init__(self, bias: float, weighted: list[tuple[float, Rule]]):
        self.bias, self.weighted = bias, weighted

    def score(self) -> Column:
        total = F.lit(self.bias)
        for w, rule in self.weighted:
            total = total + F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def fit(train: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Learn from a bounded table (_stats, label), in one task."""
    names = [*STATISTICS]

    def run(batches):
        parts = [batch.to_pandas() for batch in batches]
        x = np.concatenate([p[names].to_numpy(float) for p in parts]) if parts else np.zeros((0, len(names)))
        y = np.concatenate([p["label"].to_numpy(float) for p in parts]) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(learned(x, y, trees, depth, penalty))])], names=["model"])

    rows = train.select("_stats.*", "label").repartition(1).mapInArrow(run, "model string").collect()
    bias, weighted = json.loads(rows[0].model) if rows else (0.0, [])
    return RuleEnsemble(bias, [(w, [tuple(c) for c in r]) for w, r in weighted])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: str = HELD_OUT, train_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """The ensemble for documents (doc_id, _text) with labels (doc_id, label); labels of held-out rows are not learned."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1)).where(f"not ({held_out})").groupBy("doc_id").agg(F.min("label").alias("label"))
    total = known.count()
    share = min(1.0, train_rows / total) if total else 1.0
    chosen = known.where(drawn(F.xxhash64(F.col("doc_id"), F.lit(11)), share))
    return fit(statistics(docs.join(F.broadcast(chosen), "doc_id"), "_text", "label"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", held_out: str = HELD_OUT, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    model = learn(slim, labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("_label")), "_label", held_out, train_rows)
    scored = statistics(slim, "_text", "doc_id").select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", held_out: str = HELD_OUT, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; nothing but the sample's ids is joined."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    model = learn(slim, labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("_label")), "_label", held_out, train_rows)
    numbered = [f"_{k}" for k in range(len(docs.columns))]  # so that no name clashes
    every = docs.select(F.col(f"`{text}`").alias("_text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, numbered, strict=True)))
    return statistics(every, "_text", *numbered).where(model.score() >= threshold).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, numbered, strict=True)))
