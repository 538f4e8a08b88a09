"""Language identification in two levels: the family first, then one-versus-one linear support vector machines
between the languages of that family.

A text becomes the square roots of the shares of its hashed byte trigrams (A-Z lower-cased, everything but letters
and non-ASCII bytes a blank). The family comes from one linear model for each family against the rest; within it every
pair of languages has a support vector machine, and the language with most votes wins, then the larger sum of margins.

A bounded sample of labelled rows is learned from (``per_language``, by a hash of the id). Spark fits all models at once,
each in a task of its own: a pair's on its two languages, a family's on as many rows of each language as keep it
to ``family_rows``. All rows are scored, over whole texts, by one product with the broadcast weights (as many as
languages, pairs and features).

Defined results: a text that is null or has no letter is ``und`` with score 0; languages outside the table of
families are families of their own; null languages teach nothing; with a single language learned all texts get it,
with none they get ``und``; very long texts count whole; repeated rows are judged each; an empty table gives an empty
result; columns of other names are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textvec as tv
from .store import drawn, kept

FEATURES = 2048
#: At most about so many rows of each language are learned from.
PER_LANGUAGE = 1000
#: A family's model is fitted on at most about so many rows.
FAMILY_ROWS = 8_000
PENALTY = 1e-4
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi bn ur pa mr gu ne",
    "iranian": "fa ku ps tg",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.full(256, 0x20, np.uint32)
for _b in range(256):
    if 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b + 32
    elif 0x61 <= _b <= 0x7A or _b >= 0x80:
        _FOLD[_b] = _b


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def features(column: pa.Array, size: int = FEATURES) -> np.ndarray:
    """One row of ``size`` numbers for each text, of length 1 or 0."""
    data, offsets = tv.text_bytes(column)
    x = _FOLD[data]
    out = np.zeros((len(column), size), np.float32)
    if len(x) < 3:
        return out
    tri = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    text = np.repeat(np.arange(len(column)), np.diff(offsets))
    ok = (text[:-2] == text[2:]) & ((x[1:-1] != 0x20) | (x[:-2] != x[2:]))
    slot = (tri[ok] * np.uint32(2654435761)) >> np.uint32(32 - (size - 1).bit_length())
    counts = np.bincount(text[:-2][ok] * size + slot, minlength=len(column) * size).reshape(len(column), size)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)


class Hierarchy:
    """Weights of both levels; predict() gives languages and scores of a feature matrix."""

    def __init__(self, languages: list[str], level: np.ndarray, bias: np.ndarray, pairs: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.languages = languages
        self.families = sorted({family(x) for x in languages})
        self.level, self.bias, self.pairs = level, bias, pairs

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        z = x @ self.level.T + self.bias
        top = z.argmax(axis=1)
        p = 1 / (1 + np.exp(-np.clip(4 * z, -50, 50)))
        p /= p.sum(axis=1, keepdims=True)
        out, score = np.empty(len(x), object), p[np.arange(len(x)), top].astype(float)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(top == f)
            mine = [k for k in self.languages if family(k) == name]
            votes, margins, sure = (np.zeros((len(rows), len(mine))) for _ in range(3))
            for (i, a), (j, b) in combinations(enumerate(mine), 2):
                w, c = self.pairs[a, b]
                m = x[rows] @ w + c  # above 0: b
                q = 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
                votes[:, j] += m > 0
                votes[:, i] += m <= 0
                margins[:, j] += m
                margins[:, i] -= m
                sure[:, j] += q
                sure[:, i] += 1 - q
            best = np.lexsort((margins, votes), axis=1)[:, -1] if len(rows) else rows
            if len(rows):
                out[rows] = np.array(mine, object)[best]
                if len(mine) > 1:
                    score[rows] *= sure[np.arange(len(rows)), best] / (len(mine) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def margin(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (y is -1 or 1; squared hinge loss, each class of equal weight),
    by accelerated gradient steps."""
    one = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    v = np.ones(one.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = one.T @ (share * (one @ v))
        v /= max(float(np.linalg.norm(v)), 1e-12)
    rate = 1 / (2 * max(float((share * (one @ v) ** 2).sum()), 1e-9) + penalty)
    w = z = np.zeros(one.shape[1], np.float32)
    pace = 1.0
    for _ in range(steps):
        slack = np.maximum(1 - y * (one @ z), 0)
        grad = -2 * (one.T @ (share * y * slack)) + penalty * z
        new = (z - rate * grad).astype(np.float32)
        following = (1 + (1 + 4 * pace**2) ** 0.5) / 2
        z = (new + (pace - 1) / following * (new - w)).astype(np.float32)
        w, pace = new, following
    return w[:-1], float(w[-1])


def fit(train: DataFrame, size: int = FEATURES, family_rows: int = FAMILY_ROWS) -> Hierarchy:
    """Learn both levels from a bounded, stored table (lang, rank in its language, key, features as bytes)."""
    languages = sorted(r.lang for r in train.select("lang").distinct().collect())
    families = sorted({family(x) for x in languages})
    each = max(1, family_rows // max(len(languages), 1))
    wanted = [("family", f, f, lang, 1.0 if family(lang) == f else -1.0, each) for f in families for lang in languages if len(families) > 1]
    wanted += [("pair", a, b, lang, 1.0 if lang == b else -1.0, 1 << 30) for a, b in combinations(languages, 2) if family(a) == family(b) for lang in (a, b)]
    level, bias, pairs = np.zeros((len(families), size), np.float32), np.zeros(len(families), np.float32), {}
    if not wanted:
        return Hierarchy(languages, level, bias, pairs)

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table.column("key")), np.asarray(table.column("y"))))
        table = table.take(pa.array(order))
        x = np.frombuffer(b"".join(table.column("features").to_pylist()), np.float32).reshape(len(table), -1)
        w, b = margin(x, np.asarray(table.column("y")).astype(np.float32))
        head = table.slice(0, 1)
        return pa.table({k: head.column(k) for k in ("kind", "a", "b")} | {"w": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([b])})

    plan = train.sparkSession.createDataFrame(wanted, "kind string, a string, b string, lang string, y double, most long")
    rows = train.join(F.broadcast(plan), "lang").where("rank <= most").select("kind", "a", "b", "y", "key", "features")
    for r in rows.groupBy("kind", "a", "b").applyInArrow(run, "kind string, a string, b string, w binary, bias double").collect():
        w = np.frombuffer(r.w, np.float32)
        if r.kind == "pair":
            pairs[r.a, r.b] = (w, r.bias)
        else:
            level[families.index(r.a)], bias[families.index(r.a)] = w, r.bias
    return Hierarchy(languages, level, bias, pairs)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: str = "crc32(cast(doc_id as string)) % 3 = 1", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    known = slim.where(f"lang is not null and text is not null and not ({held_out})")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    shares = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_language / n)))) if sizes else F.create_map().cast("map<string,double>")
    chosen = known.where(drawn(F.xxhash64("doc_id", F.lit(5)), shares[F.col("lang")])).withColumn("key", F.xxhash64("doc_id", "text"))

    def vectors(part: pa.RecordBatch) -> pa.RecordBatch:
        x = features(part.column("text"))
        return pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), tv.binary(x.reshape(-1), np.arange(len(x) + 1) * x.shape[1])], names=["lang", "key", "features"])

    train = tv.map_texts(chosen, "text", vectors, "lang string, key long, features binary", "lang", "key", limit=1 << 19)
    train = kept(train.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("key"))))  # of a bounded sample
    model = docs.sparkSession.sparkContext.broadcast(fit(train))

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        found, sure = model.value.predict(features(part.column("text")))
        letters = has_letter(part.column("text").to_pylist())
        found = [x if ok else UNKNOWN for x, ok in zip(found, letters, strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found, pa.string()), pa.array(np.where(letters, sure, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    marked = slim.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    return tv.map_texts(marked, "text", score, f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, lang_pred string, score double", "doc_id", "held_out", limit=1 << 19)
