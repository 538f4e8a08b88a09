import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality
from tests.llm.test_rules import brute as counted

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98


def test_held_out_labels_teach_nothing_and_order_is_no_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    for x, y in ((docs, turned), (docs.repartition(5).orderBy(F.desc("text")), labels.repartition(3))):
        assert one == {r.doc_id: r.score for r in quality.classify(x, y).collect()}


def by_hand(text):
    """STATISTICS of one text, from plain Python."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars, symbols, dup, repeat = counted(t)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
    count = lambda some: sum(c in some for c in t)
    w, c, m = max(n, 1), max(chars, 1), max(lines, 1)
    return {
        "length": np.log1p(n), "mean_length": chars / w, "symbols": symbols / w, "capitals": sum("A" <= x <= "Z" for x in t) / c, "digits": count("0123456789") / c, "marks": count("!?") / w, "stops": count(".") / w,
        "bars": count("|") / w, "commas": count(",") / w, "repeats": repeat / w, "dup_lines": dup / m, "distinct": len(set(words)) / w, "line_words": np.log1p(n / m),
    }


def test_scores_match_the_rules_by_hand(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))
    slim = docs.withColumnRenamed("text", "_text")
    model = quality.learn(slim, labels)
    assert 3 <= len(model.weighted) < 200
    got = quality.classify(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        x = by_hand(texts[r.doc_id])
        z = model.bias + sum(w for w, rule in model.weighted if all((x[k] <= b) if op == "<=" else (x[k] > b) for k, op, b in rule))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_paths_are_conjunctions_that_split(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    y = ((x[:, 1] > 0.5) & (x[:, 0] <= 0.3)).astype(float)
    bias, found = quality.learned(np.concatenate([x, np.zeros((500, 10))], axis=1), y, 12, 3, 0.001)
    names = [*quality.STATISTICS]
    z = bias + sum(w * quality.truth(x, [(names.index(k), op, b) for k, op, b in rule]) for w, rule in found)
    assert ((z > 0) == (y > 0)).mean() > 0.97
    assert all(len({(k, op) for k, op, _ in rule}) >= 1 and len(rule) <= 3 for _, rule in found)


def test_lasso_reaches_the_minimum():
    rng = np.random.default_rng(2)
    t = rng.random((300, 6)) < 0.5
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * t[:, 0] - 1.0 * t[:, 1] - 0.3)))).astype(float)
    bias, w = quality.lasso(t, y, 0.02)
    g = t.T.astype(float) @ (1 / (1 + np.exp(-(bias + t @ w))) - y) / 300
    assert abs((1 / (1 + np.exp(-(bias + t @ w))) - y).mean()) < 1e-3
    for k in range(6):
        assert abs(g[k] + 0.02 * np.sign(w[k])) < 1e-3 if w[k] else abs(g[k]) <= 0.021


def test_odd_empty_one_class_and_conflicting_labels(spark, odd):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(10)] + [(3, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0.5 < r.score < 1 for r in got)
    assert quality.classify(odd, labels.limit(0)).first().score == 0.5
    assert quality.classify(odd.limit(0), labels).count() == 0
    both = spark.createDataFrame([(k, q, 0) for k in range(10) for q in (0, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.5 for r in quality.classify(odd, both).collect())


def test_clashing_names_pass(spark, odd):
    docs = odd.withColumns({c: F.lit(1) for c in ("stats", "_stats", "_text", "label", "_0")})
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("label", F.lit("z"))
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.classify(docs, labels).count() == docs.count()
