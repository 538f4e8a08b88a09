import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import language


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "123 !?"), (10_004, "x"), (10_005, "日本")], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra.withColumn("lang", F.lit(None).cast("string")))
    got = {r.doc_id: r for r in language.identify(both, per_language=150).collect()}
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (10_001, 10_002, 10_003)] == ["und"] * 3
    assert {got[k].lang_pred for k in (10_004, 10_005)} <= {"de", "en", "es", "fr"}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_one_language_none_and_empty(spark, odd):
    got = language.identify(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} == {"en", "und"}
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_features_are_per_text():
    both = language.features(pa.array(["abc def", None, "", "ABC 12 def", "ñandú"]))
    assert np.allclose(both[4], language.features(pa.array(["ñandú"]))[0]) and not both[1].any()
    assert np.allclose((both**2).sum(axis=1), [1, 0, 0, 1, 1], atol=1e-5)


def test_margins_reach_the_minimum():
    rng = np.random.default_rng(4)
    x = rng.random((120, 9)).astype(np.float32)
    y = np.where(x[:, 0] > x[:, 1], 1.0, -1.0).astype(np.float32)
    w, b = language.margin(x, y, 0.05, steps=2000)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    slack = np.maximum(1 - y * (x @ w + b), 0)
    grad = -2 * np.append(x.T @ (share * y * slack), (share * y * slack).sum()) + 0.05 * np.append(w, b)
    assert np.abs(grad).max() < 1e-3


def test_votes_match_brute_force():
    """predict() against the rule written out: the likeliest family, then most votes, then the larger margins."""
    rng = np.random.default_rng(9)
    langs = ["de", "en", "nl", "fr", "es", "xx"]
    families = sorted({language.family(k) for k in langs})
    w = lambda: rng.normal(size=16).astype(np.float32)
    pairs = {(a, b): (w(), float(rng.normal())) for i, a in enumerate(sorted(langs)) for b in sorted(langs)[i + 1 :] if language.family(a) == language.family(b)}
    model = language.Hierarchy(sorted(langs), np.stack([w() for _ in families]), rng.normal(size=len(families)).astype(np.float32), pairs)
    x = rng.normal(size=(200, 16)).astype(np.float32)
    got, score = model.predict(x)
    for k in range(200):
        best = max(range(len(families)), key=lambda f: float(x[k] @ model.level[f] + model.bias[f]))
        mine = [a for a in sorted(langs) if language.family(a) == families[best]]
        votes, sums = dict.fromkeys(mine, 0), dict.fromkeys(mine, 0.0)
        for (a, b), (v, c) in pairs.items():
            if a in votes and b in votes:
                m = float(x[k] @ v + np.float32(c))
                votes[b if m > 0 else a] += 1
                sums[b] += m
                sums[a] -= m
        assert got[k] == max(mine, key=lambda a: (votes[a], sums[a])) and 0 <= score[k] <= 1


def test_rows_in_any_order_teach_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(d, per_language=40).collect()} for d in (docs, docs.repartition(7).orderBy("text")))
    assert one.keys() == two.keys() and all(one[k][0] == two[k][0] and abs(one[k][1] - two[k][1]) < 1e-4 for k in one)
