import hashlib
import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import mixing

FORMAT = "doc_id long, text string, source string, size int, target double"


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated cutting, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        rest, left = total - sum(most * sizes[s] for s in cut), sum(w for s, w in weight.items() if s not in cut)
        out = {s: float(most * sizes[s]) if s in cut else weight[s] * rest / left for s in order}
        over = {s for s in order if s not in cut and out[s] >= most * sizes[s]}
        if not over:
            return out
        cut |= over


def brute(docs):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in docs]
    by = Counter()
    for n, (_, _, s, *_) in zip(size, docs, strict=True):
        by[s] += n
    targets, out = shares(by), []
    for n, (key, t, s, *_) in zip(size, docs, strict=True):
        rate = targets[s] / by[s] if by[s] else 0.0
        name = str(key) if key is not None else hashlib.md5((t or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:13], 16) / 2**52
        copies = math.floor(rate) + (draw < rate - math.floor(rate))
        out.append((key, n, by[s], targets[s], copies, copies * n))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "copies", "taken")) for r in df.collect()), key=str)


def made(seed, sources, n):
    rng = random.Random(seed)
    names = [None, *(f"s{k}é" for k in range(sources))]
    docs = []
    for k in range(n):
        s = names[1] if rng.random() < 0.35 and sources else rng.choice(names)
        docs.append((rng.choice([k, k, k, None]), rng.choice([None, "", " \t\n", "a b\x1cc", "w " * rng.randint(1, 300)]), s, 1, 0.5))
    return [*docs, docs[-1], docs[-1]]


@pytest.mark.parametrize("seed, sources, n", [(1, 7, 400), (2, 0, 20), (3, 60, 90), (4, 2, 50), (5, 1500, 3000)])
def test_plan_matches_brute_force(spark, seed, sources, n):
    docs = made(seed, sources, n)
    assert rows(mixing.mixed(spark.createDataFrame(docs, FORMAT))) == brute(docs)


def test_targets_are_cut_and_shared_anew():
    assert shares({"a": 10, "b": 10, "c": 80}) == {"a": 30.0, "b": 30.0, "c": 40.0}


def test_sources_come_near_their_targets(spark, small):
    got = mixing.mixed(small.unionByName(small.withColumn("doc_id", small.doc_id + 10_000)).unionByName(small.withColumn("doc_id", small.doc_id + 20_000)))
    by = got.join(small.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg({"taken": "sum", "size": "sum", "target": "max", "source_size": "max"}).collect()
    assert sum(r["sum(taken)"] for r in by) == pytest.approx(sum(r["max(target)"] * r["sum(size)"] / r["max(source_size)"] for r in by), rel=0.1)
    assert got.where("taken > 3 * size").isEmpty()


def test_empty_table_and_no_words(spark):
    assert mixing.mixed(spark.createDataFrame([], FORMAT)).collect() == []
    blank = [(k, t, "s", 1, 0.5) for k, t in enumerate([None, "", " \n"])]
    assert {tuple(r)[1:] for r in mixing.mixed(spark.createDataFrame(blank, FORMAT)).collect()} == {(0, 0, 0.0, 0, 0)}


def test_documents_are_emitted_as_often_as_planned(spark):
    docs = [(k, "w " * (k % 9 + 1), f"s{k % 5}", 1, 0.5) for k in range(300)]
    df = spark.createDataFrame(docs, FORMAT)
    plan = mixing.mixed(df)
    out = Counter(r.doc_id for r in mixing.emitted(df, plan).select("doc_id").collect())
    assert out == Counter({r.doc_id: r.copies for r in plan.collect() if r.copies}) and mixing.emitted(df, plan).columns == [*df.columns, "copy"]
