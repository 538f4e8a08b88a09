import hashlib
import random
import re

from tidemark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        n = min(13, len(x))
        for wd in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == wd:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), found, bool(hit) and 20 * len(hit) >= len(w)


def check(spark, docs, items, kind="long", **kw):
    found = dc.decisions(dc.contamination(docs, spark.createDataFrame(items, f"item_id {kind}, text string"), **kw))
    rows = found.withColumn("digest", dc.items_digest(found["items"])).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        n, hit, ids, bad = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, set(r["items"]), r.contaminated) == (n, hit, ids, bad), r.doc_id
        assert r.digest == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    return rows


def test_matches_brute_force(spark):
    rng = random.Random(3)
    pool = ["ab", "c", "The", "é", "x1", "zz"]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for k in range(40)] + [(90, None), (91, ""), (92, "ab c the"), (93, "unique"), (94, "ab c the")]
    texts = [None, "", *(", ".join(rng.choice(pool[:4]) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    for k in range(60):
        base = words(items[rng.randrange(40)][1])
        cut = rng.randint(0, len(base))
        texts.append(" ".join([*rng.choices(pool, k=5), *base[cut:], *rng.choices(pool, k=rng.randint(0, 9)), *base[:cut]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(spark, docs, items)
    assert any(r.n_hit for r in check(spark, docs, items, block_words=50))  # many blocks
    check(spark, docs, [x for x in items if len(words(x[1])) >= 13])
    check(spark, docs, [])
    named = [(f"item-{k}", t) for k, t in items]
    check(spark, docs, named, kind="string")
    one = [("long", " ".join(t or "" for _, t in items)), ("z", "x1 zz")]
    check(spark, docs, one, kind="string", block_words=40)  # an item that is cut into pieces


def test_thue_morse_words_are_no_hits(spark):
    w = "a"
    while len(w) < 1024:
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    rows = check(spark, spark.createDataFrame([(1, f"x {other} y"), (2, w)], "doc_id long, text string"), [(1, w)])
    assert [r.n_hit for r in sorted(rows)] == [0, 1]


def test_odd_and_real(spark, odd, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    check(spark, odd.dropDuplicates(["doc_id"]), [*items[:5], (100, "a b c d e"), (101, "日本")])
    assert any(r.contaminated for r in check(spark, small, items))
    assert dc.contamination(odd, spark.createDataFrame(items, "item_id long, text string")).count() == odd.count()


def test_span_removal():
    t = "keep this. Drop these words! and keep".encode()
    assert dc.without_spans(t, [{"start_byte": 11, "end_byte": 27}]) == "keep this. ! and keep"
    assert dc.without_spans(None, []) is None
