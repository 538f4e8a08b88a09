import random
import re

from tidemark.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    sets = [(i, grams(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def variants(rng, base, pool):
    out = list(base)
    for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
        k = rng.randrange(len(out))
        out[k : k + rng.choice([0, 1, 1])] = [rng.choice(pool)]
    return " ".join(out)


def made(seed, groups=12, size=14):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    rows = [None, "", "  ", "a", "a b", "A  b", "a b c"]
    for _ in range(groups):
        base = [rng.choice(pool) for _ in range(rng.choice([6, 8, 10, 15, 30, 60, 120]))]
        rows += [variants(rng, base, pool) for _ in range(size)]
    return list(enumerate(rows))


def check(spark, rows, n, percent, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_grams, r.component_id) for r in jaccard.near_duplicates(df, n=n, percent=percent, **kw).collect()}
    assert got == brute(rows, n, percent)


def test_matches_brute_force(spark):
    check(spark, made(1), 4, 85, blocks=3)
    check(spark, made(2), 5, 80)
    check(spark, made(4), 4, 85, block_rows=6)  # most by columns
    check(spark, made(5), 5, 80, block_rows=1)


def test_fingerprints_lose_no_link():
    import numpy as np
    import pyarrow as pa

    for seed in range(30):
        texts = [t for _, t in made(seed, groups=6, size=20)]
        for percent in (80, 85):
            value, at = jaccard.gram_sets(pa.array(texts), 4)
            key, owner, kind, need = jaccard.fingerprints(value, at, percent)
            have = [[set(key[(owner == k) & (kind == j)].tolist()) for j in range(3)] for k in range(len(texts))]
            sets = [set(value[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            for i in range(len(texts)):
                for j in range(i):
                    a, b = sets[i], sets[j]
                    if a and b and a != b and 100 * len(a & b) >= percent * len(a | b):
                        both = set().union(*have[i]) & set().union(*have[j])
                        for k in (i, j):
                            assert have[k][2] & both or any(len(have[k][d] & both) >= need[k][d] for d in (0, 1)), (texts[i], texts[j])
    assert np.array_equal(jaccard.classes(85)[:4], [1, 2, 3, 4])


def test_real_odd_and_empty(spark, odd, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    check(spark, rows, 4, 85)
    rows = [(r.doc_id, r.text) for r in odd.dropDuplicates(["doc_id"]).collect()]
    check(spark, rows, 4, 85)
    assert jaccard.near_duplicates(odd).count() == odd.count()
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_thue_morse_words_and_null_ids(spark):
    w = "a"
    while len(w) < 1024:
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, f"{w} x y z w"), (2, f"{other} x y z w"), (3, f"{w} x y z w")], 4, 85)
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (5, base), (4, base + " end"), (None, "alone in the whole wide world"), (7, "alone in the whole wide world")]
    got = sorted(((r.doc_id, r.n_grams, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85).collect()), key=str)
    assert got == sorted([(None, 57, 4), (5, 57, 4), (4, 58, 4), (None, 3, 7), (7, 3, 7)], key=str)


def test_texts_of_more_words_than_16_bits_count(spark):
    """Two texts of 700,000 distinct words, few column blocks: counts of fingerprints beyond 65,535 in one block."""
    base = [f"w{k}" for k in range(700_000)]
    near = " ".join([*base[:600_000], *(f"v{k}" for k in range(20_000)), *base[620_000:]])
    df = spark.createDataFrame([(1, " ".join(base)), (2, near), (3, "other words that stand alone here")], "doc_id long, text string")
    got = {r.doc_id: (r.n_grams, r.component_id) for r in jaccard.near_duplicates(df, blocks=1).collect()}
    assert got == {1: (699_996, 1), 2: (699_996, 1), 3: (2, 3)}
