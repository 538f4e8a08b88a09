import hashlib
import random
from collections import Counter

from tidemark.llm import substrings


def marked(rows, length):
    """(id, bytes, whether each byte goes) of each text."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    for i, t in texts:
        hit = bytearray(len(t) + 1)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                hit[p : p + length] = b"\1" * length
        yield i, t, hit


def kept_by_hand(rows, length):
    """The text that is left of each row; a character that is cut in two goes."""
    whole = dict(rows)
    return {i: bytes(c for c, h in zip(t, hit) if not h).decode("utf-8", "ignore") if any(hit) else whole[i] for i, t, hit in marked(rows, length)}


def brute(rows, length):
    out = []
    for i, t, hit in marked(rows, length):
        rest = bytes(c for c, h in zip(t, hit) if not h)
        spans = sum(hit[k] and not (k and hit[k - 1]) for k in range(len(t)))
        out.append((i, len(t), sum(hit), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def check(spark, rows, length=200, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.without_repeats(df, length=length, **kw).collect())
    assert got == brute(rows, length)
    return got


def made(seed, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cde", "f", "ghij", "é", "kl"]) + str(rng.randrange(50))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(length // 5, length)) for _ in range(5)]
    rows = [None, "", "x" * (3 * length), "ab" * length, "x" * (length - 1), "x" * length, "x" * length]
    for _ in range(40):
        body = text(rng.randint(5, length))
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s)), rng.randrange(len(s))))
            k = rng.randrange(len(body) + 1)
            body = body[:k] + rng.choice([s, s[a:b]]) + body[k:]
        rows.append(body)
    near = text(2 * length)
    for _ in range(15):
        k = rng.randrange(len(near))
        rows.append(near[:k] + rng.choice(["", "Q", "ZZ"]) + near[k + rng.randrange(3) :])
    rows += [rows[10], rows[10], rows[12]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    check(spark, made(1, 40), 40, gram=12, buckets=3)
    assert any(0 < r[2] < r[1] for r in check(spark, made(2, 200)))


def test_repeated_rows_odd_and_empty(spark, odd, small):
    rows = made(3, 60)
    check(spark, rows + rows[:9] + [(1, "other text " * 30)], 60, gram=20)
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 10**4]
    check(spark, rows)
    check(spark, [(r.doc_id, r.text) for r in small.limit(80).collect()])
    assert substrings.without_repeats(odd).count() == odd.count()
    assert substrings.without_repeats(odd.limit(0)).count() == 0


def test_kept_text(spark):
    p = "p" + "".join(f"q{k}" for k in range(90))
    rows = [(1, f"left {p} right"), (2, f"é{p}"), (3, "alone"), (4, None)]
    got = {r.doc_id: r.kept_text for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got == {1: "left  right", 2: "é", 3: None, 4: None}


def test_thue_morse_words_are_no_repetitions(spark):
    w = "a"
    while len(w) < 1024:
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, "left " + w), (2, other + " right"), (3, w[:400]), (4, None)])


def test_null_and_clashing_ids(spark):
    p = "p" + "".join(f"q{k}" for k in range(90))
    rows = [(None, f"left {p} right"), (None, f"é{p}"), (1, p), (1, "alone"), (1, f"x{p}"), (None, "alone too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {t: brute([(k, x) for k, (_, x) in enumerate(rows)], 200)[k] for k, (_, t) in enumerate(rows)}
    got = {r.hash: r for r in substrings.without_repeats(df, with_text=True).collect()}
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    for t, (_, size, gone, spans, sha) in want.items():
        g = got[hashes[t]]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (size, gone, spans, sha)


def test_suffixes_are_sorted_by_ranks_of_samples():
    import numpy as np

    rng = random.Random(8)
    for length in (40, 200):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(6)]
        text = "".join(rng.choice(parts) for _ in range(60)).encode()
        data = np.frombuffer(text + b"c" * (-len(text) % substrings.PERIOD), np.uint8)
        rank = substrings.sample_ranks(data, length)
        tails = [bytes(data[k * 32 :]) for k in range(len(rank))]
        for i in range(len(rank)):
            for j in range(len(rank)):
                if tails[i][:length] != tails[j][:length]:
                    assert (rank[i] < rank[j]) == (tails[i] < tails[j])
        start = np.arange(0, len(text) - length, 1)
        start = start[start % substrings.PERIOD == 5]
        order, same = substrings.equal_suffixes(data, start, length)
        got = [bytes(data[start[k] : start[k] + length]) for k in order]
        assert got == sorted(got) and all(same[k] == (k > 0 and got[k] == got[k - 1]) for k in range(len(got)))


def test_buckets_are_sorted_some_anchors_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SORT_BYTES", 500)
    check(spark, made(7, 60), 60, gram=20, buckets=2)
