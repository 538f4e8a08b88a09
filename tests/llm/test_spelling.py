import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling

FORMAT = "doc_id long, text string, word string, n int"


def counted(docs):
    out = Counter()
    for key, text, *_ in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, times=10):
    form, many = {}, {}
    for w, n in words.items():
        by = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(by, key=lambda x: (-words[x], x), default=None)
        many[w], form[w] = len(by), best if best is not None and words[best] >= times * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, many[w], words.get(form[w])) for w, n in words.items())


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def texts(longest):
    rng = random.Random(3)
    base = ["abcdefg", "aaaaaaaa", "hello×÷ing", "straßeàé", "governmental", "internationalisation"]
    words = []
    for b in base:
        words += [b] * 120
        for _ in range(6):
            k = rng.randrange(len(b))
            v = rng.choice([b[:k] + b[k + 1 :], b[:k] + rng.choice("xé") + b[k:], b[:k] + rng.choice("zÿ") + b[k + 1 :]])
            words += [v] * rng.choice([2, 3, 12])
            words += [v + rng.choice("qw")] * 2
    words += ["short", "Ünïcode" * 3, "a" * longest, "a" * longest, "a" * (longest - 1), "a" * (longest - 1), "日本語テキスト", "x1y2z3"]
    rng.shuffle(words)
    docs = [(k, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[k::40]) + rng.choice([".", "̀", ""]), "z", 1) for k in range(40)]
    return [*docs, (None, "governmental governmentall", "z", 1), (3, None, "z", 1), (3, "", None, 1), (5, docs[5][1], "z", 1), (5, docs[5][1], "z", 1)]


@pytest.mark.parametrize("pairs, longest", [(spelling.PAIRS, 5000), (0, 60)])
def test_variants_match_brute_force(spark, pairs, longest):
    docs = texts(longest)
    words = counted(docs)
    assert max(map(len, words)) >= longest - 1
    counts = spelling.word_counts(spark.createDataFrame(docs, FORMAT)).where("n >= 2")
    assert {r.word: r.n for r in counts.collect()} == words
    assert rows(spelling.group(spelling.written(counts), pairs=pairs)) == brute(words)


def test_words_of_the_table_match_brute_force(spark, small):
    some = counted((r.doc_id, r.text) for r in small.collect())
    assert rows(spelling.variants(small)) == brute(some)


def test_chunks_that_all_words_share(spark):
    """Words that differ at two places only: every chunk is hot, and is split until one code point is open."""
    letters = [chr(c) for c in range(0x61, 0x7B)]
    words = {f"commonest{a}{b}": 2 for a in letters for b in letters} | {f"{a}{b}commonest": 2 for a in letters[:9] for b in letters}
    words |= {"commonestaa": 25, "commonesta": 260}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.group(spelling.written(df), pairs=50)) == brute(words)


def test_chains_end_at_the_last_form(spark):
    words = {"a" * 7 + "b" * k: 10 ** (k + 1) for k in range(12)}
    out = rows(spelling.group(spelling.written(spark.createDataFrame(list(words.items()), "word string, n long"))))
    assert out == brute(words) and out[0][2] == "a" * 7 + "b" * 11


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], FORMAT)).collect() == []
