import random
import re

from tidemark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    w = WORD.findall(lowered(text))
    places = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(spark, odd, small):
    more = spark.createDataFrame([(500, "All Rights  Reserved. all rights reserved! CC-BY cc by"), (501, "...General Public License..."), (502, "all rights"), (503, "licensed under the ApacKe"), (504, "cc by.")], "doc_id long, text string")
    for df in (odd.select("doc_id", "text").dropDuplicates(["doc_id"]).union(more), small.select("doc_id", "text")):
        got = {r.doc_id: r for r in licenses.scan(df).collect()}
        for r in df.collect():
            g = got[r.doc_id]
            assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(r.text), r.text[:80]
            assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) | {""}


def test_templates_with_gaps_and_without(spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 500)
    w = licenses.template_words(mit)
    assert len(w) > 140
    changed = [x if k % 40 else "other" for k, x in enumerate(w)]
    rows = [(0, "x y " + mit.lower()), (1, " ".join([*w[:9], "new", *w[9:]])), (2, " ".join(w[:60])), (3, "Released under the MIT License."), (4, " ".join([*w[:80], *["pad"] * 90, *w[80:]])), (5, None), (6, " ".join(changed)), (7, mit * 2)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].labels for k in range(8)] == ["mit", "mit", "", "mit", "", "", "mit", "mit"]
    assert got[0].score == 1.0 and got[0].spans[0].first_word == 2 and got[5].score == 0.0
    assert [(s.first_word, s.end_word) for s in got[7].spans] == [(0, len(w)), (len(w), 2 * len(w))]


def votes(text, templates, k, near, cover):
    """labels and score by plain Python: k-gram hits by diagonal, neighbours merged, covered places as a set."""
    w, found, best = WORD.findall(lowered(text)), set(), 0.0
    for label, t in templates:
        x = licenses.template_words(t)
        hits = sorted((i - p, i, p) for i in range(len(w) - k + 1) for p in range(len(x) - k + 1) if w[i : i + k] == x[p : p + k])
        runs = []
        for d, i, p in hits:
            if not runs or d - runs[-1][-1][0] > near:
                runs.append([])
            runs[-1].append((d, i, p))
        for run in runs:
            places = {p + j for _, _, p in run for j in range(k)}
            size = max(i for _, i, _ in run) + k - min(i for _, i, _ in run)
            if 100 * len(places) >= cover * len(x) and 4 * size <= 5 * len(x) + 8:
                found.add(label)
                best = max(best, len(places) / len(x))
    return found, best


def test_votes_match_brute_force(spark):
    rng = random.Random(5)
    pool = "the of this software a license is or and".split()
    templates = [("one", " ".join(rng.choice(pool) for _ in range(130))), ("two", " ".join(rng.choice(pool) for _ in range(49))), ("three", "this license is the"), ("tiny", "of")]
    rows = []
    for k in range(40):
        t = rng.choice(templates[:3])[1].split()
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = [rng.choice(pool)] * rng.randrange(2)
        rows.append((k, " ".join([*rng.choices(pool, k=rng.randrange(30)), *t, *rng.choices(pool, k=rng.randrange(30))])))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    some = 0
    for k, t in rows:
        labels, score = votes(t, templates, licenses.GRAM, licenses.NEAR, licenses.COVER)
        assert set(filter(None, got[k].labels.split(","))) == labels and abs(got[k].score - score) < 1e-12, t
        some += bool(labels)
    assert 10 < some


def test_rows_and_empty(spark, odd):
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(odd.limit(0)).count() == 0
