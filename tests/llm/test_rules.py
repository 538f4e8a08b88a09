import re

from tidemark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    rep = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_counts_match_brute_force(odd, small):
    for df in (odd, small):
        got = {r.doc_id: r for r in rules.judge(df).collect()}
        assert len(got) == df.select("doc_id").distinct().count()
        for r in df.collect():
            g, (n, chars, sym, dup, rep) = got[r.doc_id], brute(r.text)
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, sym, dup, rep)
            assert g.base_failed == (n < 10 or 100 * rep > 20 * n)
            assert not (g.base_failed and g.kept)


def test_rows_and_empty(odd, spark):
    assert rules.judge(odd).count() == odd.count()
    assert rules.judge(odd.limit(0)).count() == 0


def test_sketch_is_mergeable_and_close(spark):
    df = spark.range(1, 2001).selectExpr("'en' lang", "'s' source", "10L n_words", "id word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words", "1L n_lines", "0L n_capitals")
    halves = rules.sketches(df.where("word_chars % 2 = 0")).union(rules.sketches(df.where("word_chars % 2 = 1"))).groupBy("lang", "source", "stat", "bucket").sum("n").withColumnRenamed("sum(n)", "n")
    assert sorted(halves.select("stat", "bucket", "n").collect()) == sorted(rules.sketches(df).select("stat", "bucket", "n").collect())
    f = rules.fences(halves).first()
    q1, q3 = (f.mean_length_high + 3 * f.mean_length_low) / 4, None
    width = (f.mean_length_high - f.mean_length_low) / 7
    q1 = f.mean_length_low + 3 * width
    assert abs(q1 - 5000) <= 5000 / 16 and abs(q1 + width - 15000) <= 15000 / 8


def test_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = rules.judge(docs).join(labels, "doc_id").where("not base_failed and quality = 1")
    assert judged.where("kept").count() >= 0.97 * judged.count()
