import importlib.util
import sys

import public_tokenizers
import pytest

from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard import brute as components
from tests.llm.test_substrings import kept_by_hand
from tidemark.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_decisions(stages):
    base = stages["documents"].columns
    assert all(stages[k].columns == base for k in list(stages)[:-1])
    a, b, c, d = (rows(stages[k]) for k in ("quality_filter", "near_duplicates", "repeated_substrings", "benchmark_filter"))
    found = components([(k, r.text) for k, r in a.items()], 5, 80)
    assert set(b) == {k for k, (_, root) in found.items() if root == k}
    left = kept_by_hand([(k, r.text) for k, r in b.items()], 200)
    assert {k: r.text for k, r in c.items()} == {k: t for k, t in left.items() if t != "" or b[k].text == ""}
    assert all(r.n_chars == len(r.text) for k, r in c.items() if r.text != b[k].text)


def test_clean_documents_stay_and_contaminated_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    c, d = rows(stages["repeated_substrings"]), rows(stages["benchmark_filter"])
    assert set(d) == {k for k, r in c.items() if not hits(r.text, items)[3]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    every, good = rows(stages["documents"]), rows(stages["quality_filter"])
    known = [k for k in every if labels.get(k) == 1]
    assert sum(k in good for k in known) >= 0.97 * len(known)


def test_ids_decode_to_the_texts(stages):
    coder = bpe.Encoder(bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), None)
    texts = rows(stages["benchmark_filter"])
    got = rows(stages["encoded"])
    assert set(got) == set(texts) and all(coder.decode(r.ids) == (texts[k].text or "") for k, r in got.items())


def test_odd_documents_pass_each_stage(spark, odd):
    import corpus_pipeline as cp

    odd = odd.selectExpr("*", "cast(length(text) as long) n_chars", "1 stats", "2 _text", "3 kept_text", "4 row", "5 hash", "6 _0")
    for name, stage in cp.STAGES:
        out = stage(spark, odd, SF)
        assert 0 < out.count() <= odd.count() and "doc_id" in out.columns, name
        if name != cp.STAGES[-1][0]:
            assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_each_row_is_judged_by_its_own_text(spark):
    import corpus_pipeline as cp

    prose = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    shared = prose("s", 80)
    rows = [(1, f"head one {shared}"), (1, f"{shared} other id"), (None, f"void {shared}"), (2, prose("t", 30)), (2, prose("u", 30)), (None, prose("u", 30)), (None, prose("v", 30)), (3, None), (3, ""), (4, prose("w", 30)), (4, prose("w", 30)), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()), key=str)
    # the three texts around the shared passage are near copies of each other: one row stays, and so does one of each other text
    heads = [x for x in got if "s40" in (x[1] or "")]
    assert len(heads) == 1 and heads[0] in rows[:2]
    assert [x for x in got if x not in heads] == sorted([(2, prose("t", 30)), (2, prose("u", 30)), (None, prose("v", 30)), (3, None), (3, ""), (4, prose("w", 30)), (None, None)], key=str)
    apart = docs.where("text is null or text not like 'w%'")
    left = sorted(((r.doc_id, r.text) for r in cp.repeated_substrings(spark, apart, SF).collect()), key=str)
    assert (1, "head one") in left and (1, " other id") in left and (None, "void") in left
    assert (2, prose("t", 30)) in left and (3, None) in left and (3, "") in left and len(left) == len(set(left))


def test_quality_filter_follows_the_classifier(spark, stages):
    from tidemark.llm import quality

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r.doc_id: r.predicted for r in quality.classify(stages["documents"], labels).collect()}
    assert set(rows(stages["quality_filter"])) == {k for k, p in judged.items() if p == 1}


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline as cp

    got = {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in cp.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in stages["encoded"].collect()}
