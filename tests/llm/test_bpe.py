import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tok = Tokenizer.from_file(PATH)
    tok.no_padding()
    tok.no_truncation()
    return [x.ids for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_equals_the_library_and_round_trips(spark, odd, small):
    for df in (odd.dropDuplicates(["doc_id"]), small):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        coded = bpe.encode(df, PATH, lexicon_words=500, digests=True).cache()
        want = dict(zip(texts, library(texts.values()), strict=True))
        for r in coded.collect():
            assert list(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert {r.doc_id: r.text for r in bpe.decode(coded, PATH).collect()} == texts


def test_random_unicode(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é'ſ1 \n\t中😀.,st²½ \x1c\x85　") for _ in range(100)) for _ in range(300)]
    coder = bpe.Encoder(bpe.Vocabulary(PATH), None)
    ids, at = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library(texts)


def test_lexicon_is_minimal_and_numbers_words():
    words = {b"tap": (1,), b"taps": (1, 2), b"top": (3,), b"tops": (4, 5, 6), b"": (9,)}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    assert len(lex.final) == 5  # t, a|o shared, p, s
    number = lex.find([b"tops", b"tap", b"ta", b"zz", b"", b"tapss"])
    assert [tuple(lex.ids[lex.offsets[n] : lex.offsets[n + 1]].tolist()) if n >= 0 else None for n in number.tolist()] == [(4, 5, 6), (1,), None, None, None, None]


def test_restart_and_empty(spark, odd, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    coder = bpe.Encoder(bpe.Vocabulary(PATH), None)
    for t in ("one two three", "four five six seven", "one <|endoftext|>"):
        assert coder.encode([t, None])[0].tolist() == library([t])[0]
    assert bpe.encode(odd.limit(0), PATH).count() == 0
    assert bpe.encode(odd, PATH, ids=False).count() == odd.count()


def test_frequent_chunks_counts_all(spark):
    texts = [" ".join(f"w{k}" for k in range(10) for _ in range(10 - k))] * 3 + ["rare w9 w9"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for summary in (0, 3, 1000):
        assert bpe.frequent_chunks(df, "text", 20, summary) == sorted([*(f"w{k}" for k in range(10)), "rare"])
        assert bpe.frequent_chunks(df, "text", 4, summary) == ["w0", "w1", "w2", "w3"]
        assert bpe.frequent_chunks(df, "text", 0, summary) == []
