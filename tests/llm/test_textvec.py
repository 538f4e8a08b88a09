import numpy as np
import pyarrow as pa

from tidemark.llm import rules
from tidemark.llm import textvec as tv


def thue_morse(n=1024):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_no_certain_collisions():
    w, v = thue_morse()
    data, offsets = tv.text_bytes(pa.array([w, v, w, "x" + w]))
    starts, ends, _ = tv.word_spans(data, offsets, tv.NOT_SPACE)
    for values in (tv.EXACT, tv.FOLDED):
        h = tv.hash_words(data, starts, ends, values)
        assert h[0] == h[2] and len({*h.tolist()}) == 3
    names = tv.text_names(data, offsets)
    assert names[0] == names[2] and len({*names.tolist()}) == 3
    h = tv.window_hashes(data, 200)
    assert h[0] == h[2048] == h[3073] != h[1024]
    words = np.arange(16, dtype=np.uint64) % np.uint64(2)
    assert len({*tv.grams(words, 8).tolist()}) == 2
    seq = np.array([c == "b" for c in w[:64]], np.uint64)
    assert tv.grams(seq, 64)[0] != tv.grams(np.uint64(1) - seq, 64)[0]


def test_hashes_of_spans_don_t_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    cuts = np.unique(rng.integers(0, 5000, 120))
    starts, ends = cuts[:-1], np.minimum(cuts[1:], cuts[:-1] + rng.integers(0, 200, len(cuts) - 1))
    starts, ends = np.append(starts, 4000)[:-1], ends
    one = tv.hash_spans(data, starts, ends, tv.EXACT)
    texts = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    monkeypatch.setattr(tv, "SLICE_BYTES", 64)
    assert (one == tv.hash_spans(data, starts, ends, tv.EXACT)).all()
    for i in range(len(texts)):
        for j in range(i):
            assert (one[i] == one[j]) == (texts[i] == texts[j])


def test_equal_lines_only():
    w, v = thue_morse()
    text = "\n".join([w, v, w, "", "x y", "x y"])
    data, offsets = tv.text_bytes(pa.array([text, None]))
    starts, _, _ = tv.word_spans(data, offsets, tv.NOT_SPACE)
    lines, dup = rules._dup_lines(data, offsets, starts)
    assert lines.tolist() == [5, 0] and dup.tolist() == [2, 0]
