"""Benchmark decontamination by a generalised suffix automaton over the words of all benchmark items.

Words are A-Z-lower-cased letters, digits and non-ASCII characters. Items are dealt into blocks of about ``block_words``
words (a longer item is cut into pieces that overlap by a window), and a Spark task builds the automaton of each block.
The driver and each task hold one block at a time: its automaton is broadcast, the documents stream by, what they
hit is stored, and it is let go before the next. So a benchmark of any size is worked off exactly in bounded memory.
A task first drops what cannot match: words outside the block's vocabulary and runs without known word pairs; what is
left walks through the automaton, which tracks the longest match that ends at each word. A match of ``window`` words
or more marks its words; an item shorter than that must occur whole.

Defined results: null and empty texts have no words, no hits and are clean; items without words are ignored; item ids may
be of any type and are given as strings; equal items all count; a very long text or item counts whole; repeated documents
are judged each; empty tables give empty results or no hits; other columns are not read, and clean() hands them on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import kept

WINDOW = 13
BLOCK_WORDS = 100_000


class Automaton:
    """Suffix automaton of word-id sequences, with the items that own each window."""

    def __init__(self, items: Iterable[tuple[str, list[int]]], window: int):
        self.window = window
        self.step: dict[tuple[int, int], int] = {}
        self.length, self.link = [0], [-1]
        out: list[set[int]] = [set()]  # words that leave each state
        items = [x for x in items if x[1]]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w, out)
        self.owners: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            state, n = 0, 0
            for w in words:
                state, n = self.step[state, w], n + 1
                if n >= window:
                    self.owners.setdefault(self.cut(state), set()).add(item)
            if len(words) < window:
                self.whole.setdefault(state, []).append((len(words), item))
        self.shortest = min((min(len(w), window) for _, w in items), default=0)

    def _new(self, length: int, link: int, out: list[set[int]]) -> int:
        self.length.append(length)
        self.link.append(link)
        out.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, w: int, out: list[set[int]]) -> int:
        have = self.step.get((last, w))
        if have is not None and self.length[have] == self.length[last] + 1:
            return have
        new = have is None
        cur = self._new(self.length[last] + 1, 0, out) if new else -1
        p = last
        while p >= 0 and (p, w) not in self.step:
            self.step[p, w] = cur
            out[p].add(w)
            p = self.link[p]
        if p < 0:
            return cur
        q = self.step[p, w]
        if self.length[q] == self.length[p] + 1:
            self.link[cur] = q
            return cur
        clone = self._new(self.length[p] + 1, self.link[q], out)
        for x in out[q]:
            self.step[clone, x] = self.step[q, x]
        out[clone] |= out[q]
        self.link[q] = clone
        while p >= 0 and self.step.get((p, w)) == q:
            self.step[p, w] = clone
            p = self.link[p]
        if not new:
            return clone
        self.link[cur] = clone
        return cur

    def cut(self, state: int) -> int:
        """The state of the last ``window`` words of a match that is at least as long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches (from, to) and the items found, in a run of known words."""
        hits, found = [], set()
        state, n = 0, 0
        step, link, length, window, whole = self.step, self.link, self.length, self.window, self.whole
        for i, w in enumerate(words):
            to = step.get((state, w))
            while to is None and state:
                state = link[state]
                n = length[state]
                to = step.get((state, w))
            if to is None:
                continue
            state, n = to, n + 1
            if n >= window:
                hits.append((i + 1 - window, i + 1))
                found |= self.owners[self.cut(state)]
            if whole:
                s = state
                while s > 0:
                    for size, item in whole.get(s, ()):
                        if size <= n:
                            hits.append((i + 1 - size, i + 1))
                            found.add(item)
                    s = link[s]
        return hits, found


class Matcher:
    """An automaton with the hashed vocabulary and word pairs that tell where it has to walk."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in rows], pa.string())
        data, offsets = tv.text_bytes(texts)
        starts, ends, first = tv.word_spans(data, offsets, tv.ALNUM)
        self.vocabulary, ids = np.unique(tv.hash_words(data, starts, ends, tv.FOLDED), return_inverse=True)
        self.automaton = Automaton([(rows[k][0], ids[first[k] : first[k + 1]].tolist()) for k in range(len(rows))], window)
        inner = tv.within(first, 2, len(ids) - 1) if len(ids) > 1 else np.zeros(0, bool)
        self.pairs = np.unique(ids[:-1][inner] * len(self.vocabulary) + ids[1:][inner]) if len(inner) else np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Whether each word is hit, and the items found by text."""
        hit, items = np.zeros(len(hashes) + 1, np.int64), {}
        n = self.automaton.shortest
        if not n or not len(hashes):
            return hit[:-1] > 0, items
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashes
        text = tv.owner(first)
        if n == 1 or not len(self.pairs):
            follows = known[1:] & known[:-1] & (text[1:] == text[:-1])
        else:
            key = np.where(known[:-1] & known[1:], ids[:-1] * len(self.vocabulary) + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            follows = (self.pairs[at] == key) & (text[1:] == text[:-1])
        edge = np.flatnonzero(np.concatenate([[True], ~follows, [True]]))
        runs = np.flatnonzero(np.diff(edge) >= n)
        for k in runs.tolist():
            a, b = int(edge[k]), int(edge[k + 1])
            if b - a == 1 and not known[a]:
                continue
            spans, found = self.automaton.walk(ids[a:b].tolist())
            for x, y in spans:
                hit[a + x] += 1
                hit[a + y] -= 1
            if found:
                items.setdefault(int(text[a]), set()).update(found)
        return np.cumsum(hit)[:-1] > 0, items


def _matchers(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> DataFrame:
    """(block, matcher): each block's pickled Matcher, stored."""

    def pieces(batches):
        for batch in batches:
            rows: list[tuple] = []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, offsets = tv.text_bytes(pa.array([t]))
                starts, ends, _ = tv.word_spans(data, offsets, tv.ALNUM)
                for k in range(0, len(starts), block_words):  # from the second on with the last words of the one before
                    a, b = max(k - window + 1, 0), min(k + block_words, len(starts))
                    rows.append((item, k, data[starts[a] : ends[b - 1]].tobytes().decode(), b - a))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["item", "k", "text", "n"])

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True))
        return pa.table({"block": table.column("block").slice(0, 1), "matcher": pa.array([pickle.dumps(Matcher(rows, window))], pa.binary())})

    cut = kept(benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).mapInArrow(pieces, "item string, k long, text string, n long"))
    n = -(-(cut.agg(F.sum("n")).first()[0] or 0) // block_words)
    return kept(cut.withColumn("block", F.pmod(F.xxhash64("item", "k"), F.lit(max(n, 1))).cast("int")).select("block", "item", "text").groupBy("block").applyInArrow(build, "block int, matcher binary"))


_SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
_FOUND = "n_words long, items array<string>, spans array<struct<first_word:long,end_word:long,start_byte:long,end_byte:long>>"


def _hits(df: DataFrame, matcher, columns: Sequence[str]) -> DataFrame:
    """The named columns of df, and what one block finds in _text; ``matcher``: broadcast bytes, or None for no items."""
    open_: list[Matcher] = []

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        if matcher is not None and not open_:
            open_.append(pickle.loads(matcher.value))
        data, offsets = tv.text_bytes(part.column("_text"))
        starts, ends, first = tv.word_spans(data, offsets, tv.ALNUM)
        hit, items = open_[0].find(tv.hash_words(data, starts, ends, tv.FOLDED), first) if open_ else (np.zeros(len(starts), bool), {})
        spans: list[list] = [[] for _ in range(len(part))]
        for k in items:
            a = int(first[k])
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a : first[k + 1]].astype(np.int8), [0]])))
            for x, y in edges.reshape(-1, 2).tolist():
                spans[k].append({"first_word": x, "end_word": y, "start_byte": int(starts[a + x] - offsets[k]), "end_byte": int(ends[a + y - 1] - offsets[k])})
        made = [pa.array(np.diff(first).astype(np.int64)), pa.array([sorted(items.get(k, ())) for k in range(len(part))], pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *made], names=[*columns, "n_words", "items", "spans"])

    kinds = dict(df.dtypes)
    return tv.map_texts(df, "_text", make, ", ".join([*(f"{c} {kinds[c]}" for c in columns), _FOUND]), *columns)


def _joined_spans(spans: Column) -> Column:
    """Spans in order; those that touch are one."""
    both = lambda acc, x: F.struct(F.element_at(acc, -1)["first_word"].alias("first_word"), F.greatest(F.element_at(acc, -1)["end_word"], x["end_word"]).alias("end_word"), F.element_at(acc, -1)["start_byte"].alias("start_byte"), F.greatest(F.element_at(acc, -1)["end_byte"], x["end_byte"]).alias("end_byte"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["first_word"] <= F.element_at(acc, -1)["end_word"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both(acc, x)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first_word:bigint,end_word:bigint,start_byte:bigint,end_byte:bigint>>"), step)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, columns: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, items (sorted strings) and spans: maximal hit stretches as word and byte positions; then the
    named columns of docs as _0, _1 and so on, so that none clashes."""
    sc = docs.sparkSession.sparkContext
    numbered = [f"_{k}" for k in range(len(columns))]
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, numbered, strict=True)))
    order = ["doc_id", "n_words", "items", "spans", *numbered]
    matchers = _matchers(benchmark, item_id, item_text, window, block_words)
    blocks = sorted(r.block for r in matchers.select("block").collect())
    one = lambda b: sc.broadcast(matchers.where(F.col("block") == b).first().matcher)
    if len(blocks) < 2:
        return _hits(slim, one(blocks[0]) if blocks else None, ["doc_id", *numbered]).select(*order)
    keyed = slim.withColumn("_key", F.md5(F.to_json(F.struct("doc_id", "_text"))))
    found = []
    for b in blocks:
        shared = one(b)
        found.append(kept(_hits(keyed, shared, ["_key"]).where("size(items) > 0").select("_key", "items", "spans").dropDuplicates(["_key"])))
        shared.destroy()
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    every = every.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"), _joined_spans(F.flatten(F.collect_list("spans"))).alias("_spans"))
    rows = _hits(keyed, None, ["doc_id", "_key", *numbered]).join(every, "_key", "left")
    return rows.withColumns({"items": F.coalesce("_items", "items"), "spans": F.coalesce("_spans", "spans")}).select(*order)


def decisions(found: DataFrame, coverage_of: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: hit words make up at least one in ``coverage_of`` of all words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr(f"n_hit > 0 and {coverage_of} * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, coverage_of: int = 20, **options) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    found = decisions(contamination(docs, benchmark, columns=docs.columns, **options), coverage_of)
    return found.where("not contaminated").select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def without_spans(text: bytes | None, spans: list) -> str | None:
    """The text less the hit stretches."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start_byte"]])
        at = s["end_byte"]
    return b"".join([*out, text[at:]]).decode()


def items_digest(items: Column) -> Column:
    """sha256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
