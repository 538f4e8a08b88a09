"""Byte-level BPE encoding and decoding over a minimal acyclic transducer of frequent words.

1. Every document is counted: each task passes on the counts of all its chunks between blanks, in parts when there
   are more than 20 * ``summary``, and Spark adds these up; the ``lexicon_words`` most frequent
   are the lexicon. Its size is a parameter, so what is compiled on the driver and shipped is bounded. It only
   saves time: results do not depend on it.
2. The lexicon is compiled into a minimal acyclic automaton with shared suffixes. Each edge carries how many words
   precede those below it, so the sum along a path is the word's number, and the number leads to its ids.
3. The automaton is shipped with SparkContext.addFile and memory-mapped by each task; look-ups step all distinct
   words of a slice through it at once.
4. Words that it lacks are merged exactly, all at once: in each round every word merges its leftmost pair of the
   lowest rank.

Defined results: null and empty texts have no ids; special tokens in a text get their id, as in the library;
repeated rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
import uuid
from collections import Counter
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import kept

LEXICON_WORDS = 50_000
SUMMARY = 20_000
CACHE_WORDS = 400_000
SLICE_BYTES = 4 << 20

#: The split pattern of this family of byte-level tokenizers, and the same for
#: texts of ASCII characters and Latin letters alone.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F"
SPLIT_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+"
_NONE = np.int32(1 << 30)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Numbering(dict):
    """Numbers words as they are first asked for; ``new`` holds those without ids yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


def _spans_of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, items), np.int64, len(items))
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size, size


def joined(table: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's spans at the given places, one after the other, and where each begins (one more than places)."""
    flat, begin, size = table
    size = size[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(begin[at] - ends[:-1], size) + np.arange(ends[-1])], ends


class Vocabulary:
    """Merges as sorted pair keys with ranks, the bytes of each id, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = size
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        self.decimal = _spans_of([b"%d," % i for i in range(size)])
        self.spelled = _spans_of(self.bytes)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split, self.split_latin, self.other = regex.compile(SPLIT), re.compile(SPLIT_LATIN, re.ASCII), re.compile(rf"[^\x00-\x7F{_LATIN}]")

    def words(self, text: str) -> list[str]:
        return (self.split_latin if text.isascii() or not self.other.search(text) else self.split).findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words, and special tokens whole."""
        if self.cut_special and any(s in text for s in self.special):
            return [x for k, part in enumerate(self.cut_special.split(text)) for x in ([part] if k % 2 else self.words(part))]
        return self.words(text)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word (none empty), merged in rounds over all words."""
        out: list[tuple[int, ...]] = [()] * len(words)
        if not words:
            return out
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        name = np.arange(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        rank = np.full(len(ids), _NONE, np.int32)
        if len(ids) > 1:
            rank[:-1] = self._look(ids[:-1], ids[1:])
        rank[ends - 1] = _NONE
        while len(name):
            begins = ends - size
            best = np.minimum.reduceat(rank, begins)
            done = best >= _NONE
            if done.any():
                flat = ids.tolist()
                for w, a, b in zip(name[done].tolist(), begins[done].tolist(), ends[done].tolist(), strict=True):
                    out[w] = tuple(flat[a:b])
                left = np.repeat(~done, size)
                ids, rank, name, size, best = ids[left], rank[left], name[~done], size[~done], best[~done]
                ends = np.cumsum(size)
                begins = ends - size
                if not len(name):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            word = np.searchsorted(ends, hit, "right")
            at = hit[np.concatenate([[True], word[1:] != word[:-1]])]  # the leftmost of each word
            ids[at] = self.made[best]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, rank = ids[stay], rank[stay]
            at = at - np.arange(len(at))
            size = size - 1
            ends = np.cumsum(size)
            last = at == ends - 1
            rank[at[last]] = _NONE
            x = at[~last]
            rank[x] = self._look(ids[x], ids[x + 1])
            x = at[at > ends - size]
            rank[x - 1] = self._look(ids[x - 1], ids[x])
        return out


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal acyclic transducer of the words as one block of bytes: a header with the lengths of its arrays,
    then edge keys (state * 256 + byte, sorted), edge targets, numbers of words before the edge's, final states,
    id offsets by word number and ids."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(nodes)
            nodes.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open nodes along the last word: final?, edges
    last = b""

    def close(to: int) -> None:
        while len(path) > to + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))

    for w in words:
        same = len(os.path.commonprefix([w, last]))
        close(same)
        path.extend([False, []] for _ in range(len(w) - same))
        path[-1][0] = True
        last = w
    close(0)
    root = settle(path[0])
    below = []
    for final, edges in nodes:  # children come before their parents
        below.append(final + sum(below[t] for _, t in edges))
    key, target, before = [], [], []
    for s, (final, edges) in enumerate(nodes):
        n = int(final)
        for byte, t in edges:
            key.append(s * 256 + byte)
            target.append(t)
            before.append(n)
            n += below[t]
    offsets = np.cumsum([0, *(len(entries[w]) for w in words)])
    arrays = [np.array(x, np.int64) for x in (key, target, before, [f for f, _ in nodes], offsets, list(chain.from_iterable(entries[w] for w in words)))]
    return np.array([root, *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled transducer over a buffer, such as a memory-mapped file."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 7)
        self.root, at = int(head[0]), 56
        arrays = []
        for n in head[1:].tolist():
            arrays.append(np.frombuffer(buffer, np.int64, n, at))
            at += 8 * n
        self.key, self.target, self.before, self.final, self.offsets, self.ids = arrays

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it is not in the lexicon; all words step at once."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.key):
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        alive = np.flatnonzero(size > 0)
        state, number, depth = np.full(len(alive), self.root), np.zeros(len(alive), np.int64), 0
        while len(alive):
            key = state * 256 + data[begin[alive] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            alive, at = alive[ok], at[ok]
            state, number = self.target[at], number[ok] + self.before[at]
            depth += 1
            ended = size[alive] == depth
            final = ended & (self.final[state] > 0)
            out[alive[final]] = number[final]
            alive, state, number = alive[~ended], state[~ended], number[~ended]
        return out


def frequent_chunks(df: DataFrame, text: str, n: int, summary: int = SUMMARY) -> list[str]:
    """The most frequent chunks between blanks, over all texts: at most n, all that occur about as often as any of them. Nothing
    but these and a short table of counts reaches the driver."""

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["chunk", "n"])

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(t.split(" "))
            if len(seen) > 20 * summary:  # pass on what is counted so far; Spark adds it up
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    counts = df.select(F.col(f"`{text}`")).mapInArrow(count, "chunk string, n long")
    counts = kept(counts.where("length(chunk) between 1 and 64").groupBy("chunk").agg(F.sum("n").alias("n")))
    # how many chunks have a count of about so much: a short table, which gives the least count that n chunks at most reach
    shift = F.greatest(F.length(F.bin("n")) - 7, F.lit(0))
    about = counts.groupBy(F.call_function("shiftleft", F.call_function("shiftright", "n", shift), shift).alias("least")).agg(F.count("*").alias("k")).collect()
    least, total = 1 << 62, 0
    for r in sorted(about, key=lambda r: -r.least):
        total += r.k
        if total > n:
            break
        least = r.least
    return sorted(r.chunk for r in counts.where(F.col("n") >= least).select("chunk").collect())


def ship_lexicon(df: DataFrame, text: str, vocab: Vocabulary, lexicon_words: int) -> str:
    """Compile the lexicon of the table's frequent words and ship it; the file's name on every node."""
    words = {w for c in frequent_chunks(df, text, lexicon_words) for w in vocab.words(" " + c)}
    words = sorted(w.encode() for w in words)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(path, "wb") as f:  # addFile serves it from the driver; it holds at most lexicon_words chunks
        f.write(compile_lexicon(dict(zip(words, vocab.merge(words), strict=True))))
    df.sparkSession.sparkContext.addFile(path)
    return name


class Encoder:
    """Encodes words through the memory-mapped lexicon, and what it lacks by merging. The ids of words seen so far
    stay in one array by their number; at CACHE_WORDS all start anew."""

    def __init__(self, vocab: Vocabulary, lexicon_path: str | None):
        self.vocab = vocab
        self.lexicon = None
        if lexicon_path:
            with open(lexicon_path, "rb") as f:
                self.lexicon = Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        self._restart()

    def _restart(self) -> None:
        self.number = Numbering()
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for s in self.vocab.special:
            self.number[s]  # noqa: B018  takes a number
        self.number.new = []
        self._add([(i,) for i in self.vocab.special.values()])

    def _add(self, ids: list[tuple[int, ...]]) -> None:
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.begin = np.cumsum(self.size) - self.size

    def _learn(self) -> None:
        raw = [w.encode() for w in self.number.new]
        self.number.new = []
        ids: list[tuple[int, ...]] = [()] * len(raw)
        missing = range(len(raw))
        if self.lexicon is not None:
            number = self.lexicon.find(raw)
            known = np.flatnonzero(number >= 0)
            begin, end = self.lexicon.offsets[number[known]], self.lexicon.offsets[number[known] + 1]
            for k, a, b in zip(known.tolist(), begin.tolist(), end.tolist(), strict=True):
                ids[k] = self.lexicon.ids[a:b]
            missing = np.flatnonzero(number < 0).tolist()
        for k, x in zip(missing, self.vocab.merge([raw[k] for k in missing]), strict=True):
            ids[k] = x
        self._add(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more than texts)."""
        if len(self.number) > CACHE_WORDS:
            self._restart()
        pieces = [self.vocab.pieces(t) if t else [] for t in texts]
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(pieces)), np.int64)
        self._learn()
        ids, ends = joined((self.ids, self.begin, self.size), word)
        return ids, ends[np.cumsum([0, *map(len, pieces)])]

    def digests(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[str], list[str]]:
        """For each text, sha256 of its decimal ids joined by commas, and of the text that the ids decode to."""
        comma, c = joined(self.vocab.decimal, ids)
        spelled, d = joined(self.vocab.spelled, ids)
        one = [hashlib.sha256(comma[a : max(a, b - 1)]).hexdigest() for a, b in pairwise(c[at].tolist())]
        two = [hashlib.sha256(spelled[a:b].tobytes().decode("utf-8", "replace").encode()).hexdigest() for a, b in pairwise(d[at].tolist())]
        return one, two

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(vocab: Vocabulary, name: str) -> Encoder:
    """The encoder over a shipped lexicon; a Python worker keeps the last one for its next tasks."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocab, SparkFiles.get(name))
    return _encoders[name]


def encode(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", lexicon_words: int = LEXICON_WORDS, ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id and n_tokens of each text, with its ids (an array), or with digests of the ids and of what they decode to.

    ``vocabulary``: path of the tokenizer's JSON file, which is read on the driver and broadcast (its size is fixed)."""
    vocab = Vocabulary(vocabulary)
    name = ship_lexicon(df, text, vocab, lexicon_words)
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    kind = dict(df.dtypes)[doc_id]
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches):
        coder = encoder(shared.value, name)
        for batch in batches:
            for part in tv.slices(batch, text, SLICE_BYTES):
                flat, at = coder.encode(part.column(text).to_pylist())
                out = [part.column(doc_id), pa.array(np.diff(at))]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)))
                if digests:
                    out += [pa.array(x, pa.string()) for x in coder.digests(flat, at)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests])

    return df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each list of ids (null or empty: the empty text; broken UTF-8 becomes U+FFFD)."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches):
        coder = Encoder(shared.value, None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(f"`{doc_id}`"), F.col(f"`{ids}`")).mapInArrow(run, f"doc_id {dict(df.dtypes)[doc_id]}, text string")
