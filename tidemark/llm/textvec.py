"""NumPy helpers that work on whole Arrow string columns inside a Spark task.

Texts are handled as UTF-8 bytes. A batch is cut into slices of about ``SLICE_BYTES`` (a longer text is a
slice of its own), so the arrays of a slice stay small whatever the number of rows in a batch. A text takes up to
about 40 bytes of a worker's memory for each of its own (100 in substring removal), so the longest text sets the bound.

Words, lines and texts are named by 64-bit numbers. A word or line is the sum of one random number for each place and
byte, so two different ones agree with a chance of 2**-64, whatever their bytes; texts are named by BLAKE2. n-grams chain
the numbers of their words through an avalanche step. ``prefix_hash`` alone is a polynomial modulo 2**64, which has
collisions by construction (Thue-Morse words); it only chooses and orders candidates, and never decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def is_space(byte: int) -> bool:
    return byte == 0x20 or 0x09 <= byte <= 0x0D


def is_alnum(byte: int) -> bool:
    return 0x30 <= byte <= 0x39 or 0x41 <= byte <= 0x5A or 0x61 <= byte <= 0x7A or byte >= 0x80


#: Bytes of words that blanks part, and bytes of words of letters, digits and whatever is not ASCII.
NOT_SPACE = np.array([not is_space(b) for b in range(256)])
ALNUM = np.array([is_alnum(b) for b in range(256)])
#: Byte values for hashing: as they are, or with A-Z as a-z.
EXACT = _VALUES
FOLDED = _VALUES[[b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]]


def mix(x: np.ndarray) -> np.ndarray:
    """An avalanche step: a one-to-one map of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and made longer on demand."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES + (1 << 17))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * base**i; span_hash() reads a hash of any span from them. For choosing candidates only."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start])


def _placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random number for each pair of a byte's value and its place."""
    return mix(values + mix(place.astype(np.uint64) + np.uint64(0x51ED270B)))


#: Random numbers of the first places, by place * 256 + byte.
_PLACES = 64
_TABLES = {id(v): _placed(v[None, :], np.arange(_PLACES)[:, None]).reshape(-1) for v in (EXACT, FOLDED)}


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and don't overlap. Works on about SLICE_BYTES at a time."""
    size = ends - starts
    reach = np.cumsum(size)
    out = np.zeros(len(size), np.uint64)
    table, k = _TABLES[id(values)], 0
    while k < len(size):
        stop = int(np.searchsorted(reach, reach[k] - size[k] + SLICE_BYTES, "right"))
        if stop <= k:  # one long span
            for a in range(0, int(size[k]), SLICE_BYTES):
                place = np.arange(a, min(a + SLICE_BYTES, int(size[k])))
                out[k : k + 1] += _placed(values[data[starts[k] + place]], place).sum(dtype=np.uint64)
            k += 1
            continue
        some = np.flatnonzero(size[k:stop]) + k
        n = size[some].astype(np.int32)
        begin = np.cumsum(n, dtype=np.int32) - n
        place = np.arange(int(n.sum()), dtype=np.int32)
        first = int(starts[k])
        byte = data[first : int(ends[stop - 1])][np.repeat((starts[some] - first).astype(np.int32) - begin, n) + place]
        place -= np.repeat(begin, n)
        if len(n) and int(n.max()) > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            rest = _placed(values[byte[far]], place[far])
            place[far] = 0
            number = table[place << 8 | byte]
            number[far] = rest
        else:
            number = table[place << 8 | byte]
        if len(n):
            out[some] = np.add.reduceat(number, begin)
        k = stop
    return mix(out + size.astype(np.uint64))


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each span of bytes; spans may overlap."""
    whole = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join(hashlib.blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64)


def text_names(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each whole text."""
    return span_names(data, offsets[:-1], offsets[1:])


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of ``length`` bytes (8 or more): halves are joined by an avalanche step, twice as long each time."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h, m = _VALUES[data], 1
    while m < length:
        step = min(m, length - m)  # the last two halves may overlap
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        m += step
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets where each begins (one more than texts); null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, each slice with at most ``limit`` bytes of text or a single row."""
    n = len(batch)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a longest run of word bytes within one text), and each text's first word
    as an index into them (one more than texts)."""
    w = in_word[data]
    edge = np.zeros(len(w) + 1, bool)
    if len(w):
        edge[1:-1] = w[1:] != w[:-1]
        edge[0], edge[-1] = w[0], w[-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(w))]
        joined = cuts[w[cuts] & w[cuts - 1]]
    else:
        joined = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(joined):  # a word may not reach over the end of its text
        joined = np.unique(joined)
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    return hash_spans(data, starts, ends, values)


def owner(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, by the first; those that reach into the next text are not taken out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = mix(out) + words[j : j + n]
    return mix(out)


def within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of the n k-grams, which lie in one text."""
    text = owner(first)
    return text[:n] == text[k - 1 : k - 1 + n]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer; row i holds the items from offsets[i] to offsets[i + 1]."""
    data = np.ascontiguousarray(data)
    at = np.ascontiguousarray(np.asarray(offsets, np.int64) * data.itemsize, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def map_texts(df: DataFrame, text: str, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, *columns: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Run make() on slices of the named columns and the text; only these columns are read."""
    names = [*dict.fromkeys([*columns, text])]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                out = make(part)
                if out is not None:
                    yield out

    return df.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def packed(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """The named columns and ``packed``: the text's UTF-8 bytes, compressed one by one, for shuffles; null stays null."""
    kinds = dict(df.dtypes)

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, text):
                out = [None if t is None else press.compress(t) for t in part.column(text).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(out, pa.binary())], names=[*columns, "packed"])

    return df.select(*(F.col(f"`{c}`") for c in [*columns, text])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "packed binary"]))


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of a packed column."""
    open_ = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else open_.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())


def map_packed(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, *columns: str, limit: int = SLICE_BYTES) -> DataFrame:
    """As map_texts(), over a packed column; make() gets it as ``text``."""
    names = [*columns, "packed"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "packed", limit // 3):
                opened = pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), unpacked(part.column("packed"))], names=[*columns, "text"])
                for piece in slices(opened, "text", limit):
                    out = make(piece)
                    if out is not None:
                        yield out

    return df.select(*(F.col(c) for c in names)).mapInArrow(run, schema)
