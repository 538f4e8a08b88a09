"""Exact removal of repeated substrings by blockwise suffix sorting with ranks of a sample.

Bytes covered by a ``length``-byte string that also starts anywhere else (same text included) are removed.
Suffixes are compared to a depth of ``length`` bytes, one bucket at a time, so that memory is bounded by a bucket.

1. Texts that occur more than once are counted by name; all their strings repeat. One of each goes on.
2. The anchor of a suffix is the smallest ``gram``-byte hash in its first ``length`` bytes; equal strings have equal anchors at
   equal offsets. A run of suffixes with one anchor is a block; blocks go to suffix buckets by anchor, with a name of
   all the bytes that their suffixes reach. Blocks of one name repeat as a whole, and one of them goes on for all.
3. Where blocks share an anchor and the bytes to the left or right of it, but not the name, their bytes are brought together
   and their suffixes are sorted, some anchors at a time. The bytes are laid out so that anchors fall on one residue modulo
   ``PERIOD``; a cover of sample positions, every ``PERIOD`` bytes, is ranked first, by doubling. A suffix is sorted by its first
   ``PERIOD`` bytes, and ties by the rank of the first sample after its start, which is at the same distance in any suffix
   that could be equal. Neighbours in this order are compared byte by byte; equal ones repeat.
4. Suffixes that repeat become spans, spans are joined to the texts, and the bytes are cut.

A plain difference cover has to bring any two suffixes to a common sample, whatever their residues, so it samples several
positions of a period and carries them for all bytes; aligned anchors leave one difference, zero, and one sample a period.
Names (BLAKE2) stand for whole texts and blocks, shortened to what, with the anchor, makes 80 bits; what is sorted is bytes.
Defined results: null and empty texts have no bytes and nothing removed; repeated rows and ids are repetitions of
each other; very long texts count whole; null and clashing ids are kept apart by their texts; an empty table gives an
empty result; other columns are not read, and cut_texts() hands them on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import dealt, kept, with_hot_keys, written

LENGTH = 200
GRAM = 64
PERIOD = 32
#: About so many bytes of blocks are sorted at a time.
SORT_BYTES = 2 << 20
SETTLED, OPEN, PROBE = 0, 1, 2


def window_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the place of its smallest (the first of equals), by running minima of blocks."""
    bits = max(24, int(len(values)).bit_length())
    n = len(values)
    size = -(-n // w) * w
    x = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = (values >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    ahead = np.minimum.accumulate(x.reshape(-1, w), axis=1).reshape(-1)
    back = np.minimum.accumulate(x.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    best = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    return (best & np.uint64((1 << bits) - 1)).astype(np.int64)


def anchor_blocks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, ranked: bool = True):
    """Blocks of suffixes with one anchor: text, first and last start, anchor hash, rank of all that they reach, and hashes
    of the anchor with half of what a string has besides it, to the left and to the right: equal strings share one of
    these (past the end of a text they are the block's own). Places are within the slice. Without ``ranked``, the
    anchor's place is in the rank's stead."""
    prefix = tv.prefix_hash(tv.EXACT[data])
    n = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, *[none.astype(np.uint64)] * 4
    at = np.arange(n - gram + 1)
    grams = tv.span_hash(prefix, at, at + gram)
    anchor = window_argmin(grams, length - gram + 1)
    start = np.arange(len(anchor))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    ok = np.flatnonzero(start + length <= offsets[text + 1])
    start, anchor, text = start[ok], anchor[ok], text[ok]
    if not len(start):
        return none, none, none, *[none.astype(np.uint64)] * 4
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    lo, hi, anchor, text = start[cut], start[np.append(cut[1:], len(start)) - 1], anchor[cut], text[cut]
    if not ranked:
        return text, lo, hi, grams[anchor], anchor, none, none
    rank = tv.span_names(data, lo, hi + length)
    half = (length - gram) // 2
    left, right = np.maximum(anchor - half, offsets[text]), np.minimum(anchor + gram + length - gram - half, offsets[text + 1])
    sides = []
    for a, b, whole in ((left, anchor + gram, anchor - left == half), (anchor, right, right - anchor == length - half)):
        sides.append(np.where(whole, tv.span_hash(prefix, a, b), tv.mix(rank ^ np.uint64(len(sides) + 1))))
    return text, lo, hi, grams[anchor], rank, *sides


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(sorted_keys)))


def _pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Rows (bucket, one binary per column), each with all entries of a bucket; entries are in bucket order."""
    if not len(bucket):
        return None
    begin, _ = _groups(bucket)
    at = np.append(begin, len(bucket))
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), *(tv.binary(v, at) for v in columns.values())], names=["bucket", *columns])


_BLOCKS = {"anchor": np.uint32, "rank": "V6", "text": np.uint64, "lo": np.int32, "n": np.uint16, "left": "V3", "right": "V3"}
_OPEN = {"anchor": np.uint32, "text": np.uint64, "lo": np.int32, "n": np.uint16, "at": np.uint16, "open": np.uint8}
_FOUND = "text long, code long"  # lo << 18 | hi - lo << 2 | kind


def _unpack(table: pa.Table, kinds: dict) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in kinds.items()}


def _short(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of 64-bit numbers."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).view(f"V{size}").reshape(-1)


def _wide(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :size] = x.view(np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def _block_rows(docs: DataFrame, text: str, buckets: int, length: int, gram: int) -> DataFrame:
    """Packed blocks by bucket; blocks that are settled within their slice go to buckets from ``buckets`` on."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = tv.text_bytes(part.column(text))
        name = tv.text_names(data, offsets)
        owner, lo, hi, anchor, rank, left, right = anchor_blocks(data, offsets, length, gram)
        if not len(lo):
            return None
        first = np.zeros(len(name), bool)
        first[np.unique(name, return_index=True)[1]] = True
        ok = first[owner]
        owner, n, anchor, rank = owner[ok], (hi - lo)[ok], (anchor[ok] >> np.uint64(32)).astype(np.uint32), rank[ok]
        left, right = left[ok], right[ok]
        lo = lo[ok] - offsets[owner]
        order = np.argsort(rank, kind="stable")
        begin, size = _groups(rank[order])
        settled = order[np.repeat(size > 1, size)]
        goes = order[begin]  # one of each rank
        place = np.concatenate([anchor[goes] % np.uint32(buckets), buckets + anchor[settled] % np.uint32(buckets)]).astype(np.int64)
        rows = np.concatenate([goes, settled])
        order = np.argsort(place, kind="stable")
        rows = rows[order]
        return _pack(place[order], {"anchor": anchor[rows], "rank": _short(rank[rows], 6), "text": name[owner[rows]], "lo": lo[rows].astype(np.int32), "n": n[rows].astype(np.uint16), "left": _short(left[rows], 3), "right": _short(right[rows], 3)})

    return tv.map_texts(docs, text, make, "bucket int, anchor binary, rank binary, text binary, lo binary, n binary, left binary, right binary", limit=1 << 20)


def _classify(buckets: int):
    """One bucket: blocks whose name occurs twice are settled; of mixed anchors, the rest is open, and one block of
    each settled name helps to decide."""

    def run(table: pa.Table) -> pa.Table:
        x = _unpack(table, _BLOCKS)
        kind = np.full(len(x["lo"]), SETTLED, np.int8)
        if table.column("bucket")[0].as_py() < buckets:
            x["rank"] = _wide(x["rank"], 6)
            order = np.lexsort((x["lo"], x["text"], x["rank"], x["anchor"]))
            x = {k: v[order] for k, v in x.items()}
            same = (x["rank"][1:] == x["rank"][:-1]) & (x["anchor"][1:] == x["anchor"][:-1])
            fresh = np.concatenate([[True], ~same | (x["text"][1:] != x["text"][:-1]) | (x["lo"][1:] != x["lo"][:-1])])
            x = {k: v[fresh] for k, v in x.items()}
            same = (x["rank"][1:] == x["rank"][:-1]) & (x["anchor"][1:] == x["anchor"][:-1])
            ranks = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(ranks, len(x["rank"])))
            anchors, many = _groups(x["anchor"])
            differ = np.repeat(np.diff(np.append(np.searchsorted(ranks, anchors), len(ranks))) > 1, many)
            differ &= _shared(x["anchor"], _wide(x["left"], 3)) | _shared(x["anchor"], _wide(x["right"], 3))
            twice = np.repeat(size > 1, size)
            probe = np.zeros(len(twice), bool)
            probe[ranks] = True
            keep, extra = twice | differ, twice & differ & probe
            kind = np.concatenate([np.where(twice, SETTLED, OPEN)[keep], np.full(int(extra.sum()), PROBE)]).astype(np.int8)
            x = {k: np.concatenate([v[keep], v[extra]]) for k, v in x.items()}
        code = x["lo"].astype(np.int64) << 18 | x["n"].astype(np.int64) << 2 | kind
        return pa.table({"text": tv.signed(x["text"].astype(np.uint64)), "code": code})

    return run


def _shared(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which blocks have an anchor and side that another one has."""
    both = tv.mix(anchor.astype(np.uint64) << np.uint64(24) | side)
    return np.isin(both, both[np.setdiff1d(np.arange(len(both)), np.unique(both, return_index=True)[1])])


def _runs(at: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Where runs of consecutive places in one block begin."""
    return np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (block[1:] != block[:-1])])) if len(at) else np.zeros(0, np.int64)


def _open_rows(found: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Open and probe blocks with the bytes that their suffixes reach, by the anchor's bucket."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch | None:
        codes = part.column("blocks")
        own = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(codes)))
        code = np.asarray(codes.flatten()).astype(np.int64)
        use = np.flatnonzero(code & 3 != SETTLED)
        if not len(use):
            return None
        own, lo, n, kind = own[use], code[use] >> 18, code[use] >> 2 & 0xFFFF, code[use] & 3
        data, offsets = tv.text_bytes(part.column("text"))
        _, begins, _, anchors, places, *_ = anchor_blocks(data, offsets, length, gram, ranked=False)
        which = np.searchsorted(begins, lo + offsets[own])
        anchor = (anchors[which] >> np.uint64(32)).astype(np.uint32)
        bucket = (anchor % np.uint32(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, lo, n, kind, which, anchor, bucket = (x[order] for x in (own, lo, n, kind, which, anchor, bucket))
        size = n + length
        ends = np.cumsum(size)
        each = np.repeat(lo + offsets[own] - (ends - size), size) + np.arange(int(ends[-1]))
        name = np.asarray(part.column("name")).astype(np.int64).view(np.uint64)[own]
        begin, _ = _groups(bucket)
        at_row = np.append(begin, len(bucket))
        columns = {"anchor": anchor, "text": name, "lo": lo.astype(np.int32), "n": n.astype(np.uint16), "at": (places[which] - begins[which]).astype(np.uint16), "open": (kind == OPEN).astype(np.uint8)}
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[begin].astype(np.int32)), *(tv.binary(v, at_row) for v in columns.values()), tv.binary(data[each], np.concatenate([[0], ends])[at_row])],
            names=["bucket", *columns, "data"],
        )

    return tv.map_packed(found, make, "bucket int, " + ", ".join(f"{c} binary" for c in _OPEN) + ", data binary", "name", "blocks", limit=1 << 19)


def _dense_ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks of rows from their order by the keys; equal rows have equal ranks."""
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """The lexicographic rank of what begins at each multiple of PERIOD, to ``depth`` bytes at least: ranks of PERIOD bytes are
    doubled by the ranks of what follows. The length of data is a multiple of PERIOD."""
    words = data.reshape(-1, PERIOD).view(">u8").astype(np.uint64).T
    rank = _dense_ranks(np.lexsort(words[::-1]), *words)
    step = 1
    while step * PERIOD < depth:
        then = np.full(len(rank), -1)
        then[: max(len(rank) - step, 0)] = rank[step:]
        rank = _dense_ranks(np.lexsort((then, rank)), rank, then)
        step *= 2
    return rank


def equal_suffixes(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in sorted order, and whether each has the first ``length`` bytes of the one before it. Ones that can be
    equal start at the same residue modulo PERIOD."""
    room = -(-(len(data) + length + 2 * PERIOD) // PERIOD) * PERIOD
    padded = np.zeros(room, np.uint8)
    padded[: len(data)] = data
    rank = sample_ranks(padded, length)
    byte = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = lambda at: byte[at].view(">u8").reshape(-1).astype(np.uint64)
    keys = [word(start + k) for k in range(0, PERIOD, 8)]
    order = np.lexsort((rank[-(-start // PERIOD)], start % PERIOD, *keys[::-1]))
    same = np.zeros(len(order), bool)
    same[1:] = True
    for k in keys:
        same[1:] &= k[order[1:]] == k[order[:-1]]
    same[1:] &= (start[order[1:]] - start[order[:-1]]) % PERIOD == 0
    for k in [*range(PERIOD, length - 8, 8), length - 8]:  # the rest, where all before is equal
        pair = np.flatnonzero(same)
        same[pair] = word(start[order[pair]] + k) == word(start[order[pair - 1]] + k)
    return order, same


def _sort(length: int, at_once: int):
    """One bucket of blocks: the open suffixes that occur at another place too, as runs. Some anchors at a time."""

    def run(table: pa.Table) -> pa.Table:
        x = _unpack(table, _OPEN)
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        size = x["n"].astype(np.int64) + length
        from_ = np.cumsum(size) - size
        order = np.argsort(x["anchor"], kind="stable")
        begin, many = _groups(x["anchor"][order])
        reach = np.cumsum(np.add.reduceat(size[order], begin)) if len(begin) else begin
        out: list[list] = [[], [], []]
        k = 0
        while k < len(begin):
            stop = max(k + 1, int(np.searchsorted(reach, (reach[k - 1] if k else 0) + at_once, "right")))
            mine = order[begin[k] : begin[stop - 1] + many[stop - 1]]
            k = stop
            if len(mine) < 2:
                continue
            # each block begins so that its anchor is at a multiple of the period
            lead = -x["at"][mine].astype(np.int64) % PERIOD
            room = -(-(lead + size[mine]) // PERIOD) * PERIOD
            base = np.cumsum(room) - room + lead
            laid = np.zeros(int(room.sum()), np.uint8)
            inner = np.arange(int(size[mine].sum())) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
            laid[np.repeat(base, size[mine]) + inner] = data[np.repeat(from_[mine], size[mine]) + inner]
            n = x["n"][mine].astype(np.int64) + 1
            block = np.repeat(np.arange(len(mine)), n)
            place = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
            ranked, same = equal_suffixes(laid, base[block] + place, length)
            group = np.empty(len(block), np.int64)
            group[ranked] = np.cumsum(~same)
            text, at = x["text"][mine][block], x["lo"][mine].astype(np.int64)[block] + place
            by = np.lexsort((at, text, group))
            head, count = _groups(group[by])
            a, b = by[head], by[head + count - 1]
            twice = np.zeros(len(block), bool)
            twice[by] = np.repeat((text[a] != text[b]) | (at[a] != at[b]), count)
            good = twice & (x["open"][mine][block] > 0)
            text, at = text[good], at[good]
            by = np.lexsort((at, text))
            text, at = text[by], at[by]
            cut = _runs(at, text)
            for o, v in zip(out, (tv.signed(text[cut]), at[cut].astype(np.int32), at[np.append(cut[1:], len(at)) - 1 if len(at) else cut].astype(np.int32)), strict=True):
                o.append(v)
        kinds = (np.int64, np.int32, np.int32)
        return pa.table({c: np.concatenate([np.zeros(0, t), *v]) for c, v, t in zip(("text", "lo", "hi"), out, kinds, strict=True)})

    return run


def merged(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings of this length starting from lo to hi cover."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[new], reach[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: every row's (doc_id, n_bytes, name, copies, whole_sha256), name being the hash of its text; and
    for names with repeated strings (name, packed, runs): the packed text, and the first and last starts of runs of
    such strings."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]

    def describe(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tv.text_bytes(part.column("text"))
        name = tv.signed(tv.text_names(data, offsets))
        sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(np.diff(offsets)), pa.array(name), pa.array(sha, pa.string())], names=["doc_id", "hash", "n_bytes", "name", "whole_sha256"])

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("hash", F.xxhash64("text"))
    all_docs = kept(tv.map_texts(slim, "text", describe, f"doc_id {kind}, hash long, n_bytes long, name long, whole_sha256 string", "doc_id", "hash"))
    total = all_docs.agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes")).first()
    buckets = buckets or dealt(spark, total.bytes)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")  # null ids last
    copies = kept(all_docs.groupBy("name").agg(F.count("*").alias("copies"), F.min(first).alias("rep")))
    blocks = _block_rows(docs, text, buckets, length, gram).groupBy("bucket").applyInArrow(_classify(buckets), _FOUND)
    lists = blocks.groupBy(F.col("text").alias("name")).agg(F.collect_set("code").alias("blocks"))
    # a text with copies repeats as a whole; its blocks only help to decide
    wanted = lists.join(copies, "name").withColumn("blocks", F.when(F.col("copies") > 1, F.filter("blocks", lambda b: b.bitwiseAND(3) != SETTLED)).otherwise(F.col("blocks")))
    # the rows that stand for their texts, by id, whether it is null, and hash: repeated rows meet where they are joined
    key = lambda c: {"_k": F.coalesce(c.cast("string"), F.lit("")), "_n": c.isNull()}
    wanted = wanted.where("size(blocks) > 0").select("name", F.col("rep.hash").alias("hash"), *(c.alias(k) for k, c in key(F.col("rep.doc_id")).items()), "blocks")
    packed = tv.packed(slim, "text", "doc_id", "hash").withColumns(key(F.col("doc_id"))).select("_k", "_n", "hash", "packed")
    found = packed.join(wanted, ["_k", "_n", "hash"]).dropDuplicates(["_k", "_n", "hash", "name"])
    found = kept(found.select("name", "packed", "blocks"))
    more = _open_rows(found, buckets, length, gram).groupBy("bucket").applyInArrow(_sort(length, SORT_BYTES), "text long, lo int, hi int")
    more = more.groupBy(F.col("text").alias("name")).agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    settled = F.expr(f"transform(filter(blocks, b -> b & 3 = {SETTLED}), b -> struct(int(shiftright(b, 18)) as lo, int(shiftright(b, 18) + (shiftright(b, 2) & 65535)) as hi))")
    spans = found.join(more, "name", "left").select("name", "packed", F.concat(settled, F.coalesce("more", F.array().cast("array<struct<lo:int,hi:int>>"))).alias("runs"))
    return with_hot_keys(all_docs, copies.select("name", "copies"), "name", "copies", total.rows), spans.where("size(runs) > 0")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of each row; ``with_text`` adds hash
    (xxhash64 of the text) and kept_text, the remaining bytes as a string: null where nothing was removed; a character
    cut in two goes."""
    all_docs, spans = repeated_spans(docs, doc_id, text, length, gram, buckets)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tv.text_bytes(part.column("text"))
        out: list[list] = [[], [], [], []]
        for k, runs in enumerate(part.column("runs").to_pylist()):
            lo, hi = np.array([r["lo"] for r in runs]), np.array([r["hi"] for r in runs])
            begin, end = merged(lo, hi, length)
            mine = data[offsets[k] : offsets[k + 1]]
            gone = np.zeros(len(mine) + 1, np.int32)
            gone[begin] += 1
            gone[end] -= 1
            rest = mine[np.cumsum(gone)[:-1] == 0].tobytes()
            for x, v in zip(out, (int((end - begin).sum()), len(begin), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None), strict=True):
                x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([part.column("name"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["name", "n_removed", "n_spans", "sha", "kept_text"])

    done = tv.map_packed(spans, cut, "name long, n_removed long, n_spans long, sha string, kept_text string", "name", "runs")
    whole = F.expr(f"copies > 1 and n_bytes >= {length}")
    return all_docs.join(done, "name", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
        *["hash", F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] * with_text,
    )


def cut_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: str = "n_chars", **options) -> DataFrame:
    """The rows of docs, all columns, with what repeats cut from their texts and, if there is such a column, ``size`` set
    to the characters left. Texts of which nothing is left go; rows without repetitions, null and empty texts stay as
    they are. Of several rows of one id each keeps its own text."""
    done = without_repeats(docs, doc_id, text, with_text=True, **options).where("n_removed > 0").select("doc_id", "hash", "kept_text")
    done = written(done.dropDuplicates(["doc_id", "hash"]))
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = rows.join(done, rows._id.eqNullSafe(done.doc_id) & (rows._hash == done.hash), "left").where("kept_text is null or kept_text <> ''")
    new = {text: F.col("kept_text"), size: F.length("kept_text").cast(dict(docs.dtypes).get(size, "long"))}
    was = lambda c: F.col("row").getField(c)
    return out.select(*(F.when(F.col("kept_text").isNotNull(), new[c]).otherwise(was(c)).alias(c) if c in new else was(c).alias(c) for c in docs.columns))
