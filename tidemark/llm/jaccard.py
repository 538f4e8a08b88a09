"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Links are pairs with a Jaccard similarity of at least ``percent`` / 100 between the sets of distinct word n-grams.

1. Rows: each text becomes its set of n-gram hashes; equal sets are one row of the matrix (a node) from here on.
2. Blocks: two linked sets differ in at most ``h = floor(size * (100 - percent) / percent)`` n-grams, so if n-grams
   are hashed into ``h + 1 + e`` groups, at least ``1 + e`` groups are equal in both. Sizes are cut into classes no wider
   than the ratio of linked sizes; a set writes the fingerprints of its groups for its own class and the one below.
   Fingerprints are dealt into column blocks, and a task finds, block by block, which nodes share some. A node that
   shares less than ``1 + e``, empty groups aside, has no links. (A set with too many empty groups also writes its
   n-grams with the smallest hashes, as many as a link needs, so that no link rests on empty groups.)
   Connected nodes form a row block.
3. Product: a row block of up to ``block_rows`` nodes and ``block_bytes`` of text is multiplied in one task, which adds
   up overlap counts column by column and discards pairs below the bound that follows from their sizes.
4. Larger row blocks are multiplied by Spark, columns ordered from rare to frequent: a node keeps the columns that a
   link needs and drops out if it has too many n-grams of its own. In each column all nodes meet the one with the
   fewest own n-grams; then only pairs of components that still share a column are counted. Pairs inside a
   component add nothing, so hot groups don't grow with the square of their size.

n-grams and sets are 64-bit numbers (see ``textvec``), taken as equal if these are: a chance of about 2**-64 a pair.
Defined results: null, empty and blank texts have no n-grams and are alone in their class; a text with fewer words
than n has one n-gram, the whole sequence; equal texts and repeated rows share a class; an empty table gives an empty
result; only id and text are read, and survivors() hands the other columns on, whatever their names. Of several rows of
one id each is judged by its own text; a null id is nobody's smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .store import dealt, kept, with_hot_keys

_NEVER = 1 << 30
_SALT = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one text after the other, and where each begins."""
    data, offsets = tv.text_bytes(column)
    starts, ends, first = tv.word_spans(data, offsets, tv.NOT_SPACE)
    words = tv.hash_words(data, starts, ends, tv.FOLDED)
    g = tv.grams(words, n)
    ok = tv.within(first, n, len(g)) if len(g) else np.zeros(0, bool)
    text, value = tv.owner(first)[: len(g)][ok], g[ok]
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    if len(few):
        whole = np.array([tv.mix(np.bitwise_xor.reduce(tv.mix(words[first[k] : first[k + 1]] + np.arange(1, first[k + 1] - first[k] + 1, dtype=np.uint64))[None], axis=1))[0] for k in few], np.uint64)
        text, value = np.concatenate([text, few]), np.concatenate([value, whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(column) + 1))


def nodes_of(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(tv.mix(value ^ _SALT[0]))])
    return tv.mix((total[at[1:]] - total[at[:-1]]) ^ np.diff(at).astype(np.uint64))


def classes(percent: int, most: int = 1 << 31) -> np.ndarray:
    """Where each class of sizes begins."""
    low = [1]
    while low[-1] < most:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


def fingerprints(value: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of its set, kind), and how many keys of kind 0 and 1 each set must share to have links (one row a
    set): kinds 0 and 1 are groups of its own class and of the one below, kind 2 stands in for empty groups."""
    low = classes(percent)
    size = np.diff(at)
    own = np.searchsorted(low, size, "right") - 1
    text = np.repeat(np.arange(len(size)), size)
    hashed, spread = tv.mix(value ^ _SALT[1]), tv.mix(value ^ _SALT[2]) >> np.uint64(33)
    keys, owners, kinds, needs = [], [], [], []
    short = np.zeros(len(size), bool)
    for down in (0, 1):
        scheme = own - down
        differ = np.where((size > 0) & (scheme >= 0), (low[np.maximum(scheme, 0) + 1] - 1) * (100 - percent) // percent, 0)
        spare = 1 + differ // 3
        ok = differ > 0  # otherwise only equal sets are linked
        groups = np.where(ok, differ + 1 + spare, 0)
        mine = ok[text]
        base = np.cumsum(groups) - groups
        slot = base[text[mine]] + (spread[mine].astype(np.int64) * groups[text[mine]] >> 31)
        order = np.argsort(slot, kind="stable")
        slot, part = slot[order], np.concatenate([[np.uint64(0)], np.cumsum(hashed[mine][order])])
        cut = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        used, sums = slot[cut], part[np.append(cut[1:], len(slot))] - part[cut]
        owner = np.searchsorted(base + groups, used, "right")
        number = (used - base[owner]).astype(np.uint64) + (scheme[owner].astype(np.uint64) << np.uint64(32))
        keys.append(tv.mix(sums ^ tv.mix(number + np.uint64(1))))
        owners.append(owner)
        kinds.append(np.full(len(owner), down))
        empty = groups - np.bincount(owner, minlength=len(size))
        needs.append(np.where(ok, np.maximum(1 + spare - empty, 1), _NEVER))
        short |= ok & (empty > spare)
    prefix = size - -(-size * percent // 100) + 1
    rank = np.arange(len(value)) - at[text]  # hashes are sorted within a set
    extra = short[text] & (rank < prefix[text])
    keys.append(tv.mix(value[extra] ^ _SALT[2] ^ _SALT[1]))
    owners.append(text[extra])
    kinds.append(np.full(int(extra.sum()), 2))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds), np.stack(needs, axis=1)


def _key_blocks(docs: DataFrame, text: str, n: int, percent: int, blocks: int) -> DataFrame:
    """(block, node, need, size, key): packed fingerprints of many sets, dealt into column blocks by key. node: hashes,
    with two numbers each in need; size: how many keys of each kind follow."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch | None:
        value, at = gram_sets(part.column(text), n)
        (value, at), node = _first_of_each(value, at, nodes_of(value, at))
        key, owner, kind, need = fingerprints(value, at, percent)
        if not len(key):
            return None
        block = ((key >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((kind, owner, block))
        key, owner, kind, block = key[order], owner[order], kind[order], block[order]
        pair = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])]))
        which = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(key))))
        count = np.bincount(which * 3 + kind, minlength=3 * len(pair)).reshape(-1, 3).astype(np.uint32)
        b = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        low = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        pairs_at = np.append(np.searchsorted(pair, b), len(pair))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(block[b].astype(np.int32)),
                tv.binary(node[owner[pair]], pairs_at),
                tv.binary(need[owner[pair]].astype(np.int32).reshape(-1), 2 * pairs_at),
                tv.binary(count.reshape(-1), 3 * pairs_at),
                tv.binary(low.reshape(-1), np.append(b, len(key)) * 5),
            ],
            names=["block", "node", "need", "size", "key"],
        )

    return tv.map_texts(docs, text, make, "block int, node binary, need binary, size binary, key binary", limit=1 << 20)


def _first_of_each(value: np.ndarray, at: np.ndarray, node: np.ndarray):
    """Sets without their repetitions within a slice."""
    keep = np.zeros(len(node), bool)
    keep[np.unique(node, return_index=True)[1]] = True
    size = np.diff(at)
    return (value[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])), node[keep]


def _shared(table: pa.Table) -> pa.Table:
    """One column block: (lead, node, need0, need1, k0, k1, k2), for each node how many keys of each kind it shares with
    others, by the smallest node of all that have the key."""
    unpack = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    count = unpack("size", np.uint32).reshape(-1, 3).astype(np.int64)
    need = unpack("need", np.int32).reshape(-1, 2)
    entry = np.repeat(np.arange(len(count)), count.sum(axis=1))
    kind = np.repeat(np.tile(np.arange(3), len(count)), count.reshape(-1))
    node = unpack("node", np.uint64)
    wide = np.zeros((len(entry), 8), np.uint8)
    wide[:, :5] = unpack("key", np.uint8).reshape(-1, 5)
    key = wide.reshape(-1).view("<u8")
    order = np.lexsort((node[entry], key))
    key, entry, kind = key[order], entry[order], kind[order]
    name = node[entry]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])]) if len(key) else np.zeros(0, bool)
    key, entry, kind, name = key[fresh], entry[fresh], kind[fresh], name[fresh]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    lead, many = np.repeat(name[begin], size), np.repeat(size > 1, size)
    lead, entry, kind, name = lead[many], entry[many], kind[many], name[many]
    order = np.lexsort((name, lead))
    lead, entry, kind, name = lead[order], entry[order], kind[order], name[order]
    new = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (name[1:] != name[:-1])])) if len(lead) else np.zeros(0, np.int64)
    ks = [np.add.reduceat((kind == k).astype(np.int64), new) if len(new) else np.zeros(0, np.int64) for k in range(3)]
    return pa.table({"lead": tv.signed(lead[new]), "node": tv.signed(name[new]), "need0": need[entry[new], 0], "need1": need[entry[new], 1], **{f"k{k}": v for k, v in enumerate(ks)}})


def _candidates(shared: DataFrame) -> DataFrame:
    """(a, b): nodes that share as much as links need, tied through the smallest node of each key."""
    enough = shared.groupBy("node").agg(*(F.sum(f"k{k}").alias(f"k{k}") for k in range(3)), F.min("need0").alias("need0"), F.min("need1").alias("need1"))
    enough = enough.where("k0 >= need0 or k1 >= need1 or k2 > 0").select("node")
    return shared.where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct().join(enough.withColumnRenamed("node", "b"), "b", "left_semi")


def _product(percent: int, n: int):
    """Row blocks of one task: (node, root), the smallest node that links reach."""

    def run(table: pa.Table) -> pa.Table:
        name = np.asarray(table.column("node").combine_chunks())
        block = np.asarray(table.column("cluster").combine_chunks())
        order = np.lexsort((name, block))
        table, name, block = table.take(pa.array(order)), name[order], block[order]
        root = name.copy()
        begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(block)], strict=True):
            value, at = gram_sets(tv.unpacked(table.column("packed").slice(a, b - a)), n)
            root[a:b] = name[a:b][_linked(value, at, percent)]
        return pa.table({"node": name, "root": root})

    return run


def _linked(value: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """For each set of a row block the first set that links reach. Overlaps add up column by column: frequent columns
    as dense strips, the others as lists of cells."""
    m, size = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(m), size)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    df = np.diff(np.append(begin, len(value)))
    overlap = np.zeros((m, m), np.int32)
    dense = np.flatnonzero((df > 16) & (df * 8 >= m))
    for part in np.array_split(dense, -(-len(dense) // 512) or 1):
        strip = np.zeros((m, len(part)), np.float32)
        for k, c in enumerate(part.tolist()):
            strip[row[begin[c] : begin[c] + df[c]], k] = 1
        overlap += (strip @ strip.T).astype(np.int32)
    df[dense] = 0
    for k in np.unique(df[df > 1]).tolist():  # all columns with k entries at once
        column = row[begin[df == k][:, None] + np.arange(k)]
        for part in np.array_split(column, max(1, column.size * k >> 20)):
            np.add.at(overlap.reshape(-1), (part[:, :, None] * m + part[:, None, :]).reshape(-1), 1)
    linked = np.empty((m, m), bool)
    for a in range(0, m, 256):
        linked[a : a + 256] = (100 + percent) * overlap[a : a + 256].astype(np.int64) >= percent * (size[a : a + 256, None] + size[None, :])
    root = np.arange(m)
    while True:
        low = np.concatenate([np.where(linked[a : a + 256], root[None, :], m).min(axis=1) for a in range(0, m, 256)]) if m else root
        low = np.minimum(low, root)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose rows overlap enough."""
    a = rows.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    b = rows.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    overlap = F.size(F.array_intersect("ga", "gb")).cast("long")
    return pairs.join(a, "a").join(b, "b").where((100 + percent) * overlap >= percent * (F.size("ga") + F.size("gb"))).select("a", "b")


def links(rows: DataFrame, percent: int) -> DataFrame:
    """(node, root) for nodes with links; rows: (node, grams), each node once, all of which may be linked."""
    n = F.size("grams").cast("long")
    entry = rows.select("node", n.alias("n"), F.explode("grams").alias("gram"))
    often = entry.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    column = (
        entry.join(often, "gram")
        .groupBy("node", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("c"))
        .withColumn("own", F.col("n") - F.size("c"))
        .withColumn("keep", (prefix - F.col("own")).cast("int"))
        .where("keep > 0")
        .select("node", "n", "own", F.explode(F.slice("c", 1, F.col("keep"))).alias("e"))
        .select("e.gram", "node", "n", "own")
    )
    column = kept(column)
    lead = column.groupBy("gram").agg(F.min(F.struct("own", "node", "n")).alias("p"), F.count("*").alias("k")).where("k > 1").select("gram", "p")
    bound = (100 + percent) * F.least(F.col("n") - F.col("own"), F.col("p.n") - F.col("p.own")) >= percent * (F.col("n") + F.col("p.n"))
    met = column.join(lead, "gram")
    stars = met.where((F.col("node") != F.col("p.node")) & bound).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
    first = kept(_verified(stars, rows, percent))
    root = components(first)
    named = met.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = root.select(F.col("node").alias("pn"), F.col("root").alias("proot"))
    named = named.join(heads, F.col("p.node") == F.col("pn"), "left").withColumn("proot", F.coalesce("proot", "p.node"))
    apart = kept(named.select("gram", "node", "n", "own", "root", "proot"))
    left = apart.where("root <> proot").select("gram", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "own", "root")))
    right = apart.select("gram", "node", "n", "own", "root")
    bound = (100 + percent) * F.least(F.col("n") - F.col("own"), F.col("x_n") - F.col("x_own")) >= percent * (F.col("n") + F.col("x_n"))
    rest = left.join(right, (left.gram == right.gram) & (F.col("root") != F.col("x_root")) & bound).select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct()
    return components(first.union(_verified(rest, rows, percent)))


def classes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, blocks: int | None = None, block_rows: int = 3000, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, hash (of the text), n_grams, component_id and root of each row; root names the class and is null without
    n-grams, whatever the ids are."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]

    def describe(part: pa.RecordBatch) -> pa.RecordBatch:
        value, at = gram_sets(part.column("text"), n)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "hash", "size")), pa.array(np.diff(at)), pa.array(tv.signed(nodes_of(value, at)))], names=["doc_id", "hash", "size", "n_grams", "node"])

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        value, at = gram_sets(part.column("text"), n)
        return pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tv.signed(value)))], names=["node", "grams"])

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("hash", F.xxhash64("text"))
    sized = slim.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    all_docs = kept(tv.map_texts(sized, "text", describe, f"doc_id {kind}, hash long, size long, n_grams long, node long", "doc_id", "hash", "size"))
    total = all_docs.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    blocks = blocks or dealt(spark, total.bytes)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "size")  # null ids last
    rep = all_docs.where("n_grams > 0").groupBy("node").agg(F.min(first).alias("rep"), F.count("*").alias("copies")).select("node", "rep.doc_id", "rep.hash", "rep.size", "copies")
    rep = kept(rep)
    shared = kept(_key_blocks(docs, text, n, percent, blocks).groupBy("block").applyInArrow(_shared, "lead long, node long, need0 int, need1 int, k0 long, k1 long, k2 long"))
    cluster = components(_candidates(shared)).withColumnRenamed("root", "cluster").join(rep, "node")
    small = cluster.groupBy("cluster").agg(F.expr(f"count(*) <= {block_rows} and sum(size) <= {block_bytes}").alias("small"))
    wanted = kept(cluster.join(small, "cluster"))
    packed = tv.packed(slim, "text", "doc_id", "hash")
    mine = wanted.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "node", "cluster", "small")
    texts = packed.join(mine, packed.doc_id.eqNullSafe(F.col("_id")) & (packed.hash == F.col("_hash"))).dropDuplicates(["node"])
    texts = kept(texts.select("node", "cluster", "small", "packed"))
    inside = texts.where("small").groupBy(F.pmod(F.hash("cluster"), F.lit(blocks)).alias("block")).applyInArrow(_product(percent, n), "node long, root long")
    rows = kept(tv.map_packed(texts.where("not small"), sets, "node long, grams array<long>", "node"))
    root = inside if rows.isEmpty() else inside.union(links(rows, percent))
    root = kept(root.join(wanted.select("node", "doc_id"), "node"))
    least = root.groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = root.join(least, "root").select("node", "root", "least")
    named = kept(rep.join(linked, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("least", "doc_id").alias("component")))
    some, none = all_docs.where("n_grams > 0"), all_docs.where("n_grams = 0")
    some = with_hot_keys(some, named, "node", "copies", total.rows).select("doc_id", "hash", "n_grams", F.col("component").alias("component_id"), "root")
    return some.unionByName(none.select("doc_id", "hash", "n_grams", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_grams and component_id (the smallest id that links reach) of each row; options as of classes_of()."""
    return classes_of(docs, doc_id, **options).select("doc_id", "n_grams", "component_id")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, less near duplicates: of each class the row of the smallest id stays (null ids come
    last; of clashing ids, the one of the smallest text hash; of repeated rows, one). Rows without n-grams stay."""
    made = kept(classes_of(docs, doc_id, text, **options))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    stay = made.where("root is not null").groupBy("root").agg(F.min(key).alias("k")).select("k.doc_id", "k.hash")
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = lambda other: rows._id.eqNullSafe(other.doc_id) & (rows._hash == other.hash)
    often = made.where("root is not null").groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    stay = kept(stay.join(often, stay.doc_id.eqNullSafe(often.doc_id) & (stay.hash == often.hash)).select(stay.doc_id, stay.hash, "n"))
    few, many = stay.where("n = 1"), stay.where("n > 1")  # rows of one id and text are repetitions: one stays
    bare = kept(made.where("root is null").select("doc_id", "hash").distinct())
    out = rows.join(few, same(few), "left_semi").union(rows.join(bare, same(bare), "left_semi"))
    return out.union(rows.join(many, same(many), "left_semi").dropDuplicates(["_id", "_hash"])).select("row.*")
