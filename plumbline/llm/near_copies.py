"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``PERCENT`` or more.

Shingles: words as in simhash, ``WORDS`` to a shingle; a text of fewer words is one
shingle, also when it has none. Texts of equal shingle sets are one node.

Candidates: the least of a node's shingles under each of ``BANDS * ROWS`` hash
orders; nodes that agree on all ``ROWS`` of a band share a bucket. A pair of
similarity s shares none with probability ``(1 - s**ROWS)**BANDS``: 6e-6 at 0.8,
8e-14 at 0.9. Each candidate pair is then judged by its full shingle sets.

While a bucket's open pairs (of nodes that no link has joined so far) are many, its
nodes are compared with one of them, the one that meets most others in all its
buckets, which then leaves the bucket; so a large group comes together around its
middle by few pairs. That ends after ``STARS`` rounds, or with the first that links
few of its pairs: what shares buckets then is mostly too far apart, and another round
would only go over the same rows. What is open then is found by prefixes: with
the shingles of each set ordered alike, the common ones last, two similar sets share
one of their first few, and a first shared one stands early enough in both to leave
room for the shingles that they need in common. That holds for any order and loses no
pair; texts of a group that are too far apart differ in rare shingles, which come
first, so they don't meet. No pair of a bucket goes unjudged unless its nodes are
already in one component. SimHash links are taken in as well.

Before the sets are fetched, pairs are dropped that can't be similar by their sizes, or
because a bitmap of the shingles differs in more bits than the sets may in shingles.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.common import BROADCAST_ROWS, Scratch, is_empty
from plumbline.llm.components import connected_components

WORDS = 5
PERCENT = 80
BANDS = 40
ROWS = 6
#: Rounds of comparing with one node a bucket, at most; none while the pairs are few.
STARS = 4
#: A round is the last if it links less than one in so many of its pairs.
SPENT = 10
#: Pairs are few when there are at most this many a row of a bucket.
FEW = 4
#: Bits of a set's bitmap.
BITMAP = 1024
#: Shingles of at least this many open nodes are common, the most common ``MOST`` of them at most; the order alone hangs on it.
COMMON = 8
MOST = 1 << 20
_BLOCK = 2048
_MIX = np.array([[xxhash.xxh32_intdigest(f"{kind}{i}") for i in range(BANDS * ROWS)] for kind in "xm"], dtype=np.uint32)
_XOR, _MUL = _MIX[0][:, None], (_MIX[1] | np.uint32(1))[:, None]


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles' XXH64 values (seed 42), sorted."""
    words = text.translate(simhash._LOWER).split()
    n = max(1, len(words) - WORDS + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype=np.uint64, count=n))


def bands(shingle_set: np.ndarray) -> np.ndarray:
    """The node's bucket in each band."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), _BLOCK):
        low = np.minimum(low, ((x[None, i : i + _BLOCK] ^ _XOR) * _MUL).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def bitmap(shingle_set: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the shingles by ``BITMAP``, as longs."""
    bits = np.zeros(BITMAP, dtype=bool)
    bits[(shingle_set % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _bytes(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _rows(docs: DataFrame, text_col: str, id_col: str, shingle: int) -> DataFrame:
    """``(id_col, key, fp, node, n, bits, buckets)`` for every row; ``n``: the shingles of its set."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, key bigint, fp bigint, node bigint, n bigint, bits array<bigint>, buckets array<bigint>"
    names = [id_col, "key", "fp", "node", "n", "bits", "buckets"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                fps, nodes, sizes, bits, keys = [], [], [], [], []
                for t in map(_bytes, some.column(2)):
                    own = shingles(t)
                    fps.append(simhash.fingerprint(t, shingle))
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                    sizes.append(len(own))
                    bits.append(bitmap(own))
                    keys.append(bands(own))
                long = lambda a: pa.array(np.array(a, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), long(fps), long(nodes), long(sizes), _lists(bits), _lists(keys)], names=names)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), F.xxhash64(text), text).mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """``(node, set)`` of the nodes ``wanted(node, key)``, of one text each."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                found = _lists([shingles(_bytes(t)).view(np.int64) for t in some.column(1)])
                yield pa.RecordBatch.from_arrays([some.column(0), found], names=["node", "set"])

    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(_sent(wanted), "key").groupBy("node").agg(F.first("text").alias("text"))
    return scratch.keep(texts.select("node", "text").mapInArrow(run, "node bigint, set array<bigint>"), "sets")


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _may_be_similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs(u, v)`` without those that sizes or bitmaps rule out."""
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"{end}n"), F.col("bits").alias(f"{end}b"))
    both = of("u").join(_sent(pairs), "u").join(of("v"), "v").where(f"100 * least(un, vn) >= {PERCENT} * greatest(un, vn)")
    differ = F.expr("aggregate(zip_with(ub, vb, (a, b) -> bit_count(a ^ b)), 0, (s, x) -> s + x)")
    return both.where((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("un") + F.col("vn"))).select("u", "v")


def _similar(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets are similar."""
    pairs = scratch.keep(_may_be_similar(pairs, nodes), "pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = scratch.keep(nodes.select("node", "key").join(_sent(ends), "node"), "wanted")
    sets = _sets(docs, wanted, text_col, scratch)
    left = sets.select(F.col("node").alias("u"), F.col("set").alias("us")).join(_sent(pairs), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("set").alias("vs")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("us", "vs")).cast("long").alias("i"), (F.size("us") + F.size("vs")).cast("long").alias("n"))
    links = scratch.keep(both.where(100 * F.col("i") >= PERCENT * (F.col("n") - F.col("i"))).select("u", "v"), "links")
    scratch.drop(sets)
    return links


def prefix(shingle_set: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set by rank, then value: so many that a set similar to it has one of them. ``common`` is sorted; others rank 0."""
    rank = np.zeros(len(shingle_set), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingle_set), len(common) - 1)
        rank = np.where(common[at] == shingle_set, ranks[at], 0)
    n = len(shingle_set)
    return shingle_set[np.lexsort((shingle_set, rank))[: n + (-PERCENT * n) // 100 + 1]]


def _by_prefix(docs: DataFrame, now: DataFrame, nodes: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """Pairs ``(u, v)`` of the nodes of ``now(node, comp)``, among them all similar ones of different components."""
    comps = scratch.keep(now.select("node", "comp").distinct(), "comps")
    wanted = scratch.keep(comps.join(nodes.select("node", "key"), "node").select("node", "key"), "wanted")
    sets = _sets(docs, wanted, text_col, scratch)

    def counts(batches):
        for batch in batches:
            if batch.num_rows:
                found, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["shingle", "c"])

    often = sets.select("set").mapInArrow(counts, "shingle bigint, c bigint").groupBy("shingle").agg(F.sum("c").alias("c"))
    often = often.where(f"c >= {COMMON}").orderBy(F.desc("c"), "shingle").limit(MOST).toPandas().sort_values("shingle")
    order = docs.sparkSession.sparkContext.broadcast((often["shingle"].to_numpy(dtype=np.int64), often["c"].to_numpy(dtype=np.int64)))

    def firsts(batches):
        common, ranks = order.value
        for batch in batches:
            for node, comp, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = own.values.to_numpy()
                first = prefix(own, common, ranks)
                flat = lambda x, n=len(first): pa.array(np.full(n, x, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(first), flat(node), flat(comp), flat(len(own)), pa.array(np.arange(len(first), dtype=np.int64))], names=["shingle", "node", "comp", "n", "at"])

    rows = sets.join(_sent(comps), "node").select("node", "comp", "set")
    rows = scratch.keep(rows.mapInArrow(firsts, "shingle bigint, node bigint, comp bigint, n bigint, at bigint"), "prefixes")
    room = f"{100 + PERCENT} * ({{0}}.n - {{0}}.at) >= {PERCENT} * (l.n + r.n)"
    on = f"l.shingle = r.shingle and l.node < r.node and l.comp <> r.comp and {room.format('l')} and {room.format('r')}"
    pairs = rows.alias("l").join(rows.alias("r"), F.expr(on)).select(F.col("l.node").alias("u"), F.col("r.node").alias("v")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    scratch.drop(sets)
    scratch.drop(rows)
    return pairs


def _simhash_edges(rows: DataFrame, scratch: Scratch, max_dist: int) -> DataFrame:
    """``(u, v)`` of nodes that equal or linked fingerprints join."""
    pairs = rows.select("fp", "node").distinct()
    own = scratch.keep(pairs.groupBy("fp").agg(F.min("node").alias("node")), "distinct")
    links = simhash.hamming_links(own.select("fp"), scratch, max_dist)
    equal = pairs.join(own.withColumnRenamed("node", "first"), "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    ends = links.join(own.select(F.col("fp").alias("u"), F.col("node").alias("nu")), "u").join(own.select(F.col("fp").alias("v"), F.col("node").alias("nv")), "v")
    return scratch.keep(equal.union(ends.where("nu <> nv").select("nu", "nv")), "simhash-edges")


def _joined(root: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components ``root(node, root)`` as ``links(u, v)`` join them; only linked components are worked on."""
    of = lambda end: _sent(root.select(F.col("node").alias(end), F.col("root").alias(f"{end}r")))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ur", "u").alias("u"), F.coalesce("vr", "v").alias("v"))
    up = scratch.keep(connected_components(ends, scratch), "joined")
    old = root.join(_sent(up.select(F.col("node").alias("root"), F.col("root").alias("top"))), "root", "left")
    fresh = up.join(_sent(root.select("node")), "node", "left_anti")
    return scratch.keep(old.select("node", F.coalesce("top", "root").alias("root")).union(fresh.select("node", "root")), "roots")


def classes(docs: DataFrame, scratch: Scratch, text_col: str, id_col: str, shingle: int, max_dist: int) -> DataFrame:
    """``(id_col, key, class)`` for every row; near copies and SimHash links share a class."""
    rows = scratch.keep(_rows(docs, text_col, id_col, shingle), "rows")
    root = scratch.keep(connected_components(_simhash_edges(rows, scratch, max_dist), scratch), "roots")
    dealt = scratch.keep(rows.groupBy("node").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("n", "bits", "buckets"))), "dealt")
    ids = scratch.keep(rows.select(id_col, "key", "node"), "ids")
    scratch.drop(rows)
    nodes = scratch.keep(dealt.drop("buckets"), "nodes")
    each = dealt.select("node", F.explode("buckets").alias("bucket"))
    shared = scratch.keep(each.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "buckets")
    members = scratch.keep(each.join(_sent(shared), "bucket"), "members")
    scratch.drop(dealt)
    scratch.drop(shared)
    spent = False
    for turn in range(STARS + 1):
        now = members.join(_sent(root), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
        now = scratch.keep(now, "known")
        per = now.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket")
        mixed = per.agg(F.sum("c").alias("size"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("open"))
        mixed = scratch.keep(mixed.where("open > 0"), "mixed")
        n_open, n_rows = mixed.agg(F.sum("open"), F.sum("size")).first()
        if not n_open:
            break
        now = now.join(_sent(mixed.select("bucket", "size")), "bucket")
        few = n_open <= FEW * n_rows
        if few:
            now = scratch.keep(now.select("bucket", "node", "comp"), "open")
            other = now.select("bucket", F.col("node").alias("v"), F.col("comp").alias("vc"))
            pairs = now.join(other, "bucket").where("node < v and comp <> vc").select(F.col("node").alias("u"), "v")
        elif spent or turn == STARS:
            pairs = _by_prefix(docs, now, nodes, text_col, scratch)
        else:
            met = F.sum("size").over(Window.partitionBy("node"))  # a node has a row a band at most
            now = scratch.keep(now.select("bucket", "node", "comp", met.alias("met")), "open")
            hub = now.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("o"), "node", "comp")).alias("h"))
            now = scratch.keep(now.join(_sent(hub), "bucket").where("node <> h.node"), "others")
            pairs = now.where("comp <> h.comp").select(F.col("h.node").alias("u"), F.col("node").alias("v"))
            members = now.select("bucket", "node")
        pairs = scratch.keep(pairs.distinct(), "pairs")
        new = _similar(docs, pairs, nodes, text_col, scratch)
        root = root if is_empty(new) else _joined(root, new, scratch)
        if few or spent:
            break
        spent = SPENT * new.count() < pairs.count()
    found = nodes.select("node").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("class"))
    found = scratch.keep(found, "classes")  # a join of two plain tables: a node of very many rows can be split
    return ids.join(found, "node").select(id_col, "key", "class")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, max_dist: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when each class of near copies, or of SimHash links, keeps one row, as in ``simhash.keep_one``."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    return simhash.keep_least(docs, classes(docs, scratch, text_col, id_col, shingle, max_dist), scratch, text_col, id_col)
