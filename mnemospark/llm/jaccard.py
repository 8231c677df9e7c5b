"""N-gram Jaccard join (1): prefix-tree join of word-shingle sets.

Equal sets are one node. Nodes that may link meet through part signatures: the hash range is cut into more parts than two
similar sets can differ in, so some filled parts are equal in both. The components of that candidate graph are joined in
tries of the globally ordered sets. Only component ids are wanted, so sets of the probe's component are no candidates, and a
group of n near copies costs about n steps, not n * n.
"""

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bitmap, byte_class, document, grouped, hash_words, i64, in_bitmap, local_bitmap, mix, slices, store, texts_of, without
from .components import components

_SPACE = byte_class("space")

#: Set elements in one trie's task: clusters of more are dealt over several tasks.
BLOCK_ELEMENTS = 400_000


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, bounds by text)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    h, s, _ = hash_words(np.frombuffer(b" ".join(texts), np.uint8), _SPACE, lower=True)
    at = np.searchsorted(s, np.concatenate([[0], np.cumsum(lens + 1)]))
    roll = Rolling(h)
    g = roll.grams(k)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            sets.append(roll.spans(np.array([a]), np.array([b])) if b > a else g[:0])
    bounds = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else g[:0]), bounds


def size_classes(percent: int, most: int) -> list[tuple[int, int]]:
    """(least size, parts) of each class of set sizes up to most. In a class, parts exceed the largest possible difference by a quarter and 3."""
    out, low = [], 1
    while low <= most:
        high = max(low + 1, low * 3 // 2)
        out.append((low, (high - 1) * (100 - percent) // percent * 5 // 4 + 3))
        low = high
    return out


def signatures(x: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): any two sets with Jaccard similarity of percent or more, but for equal ones, share one.

    A signature is the content of one filled part of the hash range. Similar sets differ in at most d parts, so the least
    signature that both have, in an order that depends on the signature alone, is one of the first d + 1 of either. Parts
    with many elements come first: texts that share a passage and nothing else seldom have one of those in common.
    """
    n = np.diff(bounds)
    classes = size_classes(percent, int(n.max(initial=0)) * 100 // percent + 2)
    low = np.array([c[0] for c in classes] or [1])
    parts = np.array([c[1] for c in classes] or [3])
    own = np.searchsorted(low, n, "right") - 1
    differs = n * (100 - percent) // percent  # the most that a similar set can differ in
    roll = Rolling(x)
    rows, sigs, sparse = [], [], np.zeros(len(n), bool)
    for up in range(len(low)):
        take = (differs > 0) & (own + up < len(low))
        cls = np.minimum(own + up, len(low) - 1)
        if up:
            take &= n * 100 >= low[cls] * percent
        if not take.any():
            break
        which = np.flatnonzero(take)
        m = np.repeat(parts[cls[which]], n[which]).astype(np.uint64)
        row = np.repeat(which, n[which])
        at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in which.tolist()])
        part = ((x[at] >> np.uint64(32)) * m) >> np.uint64(32)
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
        first = np.flatnonzero(new)
        start = at[first]
        end = at[np.concatenate([first[1:], [len(at)]]) - 1] + 1
        r = row[first]
        label = mix((cls[r].astype(np.uint64) << np.uint64(32)) + part[first] + np.uint64(1))
        sig = mix(roll.spans(start, end) ^ label)
        by = np.lexsort((sig, start - end, r))
        filled = np.bincount(r, minlength=len(n))
        place = np.arange(len(r)) - np.repeat((np.cumsum(filled) - filled)[which], filled[which])
        by = by[place <= differs[r]]
        rows.append(r[by])
        sigs.append(sig[by])
        sparse[which[filled[which] <= differs[which]]] = True
    # Sets that fill so few parts that all equal ones may be empty: two of them share one of their first elements, in the
    # order of their hashes, as many as a prefix filter takes.
    for r in np.flatnonzero(sparse).tolist():
        few = x[bounds[r] : bounds[r + 1]][: prefix(int(n[r]), percent)]
        rows.append(np.full(len(few), r))
        sigs.append(mix(few ^ np.uint64(0x5851F42D4C957F2D)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(sigs)


def prefix(n: int, percent: int) -> int:
    """So many first elements, in any common order, of a set of n: similar sets share one of them."""
    return n * (100 - percent) // 100 + 1


def _node(x: np.ndarray) -> bytes:
    return hashlib.md5(x.tobytes()).digest()


def _sets(texts, k):
    for i, j in grouped(texts):
        x, bounds = shingle_sets(texts[i:j], k)
        yield i, x, bounds, [_node(x[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _nodes(k):
    def run(batches):
        for batch in slices(batches):
            for i, _, bounds, nodes in _sets(texts_of(batch.column("text")), k):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, len(nodes)) for c in ("doc_id", "tkey")), pa.array(nodes, pa.binary()), i64(np.diff(bounds))], names=["doc_id", "tkey", "node", "n"])

    return run


def _short(nodes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in nodes), np.uint64)


def _signed(k, percent, shared=None, full=False):
    def run(batches):
        keys = local_bitmap(shared)
        for batch in slices(batches):
            for _, x, bounds, nodes in _sets(texts_of(batch.column("text")), k):
                rows, sigs = signatures(x, bounds, percent)
                if not full:
                    yield pa.RecordBatch.from_arrays([i64(sigs), i64(_short(nodes)[rows])], names=["a", "s"])
                    continue
                if keys is not None:
                    keep = in_bitmap(keys, sigs)
                    rows, sigs = rows[keep], sigs[keep]
                yield pa.RecordBatch.from_arrays([i64(sigs), pa.array(nodes, pa.binary()).take(pa.array(rows))], names=["a", "node"])

    return run


def _members(k, shared):
    def run(batches):
        keys = local_bitmap(shared)
        for batch in slices(batches):
            seen = set()
            for _, x, bounds, nodes in _sets(texts_of(batch.column("text")), k):
                keep = np.arange(len(nodes)) if keys is None else np.flatnonzero(in_bitmap(keys, _short(nodes)))
                keep = [r for r in keep.tolist() if bounds[r + 1] > bounds[r] and not (nodes[r] in seen or seen.add(nodes[r]))]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[r] for r in keep], pa.binary()), pa.array([x[bounds[r] : bounds[r + 1]].tobytes() for r in keep], pa.binary())], names=["node", "x"])

    return run


class _Trie:
    """A node of the trie: sets[lo:hi] agree on their first `to` elements; the edge into it holds elements [at, to)."""

    __slots__ = ("lo", "hi", "at", "to", "kids", "starts")

    def __init__(self, lo, hi, at, to):
        self.lo, self.hi, self.at, self.to = lo, hi, at, to
        self.kids, self.starts = [], []


def build_trie(sets: list[np.ndarray]) -> _Trie:
    """The compressed trie of distinct sorted arrays, which are in lexicographic order."""
    shared = []
    for x, y in zip(sets, sets[1:], strict=False):
        m = min(len(x), len(y))
        diff = np.flatnonzero(x[:m] != y[:m])
        shared.append(int(diff[0]) if len(diff) else m)
    size = [len(x) for x in sets]

    def node(lo, hi, at):
        to = size[lo] if hi - lo == 1 else min(shared[lo : hi - 1])
        return _Trie(lo, hi, at, to)

    root = node(0, len(sets), 0)
    todo = [root]
    while todo:
        x = todo.pop()
        if x.hi - x.lo > 1:
            cut = [x.lo, *(i + 1 for i in range(x.lo, x.hi - 1) if shared[i] == x.to), x.hi]
            x.kids = [node(a, b, x.to) for a, b in zip(cut, cut[1:], strict=False) if size[a] > x.to or b - a > 1]
            x.starts = [k.lo for k in x.kids]
            todo += x.kids
    return root


def trie_links(sets: list[np.ndarray], percent: int, same: list | None = None) -> list[tuple[int, int]]:
    """Links (i, j) of a spanning forest of the graph of sets with Jaccard similarity of percent or more.

    Elements are ordered by their number of sets, rare ones first; sets that share none of their first
    n - ceil(n * percent / 100) + 1 elements can't link. The trie is walked from the root towards the sets that a probe may
    still link with, counting overlaps once for all that share a path, and a subtree is left as soon as the remaining lengths
    can't make up the overlap. Sets of the probe's own component are no candidates.
    same: labels; sets of one label count as linked from the start.
    """
    links: list[tuple[int, int]] = []
    if len(sets) < 2:
        return links
    value, count = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(value), np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(value), dtype=np.int32)
    ranked = [np.sort(rank[np.searchsorted(value, x)]) for x in sets]
    del value, count, rank
    order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
    xs = [ranked[i] for i in order]
    size = np.array([len(x) for x in xs])
    group = np.arange(len(xs))
    members = {i: [i] for i in range(len(xs))}

    def unite(i, j):
        i, j = sorted((int(group[i]), int(group[j])), key=lambda g: len(members[g]))
        if i != j:
            group[members[i]] = j
            members[j] += members.pop(i)
        return i != j

    first: dict = {}
    for i, o in enumerate(order if same is not None else ()):
        unite(i, first.setdefault(same[o], i))
    head = [x[: prefix(len(x), percent)] for x in xs]
    token = np.concatenate(head)
    owner = np.repeat(np.arange(len(xs), dtype=np.int32), [len(x) for x in head])
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    root = build_trie(xs)
    for q, x in enumerate(xs):
        n = len(x)
        least, most = -(-n * percent // 100), n * 100 // percent
        a, b = np.searchsorted(token, head[q]), np.searchsorted(token, head[q], "right")
        found = np.unique(np.concatenate([owner[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]))
        found = found[(group[found] != group[q]) & (size[found] >= least) & (size[found] <= most)]
        todo = [(root, 0, 0, found)] if len(found) else []
        while todo:
            t, shared, used, own = todo.pop()
            own = own[group[own] != group[q]]
            if not len(own):
                continue
            need = percent * (n + int(size[own].min()))  # of (100 + percent) * overlap
            longest = int(size[own].max())
            y, a, alive = xs[t.lo], t.at, True
            while alive and a < t.to:
                b = min(t.to, a + 64)
                at = np.searchsorted(x, y[a:b])
                hit = x[np.minimum(at, n - 1)] == y[a:b]
                shared += int(np.count_nonzero(hit))
                used = int(at[-1]) + int(hit[-1])
                a = b
                alive = (100 + percent) * (shared + min(n - used, longest - a)) >= need
            if not alive:
                continue
            if len(y) == t.to and own[0] == t.lo and (100 + percent) * shared >= percent * (n + len(y)) and unite(q, t.lo):
                links.append((order[q], order[t.lo]))
            i = 0
            while t.kids and i < len(own):
                k = bisect.bisect_right(t.starts, int(own[i])) - 1
                if k < 0:  # the set that ends here
                    i += 1
                    continue
                j = int(np.searchsorted(own, t.kids[k].hi))
                todo.append((t.kids[k], shared, used, own[i:j]))
                i = j
    return links


def _linked(percent):
    def run(table: pa.Table) -> pa.Table:
        """Links of each cluster of a block; sets are views of the block's buffer, and a cluster's arrays go before the next."""
        out = {"u": [], "v": []}
        table = table.combine_chunks()
        nodes, labels = table["node"], table["label"]
        codes = table["cl"].combine_chunks().dictionary_encode().indices.to_numpy()
        xs = table["x"].combine_chunks()
        at = np.frombuffer(xs.buffers()[1], np.int32)[xs.offset : xs.offset + len(xs) + 1]
        data = np.frombuffer(xs.buffers()[2] or b"", np.uint8)
        order = np.argsort(codes, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
            if len(own) > 1:
                names = nodes.take(own).to_pylist()
                once = list({x: k for k, x in enumerate(names)}.values())
                sets = [data[at[own[k]] : at[own[k] + 1]].view(np.uint64) for k in once]
                for i, j in trie_links(sets, percent, labels.take(own[once]).to_pylist()):
                    out["u"].append(names[once[i]])
                    out["v"].append(names[once[j]])
        return pa.Table.from_pydict(out, schema=pa.schema([("u", pa.binary()), ("v", pa.binary())]))

    return run


def _exploded(batches):
    for batch in slices(batches, 64):
        x = batch.column("x").to_pylist()
        n = np.array([len(y) // 8 for y in x])
        at = pa.array(np.repeat(np.arange(len(x)), n))
        yield pa.RecordBatch.from_arrays([i64(np.frombuffer(b"".join(x), np.uint64)), batch.column("node").take(at)], names=["e", "node"])


def _clusters(rows: DataFrame, name: str) -> DataFrame:
    """(node, cl): the components of nodes that share a signature; rows: (a, node)."""
    star = rows.join(rows.groupBy("a").agg(F.min("node").alias("v")), "a").select(F.col("node").alias("u"), "v")
    return store(components(star, name).withColumnRenamed("comp", "cl"), name)


def _placed(sets: DataFrame, cluster: DataFrame, block: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(node, x, n, cl, chunks of sets, by the elements of their cluster; cl, total, chunks of clusters)."""
    sets = sets.join(cluster, "node")
    sizes = store(sets.groupBy("cl").agg(F.sum("n").alias("total")).withColumn("chunks", F.ceil(F.col("total") / F.lit(block)).cast("long")), name)
    return sets.join(sizes, "cl"), sizes


def _within(placed: DataFrame, sizes: DataFrame, percent: int, block: int, name: str) -> DataFrame:
    """Links inside the clusters that fit a block."""
    total = sizes.where("chunks = 1").agg(F.sum("total")).first()[0] or 0
    deal = F.pmod(F.xxhash64("cl"), F.lit(max(1, math.ceil(total / block))))
    own = placed.where("chunks = 1").select("cl", "node", "x", F.col("node").alias("label"), deal.alias("blk"))
    return store(own.groupBy("blk").applyInArrow(_linked(percent), LINK), name)


LINK = "u binary, v binary"


def similar_sets(docs: DataFrame, k: int, percent: int, block: int = BLOCK_ELEMENTS) -> DataFrame:
    """(u, v): links between set nodes that span each component of similar, unequal sets. docs: rows of text."""
    spark = docs.sparkSession
    texts = docs.select("text")
    share = lambda x: None if x is None else spark.sparkContext.broadcast(x)
    signed = texts.mapInArrow(_signed(k, percent), "a long, s long").groupBy("a").agg(F.min("s").alias("x"), F.max("s").alias("y"))
    keys = store(signed.where("x <> y").select("a"), "signatures")
    bits = share(bitmap(keys))
    rows = texts.mapInArrow(_signed(k, percent, bits, full=True), "a long, node binary")
    if bits is None:
        rows = rows.join(keys, "a", "left_semi")
    rows = store(rows.distinct(), "signed")
    cluster = _clusters(rows, "clusters")
    some = share(bitmap(cluster.select(_long("node").alias("a"))))
    sets = texts.mapInArrow(_members(k, some), "node binary, x binary").groupBy("node").agg(F.first("x").alias("x"))
    sets = store(sets.join(cluster.select("node"), "node", "left_semi").withColumn("n", (F.octet_length("x") / 8).cast("long")), "sets")
    placed, sizes = _placed(sets, cluster, block, "sizes")
    links = _within(placed, sizes, percent, block, "links")
    if sizes.where("chunks > 1").isEmpty():
        return links
    # Clusters for several tasks. A set with a whole prefix of elements that no other of these sets has links with none;
    # without these sets, what chance signatures had chained falls apart into clusters of its own.
    large = placed.where("chunks > 1").select("node", "x", "n")
    lone = large.mapInArrow(_exploded, "e long, node binary").groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    lone = lone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    left = large.select("node", "n").join(lone, "node", "left").where(F.coalesce("own", F.lit(0)) <= F.floor(F.col("n") * (100 - percent) / 100))
    cluster = _clusters(rows.join(store(left.select("node"), "left"), "node", "left_semi"), "large-clusters")
    placed, sizes = _placed(sets, cluster, block, "large-sizes")
    links = links.unionByName(_within(placed, sizes, percent, block, "large-links"))
    if sizes.where("chunks > 1").isEmpty():
        return links
    # All chunks of a cluster meet chunk 0, which joins most of a group of near copies; then what isn't in the cluster's
    # largest component meets all.
    large = placed.where("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    pivot = large.where("chunk = 0").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    meet = pivot.select("cl", "node", "x", "to").unionByName(large.where("chunk > 0").select("cl", "node", "x", F.col("chunk").alias("to")))
    met = store(meet.withColumn("label", F.col("node")).groupBy("cl", "to").applyInArrow(_linked(percent), LINK), "pivot-links")
    comp = components(met, "pivot")
    large = store(large.select("cl", "node", "x", "n", "chunk", "chunks").join(comp, "node", "left").withColumn("label", F.coalesce("comp", "node")).drop("comp"), "large")
    main = large.groupBy("cl", "label").agg(F.sum("n").alias("s")).groupBy("cl").agg(F.max_by("label", F.struct("s", "label")).alias("main"))
    rest = large.join(main, "cl").where("label <> main").drop("main")
    size = rest.groupBy("cl").agg(F.ceil(F.sum("n") / F.lit(block)).cast("long").alias("r"))
    rest = rest.join(size, "cl").withColumn("ra", F.pmod(F.xxhash64("node", F.lit(1)), F.col("r"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    every = large.join(size, "cl").withColumn("ra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)))
    both = rest.select("cl", "ra", "to", "node", "x", "label").unionByName(every.select("cl", "ra", F.col("chunk").alias("to"), "node", "x", "label"))
    last = both.groupBy("cl", "ra", "to").applyInArrow(_linked(percent), LINK)
    return links.unionByName(met).unionByName(store(last, "rest-links"))


def _long(node: str):
    """The first 8 bytes of a binary column as the little-endian long that _short makes."""
    digits = ", ".join(f"substr(hex({node}), {2 * i + 1}, 2)" for i in range(7, -1, -1))
    return F.expr(f"cast(conv(concat({digits}), 16, -10) as long)")


def _groups(docs: DataFrame, k: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, node, n of each row, node and comp of the sets that link with others)."""
    docs = docs.select(*(document().getField(x).alias(x) for x in ("doc_id", "tkey")), "text")
    return store(docs.mapInArrow(_nodes(k), "doc_id long, tkey long, node binary, n long"), "nodes"), components(similar_sets(docs, k, percent, block), "similar")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, a row for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; a document's set holds its distinct k-word shingles, or
    its whole word sequence if that is shorter. Documents link when 100 * intersection >= percent * union. component_id is
    the least doc_id that links reach. A text without words links with nothing. Rows with a null doc_id take part but don't
    name a component, unless it has no other (then null). Repeated rows are equal documents. An empty table gives an empty
    table; a very long text is one set, hashed in bounded pieces. Links are found up to a spanning forest: none that joins
    two components is lost, and those inside one aren't counted.
    """
    slim, comp = _groups(docs, k, percent, block)
    nodes = slim.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    label = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    name = label.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = label.join(name, "comp").select("node", "component_id")
    full = slim.where("n > 0").join(found, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(slim.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK_ELEMENTS) -> DataFrame:
    """docs with one document of each group of near duplicates, the one of least doc_id; texts without words all stay.

    Of different texts of that doc_id in the group, the one of least text hash stays. Rows that repeat the kept document
    stay; a null doc_id is kept only where its group has no other. All columns are kept, whatever their names.
    """
    slim, comp = _groups(docs, k, percent, block)
    slim = slim.where("n > 0").select("doc_id", "tkey", "node").distinct()
    label = store(slim.join(comp, "node", "left").select("doc_id", "tkey", F.coalesce("comp", "node").alias("comp")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey")
    kept = label.groupBy("comp").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    gone = label.join(kept, "comp").where(~order.eqNullSafe(F.col("f"))).select("doc_id", "tkey").distinct()
    return without(docs, store(gone, "near-copies"))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.v) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.u = d.doc_id GROUP BY d.doc_id, n.n
"""
