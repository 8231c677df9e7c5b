"""Repeated passages over all documents: what substring dedup (3, words) and suffix-array dedup (9, bytes) share.

A window is `length` consecutive symbols. Each window is owned by its anchor, the last gram of least hash in it (winnowing),
so equal windows have equal anchors wherever they stand. Neighbouring windows that share an anchor are a segment; as its
place in them differs, no two windows of one segment are equal.

1. Anchors are counted with partial sums; those that occur once hold no repeated window.
2. Every document is streamed: its segments of recurring anchors go to their anchor's shard. An anchor of very many segments
   is dealt over several shards. Windows that a document repeats itself are settled in place.
3. Each shard reads its segments in document order by the operator's own method, which flags the windows that were met before.
4. Windows of dealt anchors that are first in their shard meet once more, by window, with partial minima.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, Rolling, bitmap, byte_class, byte_values, grouped, hash_words, i64, in_bitmap, local_bitmap, mix, slices, slide_min, store, texts_of

_T1, _T2 = byte_values(21), byte_values(22)
_SPACE = byte_class("space")
_LOW = np.uint64((1 << 22) - 1)
_HIGH = ~_LOW


class Bytes:
    """Symbols are bytes."""

    def __init__(self, length: int = 100, gram: int | None = None):
        self.length, self.gram = length, gram or max(1, min(32, length // 3))

    def symbols(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        return len(data), (lambda a, b: _T1[data[a:b]]), (lambda a, b: _T2[data[a:b]]), start, start + n

    @staticmethod
    def cutter(text: bytes):
        return lambda a, n: text[a : a + n]


class Words:
    """Symbols are words [^\\x20\\x09-\\x0D]+."""

    def __init__(self, length: int = 20, gram: int | None = None):
        self.length, self.gram = length, gram or max(1, min(8, (length + 1) // 2))

    def symbols(self, texts: list[bytes]):
        h, s, _ = hash_words(np.frombuffer(b"\n".join(texts), np.uint8), _SPACE, lower=False)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.searchsorted(s, np.concatenate([[0], np.cumsum(n + 1)]))
        second = np.uint64(0xD1B54A32D192ED03)
        return len(h), (lambda a, b: h[a:b]), (lambda a, b: mix(h[a:b] + second)), at[:-1], at[1:]

    @staticmethod
    def cutter(text: bytes):
        words = text.split()
        return lambda a, n: b" ".join(words[a : a + n])


def segments(unit, texts: list[bytes], contents: bool = False, keys: np.ndarray | None = None):
    """(row, anchor, content hash or None, start, symbols) arrays of the texts' segments, a bounded piece at a time."""
    size, first, second, start, end = unit.symbols(texts)
    n, w = unit.length, unit.length - unit.gram + 1
    step = 2 * CHUNK
    for at in range(0, max(0, size - n + 1), step):
        stop = min(size, at + step + n - 1)
        h = Rolling(first(at, stop)).grams(unit.gram)
        m = slide_min((h & _HIGH) | (_LOW - np.arange(len(h), dtype=np.uint64)), w)  # ties: the last gram
        edge = np.zeros(len(m) + 1, np.int32)
        a, b = np.clip(start - at, 0, len(m)), np.clip(end - n + 1 - at, 0, len(m))
        own = b > a
        np.add.at(edge, a[own], 1)
        np.add.at(edge, b[own], -1)
        valid = np.cumsum(edge[:-1]) > 0
        lo = np.concatenate([[0], np.flatnonzero((m[1:] != m[:-1]) | (valid[1:] != valid[:-1])) + 1])
        hi = np.concatenate([lo[1:], [len(m)]])
        anchor = h[(_LOW - (m[lo] & _LOW)).astype(np.int64)]
        keep = valid[lo]
        if keys is not None:
            keep &= in_bitmap(keys, anchor)
        lo, hi, anchor = lo[keep], hi[keep], anchor[keep]
        row = np.searchsorted(start, lo + at, "right") - 1
        while (back := (row > 0) & (end[row] <= lo + at)).any():  # empty documents share a start
            row = row - back
        g = Rolling(second(at, stop)).spans(lo, hi + n - 1) if contents and len(lo) else np.zeros(0, np.uint64)
        yield row, anchor, g, lo + at - start[row], hi - lo + n - 1


def _anchors(unit):
    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            for i, j in grouped(texts):
                for _, a, _, _, _ in segments(unit, texts[i:j]):
                    yield pa.RecordBatch.from_arrays([i64(a)], names=["a"])

    return run


def own_segments(unit, texts: list[bytes], keys: np.ndarray | None):
    """(row, masked anchors, content hash, start, symbols) of the texts' segments. What a document repeats itself is settled
    here: runs of such segments (periodic text) are one row without an anchor."""
    for row, a, g, lo, n in segments(unit, texts, True, keys):
        if not len(a):
            continue
        order = np.lexsort((lo, g, a, row))
        again = np.zeros(len(a), bool)
        x, y = order[1:], order[:-1]
        again[x] = (row[x] == row[y]) & (a[x] == a[y]) & (g[x] == g[y])
        mask = again
        if again.any():
            r, s, e = row[again], lo[again], (lo + n)[again]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] > e[:-1])])
            k = np.flatnonzero(new)
            e = e[np.concatenate([k[1:], [len(e)]]) - 1]
            row, lo, n = (np.concatenate(z) for z in ((row[~again], r[k]), (lo[~again], s[k]), (n[~again], e - s[k])))
            mask = np.concatenate([np.zeros(len(a) - len(s), bool), np.ones(len(k), bool)])
            a, g = (np.concatenate([z[~again], np.zeros(len(k), np.uint64)]) for z in (a, g))
        yield row, np.ma.masked_array(a, mask), g, lo, n


def spread_of(row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _streamed(unit, shared, hot, n_blocks: int):
    """Segments of recurring anchors with their shard and symbols; spans (no symbols) of what a document repeats itself."""

    def run(batches):
        keys, (names, pieces) = local_bitmap(shared), hot.value
        for batch in slices(batches, 256):
            texts = texts_of(batch.column("text"))
            for i, j in grouped(texts):
                cut = [unit.cutter(x) for x in texts[i:j]]
                for row, a, _, lo, n in own_segments(unit, texts[i:j], keys):
                    own = ~a.mask
                    split = np.zeros(len(row), bool)
                    salt = np.zeros(len(row), np.uint64)
                    if len(names):
                        at = np.minimum(np.searchsorted(names, a.data), len(names) - 1)
                        split = own & (names[at] == a.data)
                        salt[split] = spread_of(row, lo)[split] % pieces[at[split]].astype(np.uint64)
                    mixed = np.where(own, a.data, spread_of(row, lo))
                    blk = ((mixed ^ (salt + np.uint64(1)) * np.uint64(0x94D049BB133111EB)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(31)) % np.uint64(n_blocks)
                    seg = [cut[r](s, k) if o else None for r, s, k, o in zip(row.tolist(), lo.tolist(), n.tolist(), own.tolist(), strict=True)]
                    at = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays(
                        [i64(blk), pa.array(split), i64(a.data), batch.column("doc_id").take(at), batch.column("tkey").take(at), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(seg, pa.binary())],
                        names=["blk", "split", "a", "doc_id", "tkey", "lo", "n", "seg"],
                    )

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("w", pa.binary())])


def _search(find, length: int):
    """find(segments) gives for each segment, in document order, the flags of its windows that occur earlier in the block,
    and a function from (segment, window) to the window's bytes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tkey", "ascending"), ("lo", "ascending")])
        table = table.filter(_once(*(table[k] for k in ("doc_id", "tkey", "lo"))))
        nulls = table.filter(pa.compute.is_null(table["doc_id"]))
        if len(nulls):  # a null doc_id comes first
            table = pa.concat_tables([nulls, table.filter(pa.compute.is_valid(table["doc_id"]))])
        ids, keys, los, split, segs = (table[k].to_pylist() for k in ("doc_id", "tkey", "lo", "split", "seg"))
        out = {k: [] for k in _FOUND.names}
        flags, window = find(segs)
        for k, own in enumerate(flags):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            for a, b in edge.reshape(-1, 2).tolist():
                for name, v in zip(_FOUND.names, (ids[k], keys[k], los[k] + a, b - a + length - 1, None), strict=True):
                    out[name].append(v)
            if split[k]:
                for a in np.flatnonzero(~own).tolist():
                    for name, v in zip(_FOUND.names, (ids[k], keys[k], los[k] + a, length, hashlib.md5(window(k, a)).digest()), strict=True):
                        out[name].append(v)
        return pa.Table.from_pydict(out, schema=_FOUND)

    return run


def _once(*columns) -> pa.Array:
    """Which rows of sorted columns differ from the row before: a repeated row of docs gives its segments twice."""
    keep = np.ones(len(columns[0]), bool)
    if len(keep) > 1:
        keep[1:] = False
        for c in columns:
            valid = np.asarray(c.is_valid())
            x = c.fill_null(0).to_numpy()
            keep[1:] |= (x[1:] != x[:-1]) | (valid[1:] != valid[:-1])
    return pa.array(keep)


def _shard(find, length: int):
    """_search of a shard's segments; spans that are settled already (without symbols) pass."""
    search = _search(find, length)

    def run(table: pa.Table) -> pa.Table:
        done = pa.compute.is_null(table["seg"])
        passed = table.filter(done).select(["doc_id", "tkey", "lo", "n"]).append_column("w", pa.nulls(pa.compute.sum(done).as_py() or 0, pa.binary()))
        rest = table.filter(pa.compute.invert(done))
        return pa.concat_tables([search(rest), passed]) if len(rest) else passed

    return run


#: Anchors that are dealt over several shards are broadcast up to this number, the most frequent ones first; the others are joined.
MAX_HOT = 100_000


def _dealt(found: DataFrame, hot: DataFrame, n_blocks: int) -> DataFrame:
    """Segments of hot anchors (a, pieces), a stored table of any size, in a shard by anchor and salt. The join only streams rows,
    so Spark may split an anchor of very many segments over tasks."""
    salt = F.pmod(F.xxhash64("doc_id", "tkey", "lo"), F.col("pieces"))
    met = found.join(hot, "a", "left")
    mine = F.col("pieces").isNotNull() & F.col("seg").isNotNull()
    blk = F.when(mine, F.pmod(F.xxhash64("a", salt), F.lit(n_blocks))).otherwise(F.col("blk"))
    return met.withColumn("blk", blk).withColumn("split", F.col("split") | mine).drop("pieces")


def repeated_spans(docs: DataFrame, unit, find, block_rows: int, hot_rows: int) -> DataFrame:
    """doc_id, tkey, spans (lo, n in symbols): windows of keyed docs that also start earlier, by (doc_id, tkey, start).

    Documents without a repeat have no row. Repeated rows are one document. find: see _search. A shard has block_rows segments
    on average; an anchor has about hot_rows in one at most, whatever the corpus' size.
    """
    spark = docs.sparkSession
    anchors = docs.select("text").mapInArrow(_anchors(unit), "a long").groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    anchors = store(anchors, "anchors")
    total = anchors.agg(F.sum("c")).first()[0] or 0
    many = anchors.where(F.col("c") > hot_rows).withColumn("pieces", F.ceil(F.col("c") / hot_rows))
    most = 0 if many.count() <= MAX_HOT else math.ceil(total / MAX_HOT)  # so many segments have at most MAX_HOT anchors
    rows = many.where(F.col("c") > most).select("a", "pieces").toArrow()
    names, pieces = rows["a"].to_numpy().view(np.uint64), rows["pieces"].to_numpy()
    order = np.argsort(names)
    hot = spark.sparkContext.broadcast((names[order], pieces[order]))
    bits = bitmap(anchors.select("a"))
    shared = None if bits is None else spark.sparkContext.broadcast(bits)
    schema = "blk long, split boolean, a long, doc_id long, tkey long, lo int, n int, seg binary"
    n_blocks = max(1, math.ceil(total / block_rows))
    found = docs.mapInArrow(_streamed(unit, shared, hot, n_blocks), schema)
    if bits is None:  # the bitmap may let a lone anchor pass, which costs its row and nothing else
        found = found.where("seg IS NOT NULL").join(anchors.select("a"), "a", "left_semi").unionByName(found.where("seg IS NULL"))
    if most:
        found = _dealt(found, many.where(F.col("c") <= most).select("a", "pieces"), n_blocks)
    shards = found.select("blk", "split", "doc_id", "tkey", "lo", "n", "seg").groupBy("blk").applyInArrow(_shard(find, unit.length), "doc_id long, tkey long, lo int, n int, w binary")
    shards = store(shards, "found")
    place, open_ = F.struct("doc_id", "tkey", "lo"), shards.where("w IS NOT NULL")
    ahead = open_.groupBy("w").agg(F.min(place).alias("f"))
    over = open_.join(ahead, "w").where(~place.eqNullSafe(F.col("f"))).select("doc_id", "tkey", "lo", "n")
    spans = shards.where("w IS NULL").drop("w").unionByName(over)
    return store(spans.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("lo", "n")).alias("spans")), "spans")


def union(spans) -> list[tuple[int, int]]:
    """Sorted, disjoint (start, end) runs of spans (lo, n)."""
    out: list[list[int]] = []
    for a, b in sorted((x["lo"], x["lo"] + x["n"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def outside(items, runs: list[tuple[int, int]]) -> list:
    """The slices of items that lie outside the runs."""
    out, end = [], 0
    for a, b in runs:
        out.append(items[end:a])
        end = b
    out.append(items[end:])
    return out
