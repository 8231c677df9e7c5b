"""Benchmark decontamination (10): a broadcast hash set of normalised test n-grams, scanned over training windows."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, bitmap, byte_class, document, free_name, grouped, hash_words, i64, in_bitmap, join_docs, keyed, local_bitmap, map_met, parted, slices, store, texts_of

#: Benchmark texts are broadcast up to so many bytes together. Each window takes 20 bytes of the table and at least 2 of text,
#: so the table has at most 10 times as many. The windows of a larger benchmark are joined by shuffle.
MAX_BYTES = 4 << 20

_WORD = byte_class("alnum")
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_HITS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
_HITS_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def windows(text: bytes, n: int) -> tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray]:
    """(words joined by one space, window length, window hashes, their first and last bytes); a text of fewer than n words is one window."""
    h, s, e = hash_words(np.frombuffer(text, np.uint8), _WORD, lower=True)
    m = min(n, len(h))
    if not m:
        return b"", 0, np.zeros(0, np.uint64), s, e
    low, size = text.translate(_LOWER), np.cumsum(e - s + 1)
    plain = b" ".join(low[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True))
    return plain, m, Rolling(h).grams(m), (size - (e - s + 1))[: len(h) - m + 1], size[m - 1 :] - 1


class WindowTable:
    """Windows of all items, sorted by hash, by window length: {m: (hashes, items, first bytes, last bytes)}."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.ids = [i for i, _ in items]
        self.texts, rows, self.met = [], {}, {}
        for k, (_, text) in enumerate(items):
            plain, m, h, a, b = windows(text, n)
            self.texts.append(plain)
            if m:
                rows.setdefault(m, []).append((h, np.full(len(h), k, np.int32), a.astype(np.int32), b.astype(np.int32)))
        self.by_length = {}
        for m, parts in rows.items():
            h, k, a, b = (np.concatenate([x[i] for x in parts]) for i in range(4))
            order = np.argsort(h, kind="stable")
            self.by_length[m] = tuple(x[order] for x in (h, k, a, b))

    def scan(self, texts: list[bytes]) -> tuple[list[int], list[list[dict]], list[list]]:
        """(words, hit spans of words, ids of the items with a hit) of each text; hits are verified word by word."""
        words, hits, items = [], [], []
        for a, b in grouped(texts):
            joined = b" ".join(texts[a:b])
            lens = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
            h, s, e = hash_words(np.frombuffer(joined, np.uint8), _WORD, lower=True)
            bounds = np.searchsorted(s, np.concatenate([[0], np.cumsum(lens + 1)]))
            doc = np.repeat(np.arange(b - a), np.diff(bounds))
            at: dict[int, list] = {}
            got: dict[int, set] = {}
            roll = Rolling(h)
            for m, (keys, item, lo, hi) in self.by_length.items():
                g = roll.grams(m)
                i = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g)
                i = i[doc[i] == doc[i + m - 1]] if len(i) else i
                first, last = np.searchsorted(keys, g[i]), np.searchsorted(keys, g[i], "right")
                for j, x, y in zip(i.tolist(), first.tolist(), last.tolist(), strict=True):
                    found = b" ".join(joined[p:q].translate(_LOWER) for p, q in zip(s[j : j + m].tolist(), e[j : j + m].tolist(), strict=True))
                    if (m, x) not in self.met:  # the items of each text with this hash, found once
                        same = self.met[m, x] = {}
                        for k in range(x, y):
                            same.setdefault(self.texts[item[k]][lo[k] : hi[k]], set()).add(self.ids[item[k]])
                    if own := self.met[m, x].get(found):
                        d = int(doc[j])
                        at.setdefault(d, []).append({"s": j - int(bounds[d]), "e": j - int(bounds[d]) + m})
                        got.setdefault(d, set()).update(own)
            words += np.diff(bounds).tolist()
            hits += [at.get(d, []) for d in range(b - a)]
            items += [in_order(got.get(d, ())) for d in range(b - a)]
        return words, hits, items


def in_order(ids) -> list:
    """Item ids as strings in order, a null one last."""
    return sorted(ids, key=lambda x: (x is None, x or ""))


def _scanned(shared):
    def run(batches):
        for batch in slices(batches):
            words, hits, items = shared.value.scan(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(words, pa.int64()), pa.array(hits, _HITS_ARROW), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "tkey", "n_words", "hits", "items"])

    return run


def _marked(shared, name: str):
    def run(batches):
        for batch in slices(batches):
            hits = pa.array(shared.value.scan(texts_of(batch.column("text")))[1], _HITS_ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, name])

    return run


def _counted(batches):
    for batch in slices(batches):
        words = [len(hash_words(np.frombuffer(x, np.uint8), _WORD, lower=True)[0]) for x in texts_of(batch.column("text"))]
        hits = pa.array([x or [] for x in batch.column("hits").to_pylist()], _HITS_ARROW)
        items = pa.array([in_order(y["i"] for y in x or ()) for x in batch.column("items").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(words, pa.int64()), hits, items], names=["doc_id", "tkey", "n_words", "hits", "items"])


def _test_windows(n: int):
    def run(batches):
        for batch in slices(batches, 64):
            ids = batch.column("i").to_pylist()
            for k, text in enumerate(texts_of(batch.column("t"))):
                plain, m, h, a, b = windows(text, n)
                for x in range(0, len(h), 10_000):
                    w = [plain[p:q] for p, q in zip(a[x : x + 10_000].tolist(), b[x : x + 10_000].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(w), pa.int32()), i64(h[x : x + 10_000]), pa.array(w, pa.binary()), pa.array([ids[k]] * len(w), pa.string())], names=["m", "h", "w", "i"])

    return run


def _doc_windows(lengths: list[int], shared):
    def run(batches):
        keys = local_bitmap(shared)
        for batch in slices(batches, 64):
            for k, text in enumerate(texts_of(batch.column("text"))):
                h, s, e = hash_words(np.frombuffer(text, np.uint8), _WORD, lower=True)
                roll = Rolling(h)
                for m in lengths:
                    g = roll.grams(m)
                    at = np.arange(len(g)) if keys is None else np.flatnonzero(in_bitmap(keys, g))
                    for x in range(0, len(at), 10_000):
                        own = at[x : x + 10_000].tolist()
                        w = [b" ".join(text[p:q].translate(_LOWER) for p, q in zip(s[j : j + m].tolist(), e[j : j + m].tolist(), strict=True)) for j in own]
                        rows = pa.array([k] * len(own))
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("tkey").take(rows), pa.array([m] * len(own), pa.int32()), i64(g[own]), pa.array(w, pa.binary()), pa.array(own, pa.int32())], names=["doc_id", "tkey", "m", "h", "w", "s"])

    return run


def _joined(docs: DataFrame, test: DataFrame, n: int) -> DataFrame:
    """(doc_id, tkey, hits, items of structs) of the keyed docs with a hit, for a benchmark of any size: windows are joined by
    their hash and words. A bitmap of the benchmark's windows (its size is checked) keeps other windows out of the shuffle.

    Equal windows of several items are one for the documents' windows. A document then has each of its windows once, whatever
    their number of occurrences, and of an item that it shares several windows with one row is kept.
    """
    own = store(test.mapInArrow(_test_windows(n), "m int, h long, w binary, i string").distinct(), "test-windows")
    each = own.groupBy("m", "h", "w").agg(F.count(F.lit(1)).alias("items"), F.first("i").alias("i"))
    lengths = sorted(r["m"] for r in own.select("m").distinct().toLocalIterator())  # n values at most
    bits = bitmap(own.select(F.col("h").alias("a")).distinct())
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)
    found = docs.mapInArrow(_doc_windows(lengths, shared), "doc_id long, tkey long, m int, h long, w binary, s int").join(each, ["m", "h", "w"])
    found = store(found, "window-hits")
    hits = found.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("s", (F.col("s") + F.col("m")).alias("e"))).alias("hits"))
    lone = found.where("items = 1").select("doc_id", "tkey", "i")
    several = found.where("items > 1").select("doc_id", "tkey", "m", "h", "w").distinct().join(own, ["m", "h", "w"]).select("doc_id", "tkey", "i")
    items = lone.unionByName(several).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("i")).alias("items"))
    return store(join_docs(hits, items), "leaks")


def _test(benchmark: DataFrame) -> tuple[DataFrame, int]:
    test = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).where(F.length("t") > 0)
    return test, test.agg(F.sum(F.octet_length("t"))).first()[0] or 0


def _table(docs: DataFrame, test: DataFrame, n: int):
    """The broadcast table of a benchmark whose size has been checked."""
    return docs.sparkSession.sparkContext.broadcast(WindowTable(sorted(((r["i"], r["t"].encode()) for r in test.toLocalIterator()), key=lambda x: (x[0] or "", x[1])), n))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Hits of benchmark windows in keyed docs: doc_id, tkey, n_words, hits (word spans), items; a row for each row of docs.

    Up to max_bytes of benchmark text the table of windows is broadcast and docs are scanned in one pass; beyond it windows
    are joined by shuffle. Both ways give the same rows. Items with a null id are searched too; their id is a null in items.
    Null and empty texts have no words; items without words are never found; an empty benchmark finds nothing. Repeated rows are
    judged alike, texts of any length are scanned whole, in bounded pieces; ids of items are in order; further columns aren't taken.
    """
    test, total = _test(benchmark)
    docs = docs.select("doc_id", "tkey", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tkey", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS), T.StructField("items", T.ArrayType(T.StringType()))])
    if total <= max_bytes:
        return docs.mapInArrow(_scanned(_table(docs, test, n)), schema)
    return map_met(docs, _joined(docs, test, n), _counted, schema)


def report(leaks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of find_leaks. Items with a null id count as one in n_items
    and are left out of the ids that items_sha256 joins."""
    return leaks.mapInArrow(_covered, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def covered(hits) -> int:
    total, end = 0, 0
    for a, b in sorted((x["s"], x["e"]) for x in hits):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _covered(batches):
    for batch in slices(batches):
        hits = [covered(x) for x in batch.column("hits").to_pylist()]
        items = batch.column("items").to_pylist()
        sha = [hashlib.sha256(",".join(i for i in x if i is not None).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hits], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _without_spans(name: str):
    def run(batches):
        for batch in slices(batches):
            texts = []
            for text, hits in zip(texts_of(batch.column("text")), batch.column(name).to_pylist(), strict=True):
                if hits:
                    _, s, e = hash_words(np.frombuffer(text, np.uint8), _WORD, lower=True)
                    keep, end = [], 0
                    for a, b in sorted((int(s[x["s"]]), int(e[x["e"] - 1])) for x in hits):
                        keep.append(text[end : max(a, end)])
                        end = max(end, b)
                    text = b"".join([*keep, text[end:]])
                texts.append(text.decode() if hits else None)
            own = batch.column("text")
            cut = pa.array([x if x is not None else y for x, y in zip(texts, own.to_pylist(), strict=True)], own.type)
            batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), cut)
            yield batch.select([x for x in batch.schema.names if x != name])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs without what the benchmark holds: remove='documents' drops each document with a hit, 'spans' cuts the hit words.

    All columns are kept, whatever their names. Null doc_ids and null texts stay as they are; repeated rows are judged alike;
    items with a null id count; an empty benchmark removes nothing. While the benchmark is broadcast this is a map over rows;
    a larger one shuffles only the texts that may have a hit.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    test, total = _test(benchmark)
    name = free_name(docs, "_hits")
    if total <= max_bytes:
        marked = docs.mapInArrow(_marked(_table(docs, test, n), name), T.StructType([*docs.schema.fields, T.StructField(name, _HITS)]))
    else:
        key = free_name(docs, "_doc")
        info = _joined(keyed(docs), test, n).select(F.struct("doc_id", "tkey").alias(key), F.col("hits").alias(name))
        h = lambda d: F.xxhash64(d.getField("doc_id"), d.getField("tkey"))
        bits = bitmap(info.select(h(F.col(key)).alias("a")))
        some, rest = (docs, None) if bits is None else parted(docs, bits, h(document()))
        marked = some.withColumn(key, document()).join(info, key, "left").select(*docs.columns, name)
        if rest is not None:
            marked = marked.unionByName(rest.withColumn(name, F.lit(None).cast(_HITS)))
    if remove == "documents":
        return marked.where(F.coalesce(F.size(name), F.lit(0)) <= 0).select(docs.columns)
    return marked.mapInArrow(_without_spans(name), docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return report(find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
