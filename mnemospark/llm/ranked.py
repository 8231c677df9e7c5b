"""Ranked lexical search (12): best-first document intervals over range-maximum tables of posting lists.

The index is cut by documents, so that the list of a common term is spread over all shards and nothing is shuffled to build it.
In a shard each posting list has a sparse table of range maxima of its impacts. An interval of documents is bounded by the sum
of its terms' range maxima; the interval of the highest bound is split at the document where its strongest term is largest,
that document is scored, and what lies to its left and right goes on as two intervals, until no bound can reach the list.
"""

import math
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, store, texts_of

#: Documents and postings at which a shard is closed; both only bound a task's memory.
SHARD, POSTINGS = 8192, 2_000_000
#: Bytes of query text that are broadcast at a time; more queries go in further blocks.
QUERY_BYTES = 4 << 20
#: Intervals that are taken from the front at a time, at first and at most.
FRONT = (8, 128)
NULL_ID = np.iinfo(np.int64).max

_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
INDEX = "ids array<long>, lengths array<long>, terms array<binary>, starts array<int>, docs array<int>, counts array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, with only A-Z lower-cased."""
    return text.translate(_FOLD).split()


class _Shard:
    """Postings of some documents, gathered one document at a time."""

    def __init__(self, known: dict | None):
        self.known = known
        self.number = known if known is not None else defaultdict(count(1).__next__)
        self.ids, self.lengths, self.term, self.doc, self.count = [], [], [], [], []

    def add(self, doc_id, text: bytes):
        words = terms_of(text)
        if words:
            get = self.number.get if self.known is not None else self.number.__getitem__
            found = Counter(filter(None, map(get, words)))
            self.term.extend(found.keys())
            self.count.extend(found.values())
            self.doc.extend([len(self.ids)] * len(found))
            self.ids.append(doc_id)
            self.lengths.append(len(words))

    def batch(self) -> pa.RecordBatch:
        keys = np.array([NULL_ID if x is None else x for x in self.ids], np.int64)
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, n = np.array(self.term, np.int64), place[np.array(self.doc, np.int64)], np.array(self.count, np.int32)
        by = np.lexsort((doc, term))
        used, first = np.unique(term[by], return_index=True)
        names = {i: w for w, i in self.number.items()}
        row = [[self.ids[i] for i in order], [self.lengths[i] for i in order], [names[i] for i in used.tolist()], [*first.tolist(), len(by)], doc[by].astype(np.int32), n[by]]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(k)) for x, k in zip(row, kinds, strict=True)], names=["ids", "lengths", "terms", "starts", "docs", "counts"])


def _shards(vocabulary):
    def run(batches):
        known = None if vocabulary is None else {w: i for i, w in enumerate(vocabulary.value, 1)}
        shard = _Shard(known)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                shard.add(doc_id, text)
                if len(shard.ids) >= SHARD or len(shard.term) >= POSTINGS:
                    yield shard.batch()
                    shard = _Shard(known)
        if shard.ids:
            yield shard.batch()

    return run


def index(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """A stored index, a row for each shard of up to SHARD documents, built in a map without a shuffle.

    Documents without a term aren't in it. Every row of docs is a document of its own, a repeated one too; in a shard they stand
    by doc_id, null last. With a vocabulary (broadcast: the caller bounds it) only the postings of its terms are kept; lengths
    count all terms. An empty table gives an index without rows.
    """
    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(rows.mapInArrow(_shards(shared), INDEX), "lexical")


@dataclass
class Queries:
    """A block of queries: their terms, each term's weight, and for each query its terms and how often it has them."""

    keys: list
    number: dict
    weight: np.ndarray
    terms: list
    repeats: list
    documents: int
    length: int


class Lists:
    """The posting lists of a shard that a block of queries needs, with sparse tables of the places of range maxima."""

    def __init__(self, row: dict, queries: Queries):
        used = [i for i, w in enumerate(row["terms"]) if w in queries.number]
        starts, self.ids = row["starts"], row["ids"]
        size = np.array([starts[i + 1] - starts[i] for i in used], np.int64)
        end = np.cumsum(size)
        take = np.repeat(np.array([starts[i] for i in used], np.int64) - (end - size), size) + np.arange(size.sum())
        self.at = {queries.number[row["terms"][i]]: k for k, i in enumerate(used)}
        self.start, self.end = end - size, end
        self.docs = row["docs"][take].astype(np.int64)
        n, total = queries.documents, queries.length
        norm = np.array([25 + 75 * int(x) * n // total for x in row["lengths"]], np.int64)
        count_ = row["counts"][take].astype(np.int64)
        self.impact = (1_000_000_000 * count_) // (1000 * count_ + 8 * norm[self.docs])
        self.key = (np.repeat(np.arange(len(used), dtype=np.int64), size) << 32) | self.docs
        best = np.arange(len(self.docs), dtype=np.int32)
        self.best, width = [best], 1
        while len(size) and 2 * width <= size.max():  # lists of less than 2 * width are never asked at this level
            right = np.concatenate([best[width:], best[len(best) - width :]])
            best = np.where(self.impact[right] > self.impact[best], right, best)  # the first of equal ones
            self.best.append(best)
            width *= 2
        self.best = np.stack(self.best) if len(self.docs) else np.zeros((1, 0), np.int32)
        self.log = np.zeros(int(size.max(initial=0)) + 1, np.int64)
        for i in range(2, len(self.log)):
            self.log[i] = self.log[i >> 1] + 1

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the largest impacts of the ranges [a, b), and these impacts (0 for an empty range)."""
        some = b > a
        level = self.log[np.where(some, b - a, 0)]
        last = len(self.docs) - 1
        x, y = self.best[level, np.minimum(a, last)], self.best[level, np.clip(b - (1 << level), 0, last)]
        place = np.where(self.impact[y] > self.impact[x], y, x)
        return place, np.where(some, self.impact[place], 0)


class Top:
    """The k best (score, doc_id) so far: highest score first, then smallest doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray):
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]

    def open(self, bound: np.ndarray, least_doc: np.ndarray) -> np.ndarray:
        """Which bounds, with the least doc_id that an interval holds, can still enter the list."""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (bound > 0) & (least_doc < self.doc[-1]))


def best_first(lists: Lists, ids: np.ndarray, terms: np.ndarray, weight: np.ndarray, top: Top) -> int:
    """Puts the best documents of a shard into top; returns how many documents were scored."""
    base, scored = terms.astype(np.int64) << 32, 0

    def bounded(low, a, b):
        place, value = lists.maxima(a, b)
        value = value * weight
        strongest = value.argmax(1)
        return value.sum(1), lists.docs[place[np.arange(len(low)), strongest]]

    low, a, b = np.zeros(1, np.int64), lists.start[terms][None, :], lists.end[terms][None, :]
    bound, middle = bounded(low, a, b)
    size = FRONT[0]
    while True:
        live = np.flatnonzero(top.open(bound, ids[low]))
        if not len(live):
            return scored
        front = live if len(live) <= size else live[np.argpartition(-bound[live], size - 1)[:size]]
        rest = np.setdiff1d(live, front, assume_unique=True)
        size = min(2 * size, FRONT[1])
        d, fa, fb = middle[front], a[front], b[front]
        p = np.clip(np.searchsorted(lists.key, base[None, :] | d[:, None]), fa, fb)
        hit = (p < fb) & (lists.docs[np.minimum(p, len(lists.docs) - 1)] == d[:, None])
        score = np.where(hit, lists.impact[np.minimum(p, len(lists.docs) - 1)] * weight, 0).sum(1)
        scored += len(d)
        good = score > 0
        top.add(score[good], ids[d[good]])
        new_low, na, nb = np.concatenate([low[front], d + 1]), np.concatenate([fa, p + hit]), np.concatenate([p, fb])
        keep = (nb > na).any(1)
        new_low, na, nb = new_low[keep], na[keep], nb[keep]
        new_bound, new_middle = bounded(new_low, na, nb) if len(new_low) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keep = new_bound > 0
        low, a, b = np.concatenate([low[rest], new_low[keep]]), np.concatenate([a[rest], na[keep]]), np.concatenate([b[rest], nb[keep]])
        bound, middle = np.concatenate([bound[rest], new_bound[keep]]), np.concatenate([middle[rest], new_middle[keep]])


def _arrays(batch, i):
    """A row of the index: numpy arrays, and a list of terms."""
    value = lambda name: batch.column(name)[i].values
    row = {x: value(x).to_numpy(zero_copy_only=False) for x in ("lengths", "starts", "docs", "counts")}
    return row | {"ids": value("ids").fill_null(NULL_ID).to_numpy(), "terms": value("terms").to_pylist()}


def _searched(shared, k):
    def run(batches):
        queries = shared.value
        tops = [Top(k) for _ in queries.keys]
        for batch in batches:
            for i in range(batch.num_rows):
                row = _arrays(batch, i)
                lists = Lists(row, queries)
                for top, terms, repeats in zip(tops, queries.terms, queries.repeats, strict=True):
                    have = [(lists.at[t], queries.weight[t] * n) for t, n in zip(terms, repeats, strict=True) if t in lists.at]
                    if have:
                        best_first(lists, row["ids"], np.array([x for x, _ in have]), np.array([w for _, w in have], np.int64), top)
        for key, top in zip(queries.keys, tops, strict=True):
            if n := len(top.doc):
                docs = pa.array(top.doc, pa.int64(), mask=top.doc == NULL_ID)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), docs, pa.array(top.score, pa.int64())], names=["uid", "doc_id", "score"])

    return run


def _block(stored: DataFrame, texts: list, total: tuple[int, int]) -> Queries:
    """Queries with the weights of their terms; document frequencies come from the index, for the block's terms only."""
    counts = [Counter(terms_of((t or "").encode())) for _, t in texts]
    names = sorted(set().union(*counts))
    spark = stored.sparkSession
    lengths = F.transform(F.sequence(F.lit(1), F.size("terms")), lambda i: F.col("starts")[i] - F.col("starts")[i - 1])
    found = stored.where(F.size("terms") > 0).select(F.explode(F.arrays_zip(F.col("terms").alias("w"), lengths.alias("n"))).alias("x")).select("x.w", "x.n")
    wanted = spark.createDataFrame([(bytearray(w),) for w in names], "w binary")
    df = {bytes(r["w"]): r["df"] for r in found.join(F.broadcast(wanted), "w", "left_semi").groupBy("w").agg(F.sum("n").alias("df")).collect()}
    number = {w: i for i, w in enumerate(w for w in names if w in df)}
    weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df[w] + 1))) for w in number], np.int64)
    chosen = [{number[w]: n for w, n in c.items() if w in number and weight[number[w]] > 0} for c in counts]
    return Queries([x for x, _ in texts], number, weight, [list(c) for c in chosen], [list(c.values()) for c in chosen], *total)


def search(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each item, equal scores by ascending doc_id.

    Queries go to the shards in blocks of about query_bytes of text (broadcast, sizes summed first); with one block only its
    terms are indexed, with more all terms are. Each task keeps k documents an item over all its shards; only those meet in the
    final ranking. A row of docs is a document (null doc_ids come last among equal scores, repeated rows rank one after the
    other); equal rows of items are one, different texts of one item_id are ranked each by itself. Null, empty and termless
    texts match nothing; texts of any length are taken whole; empty tables give no rows. Other columns are not taken.
    """
    spark = docs.sparkSession
    asked = store(items.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("uid", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    vocabulary = None
    if blocks == 1:
        vocabulary = sorted({w for r in asked.select("text").collect() for w in terms_of((r["text"] or "").encode())})
    stored = index(docs, vocabulary)
    fold = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + x)
    n, length = stored.agg(F.sum(F.size("ids")), F.sum(fold("lengths"))).first()
    out = None
    for b in range(blocks):
        texts = [(r["uid"], r["text"]) for r in asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "text").collect()]
        if not n or not texts:
            continue
        block = _block(stored, texts, (n, length))
        found = stored.mapInArrow(_searched(spark.sparkContext.broadcast(block), k), "uid long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "uid long, doc_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return search(*(spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
qt AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest(w) AS t FROM q) GROUP BY ALL),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS wt FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
i AS (SELECT item_id, doc_id, CAST(sum(r * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
      FROM qt JOIN p USING (t) JOIN f USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM i WHERE score > 0) WHERE rank <= 10
"""
