"""Suffix-array dedup (9): longest-previous-factor arrays over shards of text, to which all documents are streamed (see repeats)."""

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, map_met, slices, texts_of
from .repeats import Bytes, outside, repeated_spans, union

#: Segments (about 135 bytes each) in a shard on average, and of one anchor in a shard at most.
BLOCK, HOT = 8000, 50_000
#: Suffixes of the order that are walked over at a time.
SLICE = 100_000


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys, from 1."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), np.uint64)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(new)
    return out


def suffix_levels(data: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the substrings of length 1, 2, 4, ... up to at least depth, by prefix doubling; past the end ranks are 0."""
    levels, size = [_ranks(data.astype(np.uint64))], 1
    while size < depth and len(np.unique(levels[-1])) < len(data):
        r = levels[-1]
        right = np.zeros(len(r), np.uint64)
        right[:-size or None] = r[size:] if size < len(r) else 0
        levels.append(_ranks((r << np.uint64(32)) | right))
        size *= 2
    return levels


def longest_previous_factor(text: bytes) -> np.ndarray:
    """LPF of each position of text: the length of its longest match with a text that starts earlier.

    The match is with the previous or the next smaller position in suffix order, whichever shares more.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    levels = suffix_levels(data, n)
    order = np.argsort(levels[-1], kind="stable")
    best = np.zeros(n, np.int64)
    for seq in (order, order[::-1]):
        stack: list[int] = []
        for i in seq.tolist():
            while stack and stack[-1] > i:
                stack.pop()
            if stack:
                j, a, b = 0, i, stack[-1]
                for k in range(len(levels) - 1, -1, -1):
                    if max(a, b) + (1 << k) <= n and levels[k][a] == levels[k][b]:
                        j, a, b = j + (1 << k), a + (1 << k), b + (1 << k)
                while max(a, b) < n and data[a] == data[b]:
                    j, a, b = j + 1, a + 1, b + 1
                best[i] = max(best[i], j)
            stack.append(i)
    return best


def suffix_order(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that start at `at`, ordered by their first `length` bytes, ties by place in `at`; and how many of these bytes
    each shares with the one before it. words: the big-endian word (8 bytes or 1) that starts at each byte.

    A word at a time; groups whose suffixes share the word aren't sorted again.
    """
    n, word = len(at), words.dtype.itemsize
    order, border, shared = np.arange(n, dtype=np.int32), np.zeros(n, bool), np.full(n, length, np.int32)
    if n:
        border[0], shared[0] = True, 0
    for o in sorted({*range(0, length - word + 1, word), length - word}):
        tied = ~border
        tied[:-1] |= ~border[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        key = words[at[order[idx]] + o].astype(np.uint64)
        group = np.cumsum(border[idx], dtype=np.int32) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][(group[1:] == group[:-1]) & (key[1:] != key[:-1])]] = True
        some = mixed[group]
        idx, key, group = idx[some], key[some], group[some]
        by = np.lexsort((key, group))
        order[idx], key = order[idx[by]], key[by]
        x = key[1:] ^ key[:-1]
        new = (x != 0) & (group[1:] == group[:-1])
        x, place = x[new], idx[1:][new]
        border[place] = True
        shared[place] = o
        for k in range(1, word):
            shared[place] += x < np.uint64(1 << 8 * (word - k))
    return order, shared


def capped_lpf(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """LPF of each suffix: what it shares with its previous or next smaller position in suffix order, whichever is more.

    One walk over the order with a stack of positions that wait for their next smaller one. Each has beside it what it shares
    with the one below it, its previous smaller one.
    """
    best = array("i", bytes(4 * len(order)))
    stack, below = [-1], [0]
    for a in range(0, len(order), SLICE):
        for i, m in zip(order[a : a + SLICE].tolist(), shared[a : a + SLICE].tolist(), strict=True):
            while stack[-1] > i:
                j = stack.pop()
                if m > best[j]:
                    best[j] = m
                if (k := below.pop()) < m:
                    m = k
            best[i] = m
            stack.append(i)
            below.append(m)
    return np.frombuffer(best, np.int32)


def previous_factors(length: int):
    """find() for repeats: the LPF array of a block's windows of `length` bytes, cut off at `length`, from their suffix order
    with previous and next smaller positions. A window is a repeat where LPF >= length."""
    word = 8 if length >= 8 else 1

    def find(segs: list[bytes]):
        n = np.fromiter(map(len, segs), np.int64, len(segs))
        start = np.cumsum(n) - n
        text = b"".join(segs) + bytes(8)
        words = np.ndarray((len(text) - 8,), ">u8", text, strides=(1,)) if word == 8 else np.frombuffer(text, np.uint8)
        m = np.maximum(n - length + 1, 0)
        done = np.concatenate([[0], np.cumsum(m)])
        at = np.arange(done[-1]) + np.repeat(start - done[:-1], m)
        seen = capped_lpf(*suffix_order(words, at, length)) >= length
        return np.split(seen, done[1:-1]), lambda k, a: segs[k][a : a + length]

    return find


def repeated_bytes(docs: DataFrame, length: int = 100, block_rows: int = BLOCK, hot_rows: int = HOT) -> DataFrame:
    """Spans of UTF-8 bytes of keyed docs that lie in a string of `length` bytes which also starts earlier."""
    return repeated_spans(docs, Bytes(length), previous_factors(length), block_rows, hot_rows)


def dedup_bytes(docs: DataFrame, length: int = 100, block_rows: int = BLOCK) -> DataFrame:
    """keyed docs as doc_id, n_bytes, n_removed, n_spans, kept (binary: a cut may fall inside a character).

    Strings are judged on the input and never cross documents. Null texts are empty. Documents are ordered by doc_id, null
    first; different texts of one doc_id by the hash of the text; repeated rows are one document. An empty table gives an empty
    table; long texts are cut into segments in bounded pieces. Other columns of a table are not taken (see keyed).
    """
    return map_met(docs, repeated_bytes(docs, length, block_rows), _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _kept(batches):
    for batch in slices(batches):
        n, gone, count, kept = [], [], [], []
        for x, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            runs = union(spans)
            n.append(len(x))
            gone.append(sum(b - a for a, b in runs))
            count.append(len(runs))
            kept.append(b"".join(outside(x, runs)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(batches):
    for batch in _kept(batches):
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")), sha], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op9(spark, sf_dir: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return map_met(docs, repeated_bytes(docs), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
s AS (SELECT doc_id, i, CASE WHEN i - 100 > lag(i) OVER w OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM r),
k AS (SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
      FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
