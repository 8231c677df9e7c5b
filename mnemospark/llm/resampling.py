"""Quality classifier (2): importance resampling by hashed n-gram models of target and raw text, Gumbel top-k."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, byte_class, grouped, hash_words, keyed, slices, store, texts_of

BUCKETS = 1 << 14
_ALNUM = byte_class("alnum")
#: Keys are compared as fixed-point numbers with so many binary places.
PLACES = 20


def bucket_rows(texts: list[bytes]):
    """(first row, buckets of unigrams and bigrams, bounds by text) for chunks of texts."""
    for i, j in grouped(texts):
        lens = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
        h, s, _ = hash_words(np.frombuffer(b" ".join(texts[i:j]), np.uint8), _ALNUM, lower=True)
        at = np.searchsorted(s, np.concatenate([[0], np.cumsum(lens + 1)]))
        two = Rolling(h).grams(2)
        yield i, (h >> np.uint64(50)).astype(np.int64), (two >> np.uint64(50)).astype(np.int64), at


def _counts(shared=None):
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            if shared is not None:
                ids, own = shared.value, batch.column("doc_id")
                at = np.minimum(np.searchsorted(ids, own.fill_null(0).to_numpy()), max(0, len(ids) - 1))
                same = ids[at] == own.fill_null(0).to_numpy() if len(ids) else np.zeros(len(own), bool)
                batch = batch.filter(pa.array(same & np.asarray(own.is_valid())))
            for _, one, two, at in bucket_rows(texts_of(batch.column("text"))):
                total += np.bincount(one, minlength=BUCKETS)
                if len(two):
                    inside = np.ones(len(two), bool)
                    last = at[1:-1] - 1
                    inside[last[(last >= 0) & (last < len(two))]] = False
                    total += np.bincount(two[inside], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["b", "n"])

    return run


def ngram_counts(texts: DataFrame, shared=None) -> np.ndarray:
    """Bucket counts over all rows, or those of the broadcast sorted ids: at most BUCKETS rows a task, summed before they come to
    the driver."""
    found = texts.select("doc_id", "text").mapInArrow(_counts(shared), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found["b"].to_numpy()] = found["n"].to_numpy()
    return out


#: Ids of the target that are broadcast at most (8 bytes each); more are met by a join.
MAX_IDS = 4_000_000


def log_ratios(docs: DataFrame, target_ids: DataFrame, max_ids: int = MAX_IDS) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, add-one smoothed. Raw text is all of docs; target_ids (doc_id) names the target.

    Up to max_ids ids go to the tasks and no text is shuffled.
    """
    ids = store(target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "target")
    if ids.count() <= max_ids:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["doc_id"].to_numpy()))
        target = ngram_counts(docs, shared)
    else:
        target = ngram_counts(docs.join(ids, "doc_id", "left_semi"))
    raw = ngram_counts(docs)
    return np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def _weighed(shared):
    def run(batches):
        ratio = shared.value
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            n, w = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for i, one, two, at in bucket_rows(texts):
                a, b = np.concatenate([[0.0], np.cumsum(ratio[one])]), np.concatenate([[0.0], np.cumsum(ratio[two])])
                size = np.diff(at)
                pairs = np.maximum(size - 1, 0)
                last = np.minimum(at[:-1] + pairs, len(b) - 1)
                first = np.minimum(at[:-1], len(b) - 1)
                n[i : i + len(size)] = size + pairs
                w[i : i + len(size)] = a[at[1:]] - a[at[:-1]] + np.where(pairs > 0, b[last] - b[first], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(n), pa.array(np.round(w, 6))], names=["doc_id", "tkey", "n_ngrams", "log_weight"])

    return run


def kth_largest(values: DataFrame, k: int, buckets: int = 4096) -> int | None:
    """The k-th largest of the longs in column v, by histograms of at most `buckets` rows that close in on it."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None or k <= 0:
        return None
    while high > low:
        step = -(-(high - low + 1) // buckets)
        part = values.where(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - low) / F.lit(step)).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(part.collect(), key=lambda r: -r["b"]):
            if k <= r["n"]:
                low, high = low + r["b"] * step, min(high, low + (r["b"] + 1) * step - 1)
                break
            k -= r["n"]
        else:
            return low
    return low


def resample(docs: DataFrame, target_ids: DataFrame, share: float = 0.3, seed: int = 3) -> DataFrame:
    """doc_id, n_ngrams, log_weight, gumbel_key, selected: a sample without replacement of `share` of docs by importance.

    The weight of a document is the ratio of its n-grams' probabilities in target and raw text; adding Gumbel noise (from a
    hash of seed, doc_id and text, so repeated rows are drawn alike) and taking the largest keys draws in proportion to it.
    All rows that tie with the last key are selected. Null and empty texts have weight 1 (log 0). Repeated rows each give a row
    with the same key, so they are selected together. An empty table gives an empty table; with an empty target every n-gram is as
    likely as any other in it, so documents of rare n-grams weigh more. Texts are counted whole, in bounded pieces. Other
    columns are not taken.
    """
    base = keyed(docs)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(base, target_ids))
    weighed = base.mapInArrow(_weighed(shared), "doc_id long, tkey long, n_ngrams long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "tkey"), 11) + 0.5) / F.lit(float(1 << 53))
    scored = store(weighed.withColumn("gumbel_key", F.round(F.col("log_weight") - F.log(-F.log(u)), 6)).drop("tkey"), "weights")
    fixed = F.floor(F.col("gumbel_key") * F.lit(float(1 << PLACES))).cast("long")
    least = kth_largest(scored.select(fixed.alias("v")), int(scored.count() * share))
    return scored.withColumn("selected", F.lit(False) if least is None else fixed >= least)


def op2(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1"))
