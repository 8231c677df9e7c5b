"""Ranked search with an early stop over impact-ordered blocks of postings.

A score is a sum of weight * part over the query's terms. Each term's postings are cut into blocks of like parts, the largest
first, with the largest part of each. A batch of queries reads its terms' blocks in rounds; what a block names is scored exactly.
A record that no block so far has named can't score more than the sum of the next blocks' largest parts: once this is under a
query's k-th score, the query is done, and the long tails of common terms are never met.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_all
from ..sources.io import stored
from .search import query_shingles, reduced_query, term_counts, top

#: Postings in a block, about, and levels of parts that a term's postings are dealt over at most.
BLOCK, LEVELS = 128, 64


class TermIndex(NamedTuple):
    """postings: (term, mid, part); blocks: (term, blk, largest, n, mids), blk from 0 by falling largest part."""

    postings: DataFrame
    blocks: DataFrame


class Found(NamedTuple):
    """results: (qid, mid, score, pos); read: how many postings the search met, in blocks and to score records."""

    results: DataFrame
    read: int


def build(parts: DataFrame, block: int = BLOCK) -> TermIndex:
    """An index of parts (term, mid, part), each over 0. Both tables are written to the shared folder.

    A term's postings are dealt by the level of their part and a hash of mid, so a common term is neither sorted nor gathered as
    a whole; only its blocks are put in order.
    """
    parts = stored(parts.select("term", "mid", F.col("part").cast("double").alias("part")).where("part > 0"), "postings")
    largest = parts.groupBy("term").agg(F.max("part").alias("m"), F.least(F.lit(LEVELS), F.ceil(F.count(F.lit(1)) / block)).alias("levels"))
    levelled = parts.join(largest, "term").withColumn("level", F.floor(F.col("part") / F.col("m") * F.col("levels")))
    sizes = levelled.groupBy("term", "level").agg(F.ceil(F.count(F.lit(1)) / block).alias("pieces"))
    dealt = levelled.join(sizes, ["term", "level"]).withColumn("piece", F.pmod(F.xxhash64("mid"), F.col("pieces")))
    blocks = dealt.groupBy("term", "level", "piece").agg(F.max("part").alias("largest"), F.count(F.lit(1)).alias("n"), F.collect_list("mid").alias("mids"))
    order = Window.partitionBy("term").orderBy(F.desc("largest"), "level", "piece")
    ranked = blocks.withColumn("blk", F.row_number().over(order) - 1).select("term", "blk", "largest", "n", "mids")
    return TermIndex(parts, stored(ranked.repartition("term").sortWithinPartitions("term", "blk"), "blocks"))


def search(terms: DataFrame, index: TermIndex, k: int, first: int = 1, growth: int = 4) -> Found:
    """The k best records of each query's terms (qid, term, weight), as the channels and `top` give them: scores equal to 9 places
    tie, ties by mid. Rounds read blocks up to a depth that grows by `growth`; a query leaves as soon as no further block can
    change its list. Where looking up all terms of what a round may name would cost more than the open queries' postings have rows, these
    are read whole, once, and the search ends. Repeated terms of a query add up. Each round's scores are written to the shared folder."""
    asked = stored(terms.groupBy("qid", "term").agg(F.sum("weight").alias("weight")).where("weight > 0"), "asked")
    wanted = asked.join(index.blocks.select("term", "blk", "largest", "n"), "term")
    wanted = stored(wanted.select("qid", "term", "weight", "blk", "largest", "n"), "wanted")
    asked = wanted.where("blk = 0").select("qid", "term", "weight")  # the terms that the index has
    still = asked.select("qid").distinct()
    scored, read, low, high = None, 0, 0, first
    score = F.sum(F.col("weight") * F.col("part")).alias("score")
    while True:
        now = wanted.where((F.col("blk") >= low) & (F.col("blk") < high)).join(still, "qid", "left_semi")
        next_n = F.sum(F.when((F.col("blk") >= low) & (F.col("blk") < high), F.col("n")).otherwise(0))
        costs = wanted.join(still, "qid", "left_semi").groupBy("qid").agg((next_n * F.count_if(F.col("blk") == 0)).alias("lookups"), F.sum("n").alias("n"))
        lookups, every = costs.agg(F.sum("lookups"), F.sum("n")).first()
        if (lookups or 0) > (every or 0):
            rest = asked.join(still, "qid", "left_semi").join(index.postings, "term").groupBy("qid", "mid").agg(score)
            done = rest if scored is None else scored.join(still, "qid", "left_anti").unionByName(rest)
            return Found(top(done, k), read + every)
        named = now.select("qid", "term", "blk").join(index.blocks.select("term", "blk", "mids"), ["term", "blk"]).select("qid", F.explode("mids").alias("mid")).distinct()
        if scored is not None:
            named = named.join(scored, ["qid", "mid"], "left_anti")
        pairs = named.join(asked, "qid").join(index.postings, ["term", "mid"])
        new = stored(pairs.groupBy("qid", "mid").agg(score, F.count(F.lit(1)).alias("hits")), "scores")
        read += (now.agg(F.sum("n")).first()[0] or 0) + (new.agg(F.sum("hits")).first()[0] or 0)
        new = new.drop("hits")
        scored = new if scored is None else scored.unionByName(new)
        kth = top(scored, k).where(F.col("pos") == k).select("qid", F.round("score", 9).alias("kth"))
        ahead = wanted.where(F.col("blk") == high).join(still, "qid", "left_semi").groupBy("qid").agg(F.sum(F.col("weight") * F.col("largest")).alias("bound"))
        still = stored(ahead.join(kth, "qid", "left").where(F.col("kth").isNull() | (F.round("bound", 9) >= F.col("kth"))).select("qid"), "open")
        if still.isEmpty():
            return Found(top(scored, k), read)
        low, high = high, high * growth


def bm25_parts(memories: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """G04's parts: what a term adds to a record's score whatever the query."""
    tf = term_counts(memories)
    length = tf.groupBy("mid").agg(F.sum("tf").alias("dl"))
    stats = length.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(df, "term").join(length, "mid").crossJoin(F.broadcast(stats)).select("term", "mid", part.alias("part"))


def bm25_terms(queries: DataFrame) -> DataFrame:
    """G04's query terms, each once."""
    words = F.array_distinct(extract_all(F.lower(reduced_query(F.col("query"))), "[a-z0-9]+"))
    return queries.select("qid", F.explode(words).alias("term"), F.lit(1.0).alias("weight"))


def tfidf_parts(memories: DataFrame) -> DataFrame:
    """G03's parts: tf * idf^2 over the record's vector length."""
    tf = term_counts(memories)
    n = memories.agg(F.count(F.lit(1)).alias("N"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    size = weighted.groupBy("mid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return weighted.join(size, "mid").select("term", "mid", (F.col("idf") * F.col("w") / F.col("size")).alias("part"))


def tfidf_terms(queries: DataFrame) -> DataFrame:
    """G03's query terms, weighted by how often the query has them."""
    counts = term_counts(queries.select(F.col("qid").alias("mid"), F.col("query").alias("content")))
    return counts.select(F.col("mid").alias("qid"), "term", F.col("tf").cast("double").alias("weight"))


def keyword_parts(postings: DataFrame) -> DataFrame:
    """J01's parts: each keyword counts 1."""
    return postings.select("term", "mid", F.lit(1.0).alias("part"))


def keyword_weights(queries: DataFrame) -> DataFrame:
    """J01's query terms."""
    return queries.select("qid", F.explode(query_shingles(F.col("query"))).alias("term"), F.lit(1.0).alias("weight"))
