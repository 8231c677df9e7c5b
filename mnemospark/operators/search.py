"""Retrieval: channels, fusion, rerank, spread, tiers.

Every operator takes a batch of queries (qid, query). A channel is (qid, mid, score).
"""

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules as R
from ..functions.text import extract_all, id_in_text, query_shingles
from ..sources.io import stored
from . import blocks, temporal
from .entities import inhibit

#: Cosines that a task holds at a time.
COSINES = 1 << 22


def top(channel: DataFrame, limit, order: Column | None = None) -> DataFrame:
    """The best rows of each query, with their position. Scores equal to 9 places tie, as sums of parts come in any order;
    ties by id. With a number for a limit Spark cuts before the shuffle too."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)) if order is None else order, "mid")
    return channel.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)


def cut(channel: DataFrame, sizes: DataFrame, column: str, most: int) -> DataFrame:
    """The best rows of each query, as many as its class has in a column of sizes (qid, ...); most: the column's largest size."""
    return top(channel, most).join(sizes.select("qid", F.col(column).alias("_most")), "qid").where(F.col("pos") <= F.col("_most")).drop("_most")


def keyword_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): the query shingles that the keyword channel looks up."""
    return queries.select("qid", F.explode(query_shingles(F.col("query"))).alias("term"))


def keyword_matches(terms: DataFrame, postings: DataFrame, most: int | None = None) -> DataFrame:
    """Number of a query's terms (qid, term) that each record has; with `most` only the best records of each query, found in blocks (see
    blocks.products), as a query's common terms are in nearly every record."""
    if most is not None:
        found = blocks.products([(_counted(terms, "qid"), _counted(postings, "mid"))], most)
        return found.select("qid", "mid", F.col("s0").cast("long").alias("score"))
    return terms.join(postings, "term").groupBy("qid", "mid").agg(F.count(F.lit(1)).alias("score"))


def keyword_channel(queries: DataFrame, postings: DataFrame, most: int | None = None) -> DataFrame:
    """Number of distinct query shingles among a record's keywords: an equi join on the term, or in blocks (see keyword_matches)."""
    return keyword_matches(keyword_terms(queries), postings, most)


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """(key, term, w) of rows of terms, w how often a term is there."""
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("w"))


def query_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, entity) of known entities that a query's text contains.

    Queries are exploded to substrings of the lengths that entities have, so this is an equi join whatever the dictionary's size.
    """
    names = entities.select("entity").distinct()
    lengths = names.select(F.length("entity").alias("n")).where("n > 0").distinct()
    sized = queries.where(F.length("query") > 0).select("qid", "query", F.explode(F.sequence(F.lit(1), F.length("query"))).alias("n")).join(lengths, "n")
    parts = sized.select("qid", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("query") - F.col("n") + 1), lambda i: F.substring("query", i, F.col("n"))))).alias("entity"))
    return parts.join(names, "entity").select("qid", "entity").distinct()


def entity_channel(found: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """Number of the query's entities on each record, or of the best ones only. found: (qid, entity)."""
    if most is not None:
        return keyword_matches(found.withColumnRenamed("entity", "term"), links.select("mid", F.col("entity").alias("term")), most)
    return found.join(links, "entity").groupBy("qid", "mid").agg(F.count(F.lit(1)).alias("score"))


def pending_channel(queries: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending rows (mid, content, importance) that contain query words; score is importance, match the share of the words.

    Substrings of the rows' distinct tokens, up to the longest query word, meet the query words in an equi join. The words that a row has go
    into one list, written once to the shared folder; rows and queries meet in blocks, so no row for each query and record is shuffled.
    """
    words = queries.select("qid", F.array_distinct(extract_all(F.lower("query"), "[\\x{4e00}-\\x{9fa5}]+|[a-zA-Z]+")).alias("w")).where(F.size("w") > 0)
    vocabulary = words.select(F.explode("w").alias("word")).distinct()
    tokens = pending.select(F.explode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("t")).distinct()
    # A word lies in a content if and only if it lies in one of its tokens (words hold no space).
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    parts = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.length("t") - i + 1, F.lit(longest))), lambda k: F.substring("t", i, k)))
    grams = tokens.where((F.length("t") > 0) & F.lit(longest > 0)).select("t", F.explode(F.array_distinct(F.flatten(parts))).alias("word"))
    pairs = grams.join(vocabulary, "word").select("t", "word")
    rows = pending.select("mid", "importance", F.explode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("t"))
    known = pairs.groupBy("t").agg(F.collect_set("word").alias("w"))  # a token's words are one row of the join, however many they are
    hits = rows.join(known, "t").groupBy(F.col("mid").cast("long").alias("id"), F.col("importance").cast("double").alias("score")).agg(F.array_distinct(F.flatten(F.collect_set("w"))).alias("w"))
    hits = stored(hits, "words")
    asked = words.select(F.col("qid").cast("long").alias("id"), F.lit(None).cast("double").alias("score"), "w")
    sizes = blocks.sides_of((asked.count(), hits.count()), (256, 8192))
    met = blocks.grid(asked, hits, sizes, "id", _matches, "qid long, mid long, score double, match double")
    own = lambda df, c: F.col(c).cast(df.schema[c].dataType)
    return met.select(own(queries, "qid"), own(pending, "mid"), "score", "match")


def _matches(asked: pa.Table, hits: pa.Table) -> pa.Table:
    """J04 for two blocks: queries and rows that have words in common, with the share of the query's words."""
    words = blocks.Sets(asked["w"], hits["w"])
    n, out = asked["w"].combine_chunks().value_lengths().to_numpy(), []
    for low, high in blocks.tiles(words.na, words.nb):
        common = words.common(low, high)
        row, at = np.nonzero(common)
        out.append((low + row, at, common[row, at].astype(np.float64) / n[low + row]))
    row, at, match = map(np.concatenate, zip(*out, strict=True))
    return pa.table({"qid": asked["id"].take(row), "mid": hits["id"].take(at), "score": hits["score"].take(at), "match": match})


def external_channel(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """External hits (qid, snippet, score) joined to records by the id in the snippet. memories: (mid, id)."""
    return hits.withColumn("id", id_in_text(F.col("snippet"))).where("id <> ''").join(memories.select("mid", "id"), "id").select("qid", "mid", "score")


def term_counts(memories: DataFrame) -> DataFrame:
    """(mid, term, tf) of lower-cased alphanumeric words."""
    return memories.select("mid", F.explode(extract_all(F.lower("content"), "[a-z0-9]+")).alias("term")).groupBy("mid", "term").agg(F.count(F.lit(1)).alias("tf"))


def _tfidf_weights(queries: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, term, qtf) and (mid, term, idf, w, size) of G03."""
    tf = term_counts(memories)
    n = memories.agg(F.count(F.lit(1)).alias("N"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    size = weighted.groupBy("mid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    q = term_counts(queries.select(F.col("qid").alias("mid"), F.col("query").alias("content"))).select(F.col("mid").alias("qid"), "term", F.col("tf").alias("qtf"))
    return q, weighted.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").join(size, "mid")


def tfidf_terms(queries: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G03's scores as sums of products: (qid, term, w) and (mid, term, w)."""
    q, weighted = _tfidf_weights(queries, memories)
    return q.withColumnRenamed("qtf", "w"), weighted.select("mid", "term", (F.col("idf") * F.col("w") / F.col("size")).alias("w"))


def tfidf_channel(queries: DataFrame, memories: DataFrame, most: int | None = None) -> DataFrame:
    """Sum over shared terms of qtf * tf * idf^2 with idf = ln((1 + N) / (1 + df)) + 1, over the record's vector length; with `most`
    only the best records of each query, found in blocks."""
    if most is not None:
        return blocks.products([tfidf_terms(queries, memories)], most).withColumnRenamed("s0", "score")
    q, weighted = _tfidf_weights(queries, memories)
    dots = q.join(weighted, "term").groupBy("qid", "mid").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("w")).alias("dot"), F.first("size").alias("size"))
    return dots.select("qid", "mid", (F.col("dot") / F.col("size")).alias("score"))


def reduced_query(query: Column) -> Column:
    """ASCII words and Han runs of 3 (else 2) characters of a query, else the query."""
    words = F.concat(extract_all(query, "[A-Za-z][A-Za-z0-9_-]+"), extract_all(query, "[\\x{4e00}-\\x{9fa5}]{3,}"))
    two = extract_all(query, "[\\x{4e00}-\\x{9fa5}]{2,}")
    return F.when(F.size(words) > 0, F.array_join(words, " ")).when(F.size(two) > 0, F.array_join(two, " ")).otherwise(query)


def bm25_channel(queries: DataFrame, memories: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)) over distinct query terms."""
    tf = term_counts(memories)
    length = tf.groupBy("mid").agg(F.sum("tf").alias("dl"))
    stats = length.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    q = queries.select("qid", F.explode(F.array_distinct(extract_all(F.lower(reduced_query(F.col("query"))), "[a-z0-9]+"))).alias("term"))
    rows = q.join(df, "term").join(tf, "term").join(length, "mid").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("qid", "mid").agg(F.sum(part).alias("score"))


def dot(a, b):
    """The scalar product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def best_cosines(asked: pa.Table, met: pa.Table, k: int, digits: int) -> pa.Table:
    """The k rows of met with the largest cosines (equal to so many digits: the least mid first) for each row of asked. v: vectors."""
    wide = lambda t: np.stack(t["v"].to_numpy(zero_copy_only=False)).astype(np.float64)
    met = met.sort_by("mid")
    q, v = wide(asked), wide(met)
    q, v = q / np.sqrt((q * q).sum(1, keepdims=True)), v / np.sqrt((v * v).sum(1, keepdims=True))
    qid, mid = asked["mid"].to_numpy(), met["mid"].to_numpy()
    step, out = max(1, COSINES // len(mid)), []
    for low in range(0, len(qid), step):
        cosine = q[low : low + step] @ v.T
        place = np.floor(cosine * 10.0**digits + 0.5)
        if k < len(mid):
            least = -np.partition(-place, k - 1, axis=1)[:, k - 1]
            row, at = np.nonzero(place >= least[:, None])
            order = np.lexsort((at, -place[row, at], row))  # mids ascend
            row, at = row[order], at[order]
            some = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at = row[some], at[some]
        else:
            row, at = (x.ravel() for x in np.indices(cosine.shape))
        out.append((qid[low:][row], mid[at], cosine[row, at]))
    return pa.table(dict(zip(("qid", "mid", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def vector_channel(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Exact cosine of queries (qid, qv) with all vectors (mid, v), top k; vectors of length 0 match nothing. Blocks of queries meet
    blocks of vectors as products of matrices, each of which gives k rows a query; a vector is read once for each block of queries."""
    some = lambda df: df.where(dot(F.col("v"), F.col("v")) > 0)
    asked, met = some(queries.select(F.col("qid").alias("mid"), F.col("qv").alias("v"))), some(vectors.select("mid", "v"))
    sizes = blocks.side_of(asked.count(), 4096), blocks.side_of(met.count(), 32768)
    found = blocks.grid(asked, met, sizes, "mid", partial(best_cosines, k=k, digits=digits), "qid long, mid long, score double")
    return top(found.select("qid", "mid", F.round("score", digits).alias("score")), k)


def hybrid(keyword: DataFrame, vector: DataFrame, weights=(0.3, 0.7), least: float = 0.2) -> DataFrame:
    """Weighted sum of both channels' scores; rows under the least go."""
    a, b = keyword.select("qid", "mid", F.col("score").alias("a")), vector.select("qid", "mid", F.col("score").alias("b"))
    zero = F.lit(0.0)
    out = a.join(b, ["qid", "mid"], "full").select("qid", "mid", (weights[0] * F.coalesce("a", zero) + weights[1] * F.coalesce("b", zero)).alias("score"))
    return out.where(F.col("score") >= least)


def hybrid_search(queries: DataFrame, memories: DataFrame, postings: DataFrame, weights=(0.3, 0.7), least: float = 0.2, digits: int = 9) -> DataFrame:
    """G06 over the keyword and TF-IDF (to so many digits) channels of all records: both scores of a pair come from one block, so neither
    channel is shuffled."""
    keyword = _counted(keyword_terms(queries), "qid"), _counted(postings, "mid")
    both = blocks.products([keyword, tfidf_terms(queries, memories)], of=1)
    score = weights[0] * F.col("s0") + weights[1] * F.round("s1", digits)
    return both.select("qid", "mid", score.alias("score")).where(F.col("score") >= least)


def index_refresh(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Total, indexed and missing numbers of records."""
    have = vectors.select("mid").distinct().withColumn("have", F.lit(True))
    return memories.select("mid").join(have, "mid", "left").agg(F.count(F.lit(1)).alias("total"), F.count("have").alias("indexed"), F.count_if(F.col("have").isNull()).alias("missing"))


def reciprocal_ranks(channels: list[DataFrame], k: int = 60) -> DataFrame:
    """(qid, mid, score) of channels with positions (qid, mid, pos): sum of 1 / (k + pos)."""
    rows = channels[0].select("qid", "mid", "pos")
    for c in channels[1:]:
        rows = rows.unionByName(c.select("qid", "mid", "pos"))
    return rows.groupBy("qid", "mid").agg(F.sum(F.lit(1.0) / (k + F.col("pos"))).alias("score"))


def fuse(channels: list[DataFrame], top_n, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion, the best top_n records of each query."""
    return top(reciprocal_ranks(channels, k), top_n)


def merge_by_priority(channels: list[DataFrame]) -> DataFrame:
    """First occurrence of a record over channels in order of priority."""
    rows = None
    for i, c in enumerate(channels):
        own = c.select("qid", "mid", "score", "pos", F.lit(i).alias("channel"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("qid", "mid").agg(F.min(F.struct("channel", "pos", "score")).alias("f")).select("qid", "mid", "f.channel", "f.pos", "f.score")


def rerank(candidates: DataFrame, memories: DataFrame, as_of_s: int) -> DataFrame:
    """P24 on candidates (qid, mid, score) with their records' importance, score and access time; records with is_identity fade
    half as fast."""
    known = "is_identity" in memories.columns
    m = memories.select("mid", "importance", F.col("score").alias("memory_score"), "last_accessed_s", *(["is_identity"] if known else []))
    identity = F.coalesce("is_identity", F.lit(False)) if known else None
    score = R.rerank_score(F.col("score"), F.col("memory_score"), F.col("importance"), F.col("last_accessed_s"), F.lit(as_of_s), identity)
    return candidates.join(m, "mid").select("qid", "mid", "memory_score", score.alias("score"))


def spread(results: DataFrame, links: DataFrame, facts: DataFrame, factor: float = 0.3, seeds: int = 5, per_entity: int = 5, most: int = 3, *, most_results: int) -> DataFrame:
    """Facts that share an entity with a query's first results and aren't among them: at most per_entity for each entity,
    best score first, then `most` for each query, at score * factor.

    Results hold at most most_results rows a query, so an entity's first per_entity + most_results facts always hold those
    that remain: an entity of very many facts is cut to them, before the shuffle too, and never meets every query.
    """
    hot = results.where(F.col("pos") <= seeds).join(links, "mid").select("qid", "entity").distinct()
    ranked = Window.partitionBy("entity").orderBy(F.desc("score"), "mid")
    first = links.join(facts.select("mid", "score"), "mid").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= per_entity + most_results).drop("r")
    near = hot.join(first, "entity").join(results.select("qid", "mid"), ["qid", "mid"], "left_anti")
    w = Window.partitionBy("qid", "entity").orderBy(F.desc("score"), "mid")
    kept = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_entity)
    best = kept.groupBy("qid", "mid").agg((F.max("score") * factor).alias("score"))
    return top(best, most)


def prompt_block(results: DataFrame, max_tokens: int = 500) -> DataFrame:
    """Text for a prompt: up to 5 direct lines, up to 3 marked ones, cut to max_tokens / 1.5 characters.
    results: (qid, pos, mid, mtype, content, tier)."""
    w = Window.partitionBy("qid", "tier").orderBy("pos")
    r = results.where("tier <> 'reference'").withColumn("r", F.row_number().over(w)).where("(tier = 'direct' AND r <= 5) OR (tier = 'marked' AND r <= 3)")
    tag = F.concat(F.lit("- ["), F.upper(F.substring("mtype", 1, 1)), F.lit("] "))
    line = F.when(F.col("tier") == "direct", F.concat(tag, F.substring("content", 1, 200))).otherwise(F.concat(tag, F.substring("content", 1, 150), F.lit(" (ref:"), F.col("mid"), F.lit(")")))
    lines = r.withColumn("line", line).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tier", "r", "line"))).alias("l"), F.max(F.col("tier") == "direct").alias("d"))
    head = F.when(F.col("d"), "## 相关记忆\n").otherwise("## 可能相关\n")
    text = F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    limit = int(max_tokens / 1.5)
    return lines.select("qid", F.when(F.length(text) * 1.5 > max_tokens, F.concat(F.substring(text, 1, limit), F.lit("\n..."))).otherwise(text).alias("block"))


def channel_stats(channels: dict[str, DataFrame]) -> DataFrame:
    """Rows of each channel by query."""
    rows = None
    for name, c in channels.items():
        own = c.select("qid", F.lit(name).alias("channel"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("qid").pivot("channel", list(channels)).count().na.fill(0)


def entity_first(entity: DataFrame, keyword: DataFrame, limit: int = 10, enough: float = 0.85) -> DataFrame:
    """Entity results; where none is good enough, keyword results fill the remaining places with records not yet found."""
    first = top(entity, limit).withColumn("channel", F.lit("entity"))
    state = first.groupBy("qid").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    more = keyword.join(first.select("qid", "mid"), ["qid", "mid"], "left_anti").join(state, "qid", "left").where(F.coalesce("best", F.lit(0.0)) <= enough)
    more = top(more.select("qid", "mid", "score", (limit - F.coalesce("n", F.lit(0))).alias("room")), limit).where(F.col("pos") <= F.col("room"))
    return first.select("qid", "mid", "score", "channel").unionByName(more.select("qid", "mid", "score", F.lit("keyword").alias("channel")))


def enriched(hits: DataFrame, memories: DataFrame, limit: int = 15) -> DataFrame:
    """0.4 * search + 0.35 * memory score + 0.25 * importance, the best ones of each query."""
    m = memories.select("mid", F.col("score").alias("s"), "importance")
    return top(hits.join(m, "mid").select("qid", "mid", (0.4 * F.col("score") + 0.35 * F.col("s") + 0.25 * F.col("importance")).alias("score")), limit)


class Routed(NamedTuple):
    """results: (qid, mid, pos, score, tier, source); stats: rows of each channel, merged and final, by query."""

    results: DataFrame
    stats: DataFrame


def query_sizes(queries: DataFrame, triggers=None, precise=L.PRECISE_WORDS, broad=L.BROAD_WORDS, class_sizes=L.QUERY_SIZES) -> DataFrame:
    """(qid, layer, trigger, matched, class, initial, rerank, final)."""
    layered = queries.select("qid", "query", R.trigger(F.col("query"), **({"triggers": triggers} if triggers else {})).alias("t"))
    kinds = layered.select("qid", "t.*", R.query_class(F.col("query"), F.col("t.layer"), precise, broad).alias("class"))
    return kinds.withColumns({name: R.size_of(F.col("class"), i, class_sizes) for i, name in enumerate(("initial", "rerank", "final"))})


def route(
    queries: DataFrame, memories: DataFrame, links: DataFrame, postings: DataFrame, as_of_s: int, *, pending: DataFrame | None = None, external: DataFrame | None = None, query_vectors: DataFrame | None = None,
    vectors: DataFrame | None = None, tfidf: bool = True, triggers=None, precise=L.PRECISE_WORDS, broad=L.BROAD_WORDS, time_words: dict[str, int] | None = None, threshold: float = 0.5, class_sizes=L.QUERY_SIZES,
) -> Routed:
    """The whole router over a batch of queries (qid, query).

    A query with a relative time whose day has records gets these and nothing else (J16). For the others, rows of pending
    (J04) come first; TF-IDF (G03), external hits such as bm25_channel's (G04, J13), keyword (J01), entity (J02) and vector
    (G05) channels, each cut to the query class's first size, are fused by reciprocal ranks and cut to the second. Without
    TF-IDF the first channel that has a record decides instead (G02). Then rerank (P24), inhibition of records with entities
    that are like the query's but not equal (J10), cut to the second size, spread (J11) and cut to the last size; what spreads
    comes after it. Tiers by the records' own scores (P27). What several parts need (timed rows, queries with their sizes and
    entities, channels, reranked rows) is written once to the shared folder.
    """
    initial, second, _ = (max(x) for x in zip(*class_sizes.values(), strict=True))
    ranged = queries.select("qid", temporal.time_range(F.col("query"), F.lit(as_of_s), time_words).alias("r")).select("qid", "r.*")
    timed = temporal.in_range(ranged.where("from_s IS NOT NULL"), memories).join(memories.select("mid", "score"), "mid").select("qid", "mid", "score")
    timed = stored(timed, "timed")
    queries = stored(queries.join(timed.select("qid").distinct(), "qid", "left_anti"), "queries")
    sizes = stored(query_sizes(queries, triggers, precise, broad, class_sizes), "sizes")
    found = stored(query_entities(queries, links), "found")
    channels = {"tfidf": tfidf_channel(queries, memories, initial)} if tfidf else {}
    if external is not None:
        channels["external"] = external.join(queries.select("qid"), "qid", "left_semi").select("qid", "mid", "score")
    channels |= {"keyword": keyword_channel(queries, postings, initial), "entity": entity_channel(found, links, initial)}
    if vectors is not None:
        channels["vector"] = vector_channel(query_vectors.join(queries.select("qid"), "qid", "left_semi"), vectors, initial)
    channels = {k: stored(cut(c, sizes, "initial", initial), k) for k, c in channels.items()}
    every = memories
    first = None
    if pending is not None:
        first = stored(pending_channel(queries, pending).select("qid", "mid", "score"), "pending")
        every = memories.unionByName(pending.join(memories.select("mid"), "mid", "left_anti"), allowMissingColumns=True)
    if tfidf:
        merged = cut(reciprocal_ranks(list(channels.values())), sizes, "rerank", second).select("qid", "mid", "score")
    else:
        order = [channels[k] for k in ("vector", "external", "keyword", "entity") if k in channels]
        merged = merge_by_priority(order).select("qid", "mid", F.col("score").cast("double").alias("score"))
    if first is not None:
        merged = first.unionByName(merged.join(first.select("qid", "mid"), ["qid", "mid"], "left_anti"))
    scored = rerank(merged, every, as_of_s)
    ranked = cut(inhibit(scored.select("qid", "mid", "score"), found.withColumnRenamed("entity", "q"), links, threshold=threshold), sizes, "rerank", second)
    ranked = stored(ranked.select("qid", "mid", "pos", "score"), "ranked")
    final = ranked.join(sizes.select("qid", F.col("final").alias("_n")), "qid").where(F.col("pos") <= F.col("_n")).drop("_n").withColumn("source", F.lit("search"))
    bonus = spread(ranked, links, memories.where("mtype = 'fact'"), most_results=second).select("qid", "mid", (F.col("pos") + 1000).alias("pos"), "score", F.lit("spread").alias("source"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "mid")
    timed = timed.select("qid", "mid", F.row_number().over(w).alias("pos"), "score", F.lit("temporal").alias("source"))
    rows = timed.unionByName(final).unionByName(bonus).join(every.select("mid", F.col("score").alias("memory_score")), "mid")
    results = rows.select("qid", "mid", "pos", "score", R.injection_tier(F.col("memory_score")).alias("tier"), "source")
    parts = {**channels, **({} if first is None else {"pending": first}), "merged": merged, "final": results}
    return Routed(results, channel_stats(parts))


def search_view(results: DataFrame, memories: DataFrame, n: int = 10) -> DataFrame:
    """The first n results of each query as lines, with the numbers of direct, marked and reference ones. results: as Routed."""
    count = lambda t: F.count_if(F.col("tier") == t).alias(t)
    tiers = results.groupBy("qid").agg(count("direct"), count("marked"), count("reference"))
    w = Window.partitionBy("qid").orderBy("pos", "mid")
    head = results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).join(memories.select("mid", "mtype", "content", "importance"), "mid")
    line = F.concat(F.lit("["), F.upper(F.substring("mtype", 1, 1)), F.lit("] "), F.substring("content", 1, 50), F.lit("..."))
    return head.join(tiers, "qid").select("qid", "place", "mid", line.alias("line"), "score", "importance", "direct", "marked", "reference")
