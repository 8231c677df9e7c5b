"""Composite jobs."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules as R
from ..operators import clean, curate, index, report
from ..sources.io import stored


def extract(segments: DataFrame, importance: Column, identity: Column, threshold: float = 0.3) -> DataFrame:
    """Phases 2 and 3: segments (mid, content, mtype, created_s, ...) to records that pass the filter."""
    kept = clean.importance_filter(segments.drop("importance"), importance, threshold).where("method = 'rule'")
    return clean.records(kept, identity)


class Consolidated(NamedTuple):
    """What a consolidation gives: the next version of the records and all that is derived from it."""

    records: DataFrame
    summaries: DataFrame
    profiles: DataFrame
    postings: DataFrame
    relations: DataFrame
    snapshot: DataFrame
    rankings: DataFrame


def consolidate(memories: DataFrame, segments: DataFrame, links: DataFrame, importance: Column, identity: Column, as_of_s: int, words, negations=L.BELIEF_NEGATIONS, *, threshold: float = 0.7, least: float = 0.05, stale_days: int = 30, trigger: int = 3) -> Consolidated:
    """C01, all phases: expire stored records (0), take and filter segments (1, 2), extract records (3), reconcile them with the
    stored ones, verify new beliefs against stored and new facts (X02), summaries and profiles (4), decay with access
    protection and archive (5), indexes and stale scan (6), snapshot and rankings (7).

    The links, the extracted and the reconciled records are written once to the shared folder; all results derive from them. memories and
    segments are read several times. records: (mid, mtype, content, importance, score, confidence, created_s, state, stale,
    stale_days); state 1 is archived, 2 expired.
    """
    expired, valid = curate.split_expired(memories, as_of_s)
    links = stored(links.select("mid", "entity"), "links")
    new = stored(extract(segments.where(F.length(F.trim("content")) > 5), importance, identity).withColumn("ord", F.col("mid")), "extracted")
    decisions = curate.decide(new, valid, links, threshold, words)
    kept = ["mid", "mtype", "content", "importance", "score", "confidence", "created_s", "last_accessed_s"]
    fresh = new.withColumn("last_accessed_s", F.lit(None).cast("long"))
    verdicts = curate.verify_beliefs(new.where("mtype = 'belief'"), known_facts(valid, new), links, negations)
    current = stored(curate.apply_decisions(valid.select(kept), settle(fresh, verdicts), decisions), "consolidated")
    decayed = current.withColumn("score", R.protected_decay(F.col("score"), F.col("importance"), F.col("mtype"), F.col("last_accessed_s"), F.lit(as_of_s)))
    keep, gone = curate.split_archive(decayed, least)
    active = curate.stale_scan(keep.withColumn("last_verified_s", F.lit(None).cast("long")), as_of_s, stale_days).drop("last_verified_s")
    old = gone.withColumn("state", F.lit(1)).unionByName(expired.select(kept).withColumn("state", F.lit(2)))
    records = active.withColumn("state", F.lit(0)).unionByName(old, allowMissingColumns=True)
    facts = current.where("mtype = 'fact'")
    last = links.join(valid.where("mtype = 'summary'").select("mid", "created_s"), "mid").select("entity", "created_s")
    made = curate.summaries(facts, links, last, as_of_s, F.lit(False), trigger)
    return Consolidated(records, made, curate.profiles(active, links), index.postings(active), index.relation_index(active, links), report.snapshot(active, links), report.top_by(active, "score", 50).select("mid", "score", "rank"))


def known_facts(valid: DataFrame, new: DataFrame) -> DataFrame:
    """Stored facts, then extracted ones, in this order."""
    columns = ["mid", "content", "created_s", "confidence", "ownership", "importance", "score"]
    both = valid.where("mtype = 'fact'").select(*columns, F.col("mid").alias("ord"))
    return both.unionByName(new.where("mtype = 'fact'").select(*columns, (F.col("mid") + F.lit(1 << 60)).alias("ord")))


def settle(current: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New records, once verified: confirmed beliefs become facts, contradicted ones lose confidence."""
    v = verdicts.select("mid", "verdict", F.col("confidence").alias("_c"))
    out = current.join(v, "mid", "left").withColumn("confidence", F.coalesce("_c", "confidence"))
    return out.withColumn("mtype", F.when(F.col("verdict") == "confirmed", "fact").otherwise(F.col("mtype"))).select(current.columns)


def mini_consolidate(pending: DataFrame, importance: Column, identity: Column, threshold: float = 0.5) -> DataFrame:
    """Pending rows (content, urgent, ...) that are urgent or important enough, as records."""
    kept = clean.mini_filter(pending.withColumn("importance", importance), threshold)
    return clean.records(kept, identity)


def rebuild_indexes(memories: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and relations."""
    return index.postings(memories), index.relation_index(memories, links)


def archive(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The listed records go to the archive pool (state 1)."""
    hit = ids.select("mid").distinct().withColumn("_hit", F.lit(True))
    return memories.join(hit, "mid", "left").withColumn("state", F.when(F.col("_hit"), 1).otherwise(F.col("state"))).drop("_hit")
