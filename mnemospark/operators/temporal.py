"""Time: ranges, validity, as-of values, evidence, differences."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import later
from ..functions.text import any_of
from ..sources.io import stored


def time_range(query: Column, as_of_s: Column, words: dict[str, int] | None = None) -> Column:
    """struct of from_s and to_s of a relative expression: the one day that lies so many days back; null without one."""
    words = words or {"上次": 1, "昨天": 1, "上周": 7, "上个月": 30}
    months = F.regexp_extract(query, r"(\d+)\s*(?:个月前|months? ago)", 1)
    days = F.when(months != "", months.cast("long") * 30)
    for w, n in words.items():
        days = days.when(F.contains(query, F.lit(w)), F.lit(n))
    start = as_of_s - days * 86400
    return F.when(days.isNotNull(), F.struct(start.alias("from_s"), (start + 86400).alias("to_s")))


#: Tasks that a day's records are dealt over.
SALTS = 32


def in_range(queries: DataFrame, memories: DataFrame, bucket_s: int = 86400) -> DataFrame:
    """Records created in a query's range: an equi join on day buckets, then the exact test. queries: (qid, from_s, to_s).

    A bucket's records are dealt over SALTS keys, which each range meets, so few days of very many records are no few tasks. The rows
    themselves are as many as records lie in ranges.
    """
    q = queries.withColumn("day", F.explode(F.sequence(F.floor(F.col("from_s") / bucket_s), F.floor((F.col("to_s") - 1) / bucket_s))))
    q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    m = memories.withColumn("day", F.floor(F.col("created_s") / bucket_s)).withColumn("_salt", F.pmod(F.xxhash64("mid"), F.lit(SALTS).cast("long")))
    return q.join(m.select("mid", "created_s", "day", "_salt"), ["day", "_salt"]).where("created_s >= from_s AND created_s < to_s").select("qid", "mid", "created_s")


def validity(versions: DataFrame, bucket_us: int = 30 * 86_400_000_000) -> DataFrame:
    """Each version's end is the next version's start, by entity and attribute.

    A key is split by time: each range is ordered by itself, and its last version ends where the key's next range that has one
    begins. So a key of very many versions is spread over tasks; only the ranges' first starts, one row each, meet by key.
    """
    key = ["entity", "attribute"]
    rows = versions.withColumn("_b", F.floor(F.col("ts_us") / bucket_us))
    starts = rows.groupBy(*key, "_b").agg(F.min("ts_us").alias("_start"))
    starts = starts.select(*key, "_b", F.lead("_start").over(Window.partitionBy(*key).orderBy("_b")).alias("_next"))
    own = rows.withColumn("_own", F.lead("ts_us").over(Window.partitionBy(*key, "_b").orderBy("ts_us", "vid")))
    on = [own[c].eqNullSafe(starts[c]) for c in (*key, "_b")]
    return own.join(starts, on, "left").select(*(own[c] for c in versions.columns), F.coalesce("_own", "_next").alias("valid_to"))


def extracted(memories: DataFrame, links: DataFrame, attributes: dict[str, Column]) -> DataFrame:
    """Versions (vid, entity, attribute, value, ts_us) of what an expression for each attribute (as regexp_extract) finds in
    contents; empty values are none. validity and value_at take them."""
    found = F.array(*(F.struct(F.lit(k).alias("attribute"), F.nullif(v, F.lit("")).alias("value")) for k, v in attributes.items()))
    rows = memories.select(F.col("mid").alias("vid"), "mid", (F.col("created_s") * 1_000_000).alias("ts_us"), F.explode(found).alias("f")).where("f.value IS NOT NULL")
    return rows.join(links, "mid").select("vid", "entity", "f.attribute", "f.value", "ts_us")


def value_at(versions: DataFrame, times: DataFrame, bucket_us: int = 30 * 86_400_000_000) -> DataFrame:
    """For each (tid, entity, attribute, at_us) the value of the version valid then; times before the first have none.

    Versions and times of a key meet in one order, and each time takes the last version before it. Keys are split by time:
    a bucket with no earlier version of its own takes the last one of the buckets before it.
    """
    value = F.struct("ts_us", "vid", "value")
    rows = versions.select("entity", "attribute", F.col("ts_us").alias("at"), F.lit(None).cast(times.schema["tid"].dataType).alias("tid"), value.alias("v"))
    rows = rows.unionByName(times.select("entity", "attribute", F.col("at_us").alias("at"), "tid", F.lit(None).cast(rows.schema["v"].dataType).alias("v")))
    rows = rows.withColumn("b", F.floor(F.col("at") / bucket_us))
    key = ["entity", "attribute"]
    ends = rows.groupBy(*key, "b").agg(F.max("v").alias("last"))
    before = Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, "b", F.last("last", ignorenulls=True).over(before).alias("carried"))
    here = Window.partitionBy(*key, "b").orderBy("at", F.col("v").isNull(), "v.vid").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("own", F.last("v", ignorenulls=True).over(here)).where("v IS NULL").join(ends, [*key, "b"])
    return found.select("tid", *key, F.coalesce("own", "carried").alias("v")).where("v IS NOT NULL").select("tid", *key, "v.vid", "v.value")


def evidence(memories: DataFrame) -> DataFrame:
    """Each record's answer, own id and the ids of all it supersedes (one hop), with their confidence. supersedes: array of ids."""
    hop = memories.select("mid", F.explode("supersedes").alias("e")).join(memories.select(F.col("mid").alias("e"), F.col("confidence").alias("c")), "e")
    g = hop.groupBy("mid").agg(F.array_sort(F.collect_set("e")).alias("ids"), F.min("c").alias("least"))
    ids = F.concat(F.array("mid"), F.coalesce("ids", F.array().cast("array<bigint>")))
    return memories.join(g, "mid", "left").select("mid", F.col("content").alias("answer"), ids.alias("evidence_ids"), F.least("confidence", "least").alias("confidence"))


def evidence_chain(edges: DataFrame, hops: int | None = None) -> DataFrame:
    """J15 over several hops: (mid, evidence, hop), hop the least number of edges between them; edges: (mid, evidence).

    Each step joins what is known with itself, so paths double in length and chains of n take about log2(n) steps; it ends when
    a step changes nothing, so cycles end too (a record of one is its own evidence). hops bounds the length. Steps are written
    to the shared folder.
    """
    known = stored(edges.select("mid", "evidence").where("mid IS NOT NULL AND evidence IS NOT NULL").distinct().withColumn("hop", F.lit(1)), "chain")
    state, length = known.agg(F.count(F.lit(1)), F.sum("hop")).first(), 1
    while hops is None or length < hops:
        further = known.select("mid", F.col("evidence").alias("m"), "hop").join(known.select(F.col("mid").alias("m"), "evidence", F.col("hop").alias("h")), "m")
        both = known.unionByName(further.select("mid", "evidence", (F.col("hop") + F.col("h")).alias("hop")))
        if hops is not None:
            both = both.where(F.col("hop") <= hops)
        known = stored(both.groupBy("mid", "evidence").agg(F.min("hop").alias("hop")), "chain")
        before, state, length = state, known.agg(F.count(F.lit(1)), F.sum("hop")).first(), 2 * length
        if before == state:
            break
    return known


def evidence_roots(memories: DataFrame) -> DataFrame:
    """J15 for chains of any length: (mid, root, hops, confidence, cyclic) of records (mid, supersedes_id, confidence).

    root is the last record of the chain of what each record supersedes, confidence the least on the way. Pointers double at
    each step, so a chain of n takes about log2(n) steps, and rows stay one for each record. A pointer that isn't at an end after
    as many steps as the longest chain could need runs in a cycle: it has no root.
    """
    ids = memories.select("mid", F.col("confidence").alias("c"))
    known = memories.select("mid", F.col("supersedes_id").alias("p"), "confidence").join(ids.withColumnsRenamed({"mid": "p", "c": "pc"}), "p", "left")
    state = known.select("mid", F.when(F.col("pc").isNotNull(), F.col("p")).alias("at"), F.least("confidence", "pc").alias("confidence"))
    state = stored(state.select("mid", F.coalesce("at", "mid").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("hops"), "confidence", F.col("at").isNull().alias("done")), "roots")
    n = state.count()
    for _ in range(max(1, n).bit_length()):
        if state.where("NOT done").isEmpty():
            break
        ahead = state.select(F.col("mid").alias("at"), F.col("at").alias("at2"), F.col("hops").alias("hops2"), F.col("confidence").alias("c2"), F.col("done").alias("done2"))
        step = state.where("NOT done").join(ahead, "at").select("mid", F.col("at2").alias("at"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("confidence", "c2").alias("confidence"), F.col("done2").alias("done"))
        state = stored(state.where("done").unionByName(step), "roots")
    open_ = ~F.col("done")
    return state.select("mid", F.when(~open_, F.col("at")).alias("root"), F.when(~open_, F.col("hops")).alias("hops"), "confidence", open_.alias("cyclic"))


def state_at(memories: DataFrame, as_of_s: int) -> DataFrame:
    """Records that existed and had not expired at a time."""
    return memories.where((F.col("created_s") <= as_of_s) & (F.col("expires_s").isNull() | (F.col("expires_s") > as_of_s)))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(mid, change): added, removed or changed content between two versions."""
    j = old.select("mid", F.col("content").alias("a")).join(new.select("mid", F.col("content").alias("b")), "mid", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("mid", change.alias("change")).where("change IS NOT NULL")


def invalidated(new: DataFrame, old: DataFrame, links: DataFrame, words) -> DataFrame:
    """Old records that a contradicting new one with a shared entity makes invalid.

    Whether some new record of an entity contradicts needs two figures of the entity: has one a contradicting word, and when
    was the newest made. So no pairs are formed.
    """
    made = new.select("mid", any_of(F.lower("content"), words).alias("says"), F.col("created_s").alias("n"))
    marks = links.join(made, "mid").groupBy("entity").agg(F.max("says").alias("says"), F.max("n").alias("n"))
    rows = links.join(old.select("mid", "created_s"), "mid").join(marks, "entity")
    return rows.where(F.col("says") | later(F.col("n"), F.col("created_s"))).select("mid").distinct()
