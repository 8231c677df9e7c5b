"""Streaming queries (ST1-ST6) and file round trips (S01-S03, S09, S10, S17), drained into tables, with the SQL of their batch twins."""

from pyspark.sql import functions as F

from ..sources import io, versions
from ..streaming import streams
from . import fixtures as X
from .rule_queries import IMP, NOISE, Q, has, imp, q

C, LIT = F.col, F.lit
AS = X.AS_OF


def stream(s, d, name):
    return io.stream_table(s, f"{d}/{name}.parquet")


def heartbeat(s, schema, ts_s, **values):
    """One row that moves a stream's watermark to its end; values fill columns that tell it from other rows."""
    value = lambda f: F.timestamp_seconds(LIT(ts_s)) if f.name == "ts" else LIT(values.get(f.name))
    return s.range(1).select(*(value(f).cast(f.dataType).alias(f.name) for f in schema.fields))


FAR = 4102444800  # 2100-01-01


@q("st1_pending_stream", f"SELECT conv_id * 1000 + turn AS id, {has('text', ('worthless', 'nicht', 'pour'))} AS urgent FROM conversations")
def st1(s, d):
    ts = F.timestamp_seconds(LIT(1704067200) + C("conv_id") * 60 + C("turn"))
    m = X.table(s, d, "conversations").select((C("conv_id") * 1000 + C("turn")).alias("id"), ts.alias("ts"), C("text").alias("content"))
    late = F.unix_seconds("ts") + F.when(C("again"), 3600).otherwise(C("id") % 5 * 300)  # each message comes twice, the second time in a later file
    twice = m.withColumn("again", LIT(False)).unionByName(m.withColumn("again", LIT(True)))
    path = io.arriving(twice, late, 5)
    return io.drained(streams.pending_stream(io.arriving_stream(s, path).drop("again"), "24 hours", critical=("worthless",), important=("nicht", "pour"), time=("^$^",))).select("id", "urgent")


@q("st2_drain", f"SELECT mid, substring(mtype, 1, 1) || '_' || strftime(to_timestamp(created_s), '%Y%m%d') || '_' || substring(md5(content), 1, 16) AS id, round({IMP}, 6) AS importance FROM mem WHERE ({NOISE.replace('importance <', 'CAST(0.5 AS DOUBLE) <')}) IS NULL AND ({has('content', ('worthless', 'nicht'))} OR {IMP} >= CAST(0.5 AS DOUBLE))")
def st2(s, d):
    root = io.shared_path(s, "records")
    pending = X.mem(s, d).withColumn("urgent", C("content").rlike("worthless|nicht"))
    src = io.arriving_stream(s, io.arriving(pending, C("created_s"), 4))
    streams.drain(src, streams.consolidate_pending(root, imp(), LIT(False)), io.shared_path(s, "offsets")).awaitTermination()
    return versions.read(s, root).select("mid", "id", F.round("importance", 6).alias("importance"))


@q("st3_access_counts", "SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, (user_id % 100)*1000 + event_id % 4 AS mid, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS retrieval FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2")
def st3(s, d):
    path = io.arriving(accesses(s, d), F.unix_seconds("ts") + C("mid") % 4 * 3600, 4, heartbeat(s, accesses(s, d).schema, FAR, mid=-1))
    out = io.drained(streams.access_counts(io.arriving_stream(s, path))).where("mid >= 0")
    return out.select(C("day").cast("date").cast("string").alias("day"), "mid", "n", "retrieval")


def accesses(s, d):
    kind = F.when(C("event_type") == "view", "retrieval").when(C("event_type") == "click", "used_in_response").otherwise("user_mentioned")
    e = X.table(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    return e.where("event_type IN ('view', 'click', 'purchase')").select(((C("user_id") % 100) * 1000 + C("event_id") % 4).alias("mid"), kind.alias("access_type"), "ts")


@q("st3_merged_accesses", "SELECT mid, count(*) AS accesses, count(*) FILTER (WHERE access_type = 'retrieval') AS retrieval, count(*) FILTER (WHERE access_type = 'used_in_response') AS used_in_response, count(*) FILTER (WHERE access_type = 'user_mentioned') AS user_mentioned, CAST(floor(max(ts_us) / 1000000.0) AS BIGINT) AS last_s FROM access_log GROUP BY mid")
def st3m(s, d):
    root = io.shared_path(s, "accesses")
    late = F.unix_seconds("ts") + F.when(C("mid") % 7 == 0, 20 * 86400).otherwise(0)  # some come many files later
    src = io.arriving_stream(s, io.arriving(accesses(s, d), late, 6))
    streams.drain(src, streams.merge_accesses(root, 86400, compact_after=3), io.shared_path(s, "offsets")).awaitTermination()
    streams.merge_accesses(root, 86400)(streams.late_accesses(s, root), versions.current(s, root).note["batch"])  # played again: no effect
    parts = streams.merged_accesses(s, root).unionByName(streams.counted(streams.late_accesses(s, root)))
    return streams.summed(parts)


@q("st4_expired", f"SELECT mid FROM mem WHERE expires_s <= {AS}")
def st4(s, d):
    c = stream(s, d, "conversations")
    return io.drained(streams.expired(X.mem_columns(c), AS).select("mid"))


@q("st4_timers", f"SELECT mid, e AS expires_s FROM (SELECT mid, CASE WHEN mid % 3 = 0 AND expires_s > created_s + 7200 THEN expires_s + 432000 ELSE expires_s END AS e FROM mem) WHERE e <= {AS}")
def st4t(s, d):
    streams.rocksdb(s)
    first = X.mem(s, d).select("mid", "expires_s", C("created_s").alias("ts_s"))
    again = X.mem(s, d).where("mid % 3 = 0 AND expires_s > created_s + 7200").select("mid", (C("expires_s") + 432000).alias("expires_s"), (C("created_s") + 3600).alias("ts_s"))
    updates = first.unionByName(again).withColumn("ts", F.timestamp_seconds("ts_s")).drop("ts_s")
    path = io.arriving(updates, F.unix_seconds("ts") + C("mid") % 2 * 7000, 5, heartbeat(s, updates.schema, AS + 7200 + 0.5, mid=-1))
    return io.drained(streams.expire_by_timer(io.arriving_stream(s, path), "2 hours"))


@q("st5_intents", "g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, array_to_string(list_slice(list(event_id ORDER BY ts DESC, event_id DESC), 1, 10), ',') AS last FROM k GROUP BY user_id, sid")
def st5(s, d):
    streams.rocksdb(s)
    e = X.table(s, d, "events").select("user_id", "event_id", C("ts").cast("timestamp").alias("ts"))
    path = io.arriving(e, F.unix_seconds("ts") + C("event_id") % 3 * 3000, 3, heartbeat(s, e.schema, FAR, user_id=-1, event_id=-1))
    out = io.drained(streams.intents(io.arriving_stream(s, path), delay="2 hours"))
    return out.where("user_id >= 0").select("user_id", "start_us", "n", "last")


@q("st6_look_back", "SELECT epoch_us(h) AS start_us, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS h FROM events) GROUP BY 1, 2")
def st6(s, d):
    e = X.table(s, d, "events").select("event_type", "event_id", C("ts").cast("timestamp").alias("ts"))
    path = io.arriving(e, F.unix_seconds("ts") + C("event_id") % 3 * 3000, 4, heartbeat(s, e.schema, FAR, event_type="none"))
    out = io.drained(streams.look_back(io.arriving_stream(s, path))).where("event_type <> 'none'")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@q("s01_s02_json_round_trip", "SELECT mid, mtype, content, round(score, 9) AS score FROM mem")
def s01(s, d):
    rows = X.mem(s, d).select("mid", "mtype", "content", "importance", "score", "confidence", "created_s", "ownership")
    return io.read_records(s, io.write_version(rows, io.shared_path(s, "records"))).select("mid", "mtype", "content", F.round("score", 9).alias("score"))


@q("s03_append", "SELECT log_id, mid, access_type FROM access_log")
def s03(s, d):
    path, log = io.shared_path(s, "log"), X.access_log(s, d)
    io.append_records(log.where("log_id % 2 = 0"), path)
    io.append_records(log.where("log_id % 2 = 1"), path)
    return s.read.schema("log_id long, mid long, access_type string").json(path)


@q("s09_migrate", "SELECT mtype, count(*) AS ok, CAST(1 AS BIGINT) AS failed FROM mem GROUP BY mtype")
def s09(s, d):
    paths = {}
    for t in ("fact", "belief", "summary"):
        paths[t] = io.shared_path(s, t)
        rows = X.mem(s, d).where(C("mtype") == t).select("mid", "mtype", "content", "importance", "score", "confidence", "created_s", "ownership")
        rows.select(F.to_json(F.struct("*")).alias("line")).unionByName(rows.select(LIT("{broken").alias("line")).limit(1)).write.text(paths[t])
    return io.migrate_files(s, paths)[1]


@q("s10_dual_write", "SELECT 'json' AS store, mid, entity FROM ent UNION ALL SELECT 'parquet', mid, entity FROM ent")
def s10(s, d):
    a, b = io.shared_path(s, "json"), io.shared_path(s, "parquet")
    io.dual_write(X.ent(s, d), a, b)
    rows = lambda df, name: df.select(LIT(name).alias("store"), "mid", "entity")
    return rows(s.read.schema("mid long, entity string").json(a), "json").unionByName(rows(s.read.parquet(b), "parquet"))


@q("s16_s17_sinks", "SELECT mid, entity FROM ent")
def s17(s, d):
    path = io.shared_path(s, "relations")
    io.write_partitioned(X.ent(s, d), path, "entity", 16)
    return s.read.parquet(path).select("mid", "entity")


@q("s17_bucketed_tables", "SELECT a.mid, b.mid AS other, a.entity FROM ent a JOIN ent b ON a.entity = b.entity AND b.mid = a.mid + 1")
def s17b(s, d):
    import uuid

    links = io.write_bucketed(X.ent(s, d), f"links_{uuid.uuid4().hex}", "entity", 16)
    other = links.select("entity", C("mid").alias("other"))
    return links.join(other, "entity").where("other = mid + 1").select("mid", "other", "entity")


__all__ = ["Q"]
