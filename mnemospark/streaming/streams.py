"""Streaming forms (ST1-ST6). Times are event times in a timestamp column `ts`."""

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import urgency
from ..plans import jobs
from ..sources import versions


def pending_stream(messages: DataFrame, delay: str = "24 hours", **lexicon) -> DataFrame:
    """ST1: messages (id, content, ts) tagged with urgency; an id seen within the watermark is dropped, in other batches too."""
    tagged = messages.withColumn("u", urgency(F.col("content"), **lexicon)).select("id", "ts", "content", "u.urgent", "u.importance", "u.category")
    return tagged.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def drain(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str):
    """ST2: run a batch job on each micro-batch; the checkpoint takes the place of emptying the buffer."""
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consolidate_pending(root: str, importance: Column, identity: Column, threshold: float = 0.5) -> Callable[[DataFrame, int], None]:
    """ST2: the job that turns a micro-batch of pending rows (C02) into records of a versioned table; a batch counts once."""

    def job(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = versions.current(spark, root)
        if batch_id > last.note.get("batch", -1):
            part = versions.new_part(jobs.mini_consolidate(batch, importance, identity, threshold), root)
            versions.publish(spark, root, last, [*last.parts, part], {"batch": batch_id})

    return job


# --- ST3: access counts -------------------------------------------------------------------------------------------------

_COUNTS = {"accesses": None, "retrieval": "retrieval", "used_in_response": "used_in_response", "user_mentioned": "user_mentioned"}


def access_counts(log: DataFrame, delay: str = "1 day", size: str = "1 day") -> DataFrame:
    """ST3: accesses (mid, access_type, ts) by day and record, with the last access."""
    g = log.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "mid")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("access_type") == "retrieval").alias("retrieval"), F.max("ts").alias("last"))
    return out.select(F.col("w.start").alias("day"), "mid", "n", "retrieval", "last")


def summed(parts: DataFrame) -> DataFrame:
    """Counts of several parts, one row for each record."""
    return parts.groupBy("mid").agg(*(F.sum(c).alias(c) for c in _COUNTS), F.max("last_s").alias("last_s"))


def counted(log: DataFrame) -> DataFrame:
    """A log's accesses (mid, access_type, ts) as a part."""
    count = lambda kind: F.count(F.lit(1)) if kind is None else F.count_if(F.col("access_type") == kind)
    return log.groupBy("mid").agg(*(count(kind).alias(name) for name, kind in _COUNTS.items()), F.max(F.unix_seconds("ts")).alias("last_s"))


def merge_accesses(root: str, delay_s: int, compact_after: int = 8) -> Callable[[DataFrame, int], None]:
    """ST3: a foreachBatch job that adds a batch's accesses (mid, access_type, ts) to the counts under root.

    A batch becomes one part of the next version, whose note has the batch id, so a batch that is played again changes nothing
    and one that fails leaves no trace. Rows more than delay_s older than the newest row of earlier batches are late: they aren't
    counted but go to a side table (late_accesses). Many parts are summed into one.
    """

    def job(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = versions.current(spark, root)
        if batch_id <= last.note.get("batch", -1):
            return
        rows = batch.select("mid", "access_type", "ts").persist()
        newest = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
        seen = last.note.get("newest_us")
        on_time = F.lit(True) if seen is None else F.unix_micros("ts") >= seen - delay_s * 1_000_000
        parts = [*last.parts, versions.new_part(counted(rows.where(on_time)), root)]
        late = last.note.get("late", [])
        if seen is not None and not rows.where(~on_time).isEmpty():
            late = [*late, versions.new_part(rows.where(~on_time), root)]
        if len(parts) > compact_after:
            parts = [versions.new_part(summed(spark.read.parquet(*parts)), root)]
        newest = max((x for x in (seen, newest) if x is not None), default=None)
        versions.publish(spark, root, last, parts, {"batch": batch_id, "newest_us": newest, "late": late})
        rows.unpersist()

    return job


def merged_accesses(spark: SparkSession, root: str) -> DataFrame:
    """ST3: (mid, accesses, retrieval, used_in_response, user_mentioned, last_s) of all batches so far, as curate.access_stats."""
    return summed(versions.read(spark, root))


def late_accesses(spark: SparkSession, root: str) -> DataFrame:
    """ST3: the side table of late rows (mid, access_type, ts)."""
    late = versions.current(spark, root).note.get("late", [])
    schema = "mid long, access_type string, ts timestamp"
    return spark.read.schema(schema).parquet(*late) if late else spark.createDataFrame([], schema)


# --- ST4: expiry --------------------------------------------------------------------------------------------------------


def expired(records: DataFrame, as_of_s: int) -> DataFrame:
    """ST4: records whose expiry has passed, as they arrive; the stateless form of the batch filter."""
    return records.where(F.col("expires_s") <= as_of_s)


class ExpiryTimers(StatefulProcessor):
    """For each id the newest version's expiry and one timer for it; a newer version cancels the timer of the one before."""

    def init(self, handle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "ts_us long, expires_s long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = tuple(self.record.get()) if self.record.exists() else None
        none = -(1 << 62)  # no expiry: kept in state, so that an older version that comes later doesn't set a timer
        new = max([*([old] if old else []), *((r["ts_us"], none if r["expires_s"] is None else r["expires_s"]) for r in rows)])
        if new != old:
            if old and old[1] != none:
                self.handle.deleteTimer(old[1] * 1000)
            if none != new[1] and new[1] * 1000 <= timerValues.getCurrentWatermarkInMs():
                self.record.clear()
                yield Row(mid=key[0], expires_s=new[1])
                return
            self.record.update(new)
            if new[1] != none:
                self.handle.registerTimer(new[1] * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expires_s = self.record.get()[1]
        self.record.clear()
        yield Row(mid=key[0], expires_s=expires_s)

    def close(self) -> None:
        pass


def expire_by_timer(updates: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST4: (mid, expires_s) of each record when the watermark passes the expiry of its newest version.

    updates: versions (mid, expires_s, ts), in any order and over any number of batches; the greatest (ts, expires_s) is the
    newest. A null expiry never fires. Rows later than the watermark are dropped. A record is forgotten once it has expired: a
    version that comes after that starts it anew. Needs the RocksDB state store (see rocksdb).
    """
    rows = updates.select("mid", "expires_s", "ts", F.unix_micros("ts").alias("ts_us")).withWatermark("ts", delay)
    return rows.groupBy("mid").transformWithState(ExpiryTimers(), "mid long, expires_s long", "append", "eventTime")


def rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- ST5 and ST6 --------------------------------------------------------------------------------------------------------


def _joined(sessions: list[np.ndarray], user: np.ndarray, ts: np.ndarray, ids: np.ndarray, gap_us: int, last: int) -> list[np.ndarray]:
    """Sessions (user, start, end, n, number of kept events, and these events' times and ids, in order of sessions) with further events: each
    joins its user's sessions that its own gap reaches, and may unite two. A session keeps its last few events."""
    who, start, end, n, kept, old_ts, old_ids = sessions
    who, start, end, n = np.concatenate([who, user]), np.concatenate([start, ts]), np.concatenate([end, ts + gap_us]), np.concatenate([n, np.ones_like(ts)])
    own = np.concatenate([np.repeat(np.arange(len(kept)), kept), len(kept) + np.arange(len(ts))])
    ts, ids = np.concatenate([old_ts, ts]), np.concatenate([old_ids, ids])
    order = np.lexsort((start, who))
    who, start, end, n = who[order], start[order], end[order], n[order]
    other = np.concatenate([[True], who[1:] != who[:-1]])
    # Times as ranks, a range of them for each user, so one running maximum serves all.
    place = np.unique(np.concatenate([start, end]), return_inverse=True)[1] + np.tile(np.cumsum(other) * (2 * len(start)), 2)
    first = other | np.concatenate([[True], place[1 : len(start)] >= np.maximum.accumulate(place[len(start) :])[:-1]])
    at, group = np.flatnonzero(first), np.empty(len(start), np.int64)
    group[order] = np.cumsum(first) - 1
    event = group[own]
    latest = np.lexsort((-ids, -ts, event))
    event, ts, ids = event[latest], ts[latest], ids[latest]
    keep = np.arange(len(event)) - np.searchsorted(event, event) < last
    return [who[at], start[at], np.maximum.reduceat(end, at), np.add.reduceat(n, at), np.bincount(event[keep], minlength=len(at)), ts[keep], ids[keep]]


def _closed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, gap_us: int, last: int) -> Iterator[pd.DataFrame]:
    """The events that a batch has of a group of users join the open sessions in state; those whose end the watermark has passed are given
    and forgotten."""
    sessions = [np.array(x, np.int64) for x in (state.get if state.exists else ((),) * 7)]
    if not state.hasTimedOut:
        for f in frames:
            if len(f):
                sessions = _joined(sessions, *(f[c].to_numpy() for c in ("user", "ts_us", "event_id")), gap_us, last)
    user, start, end, n, kept, ts, ids = sessions
    over = end <= state.getCurrentWatermarkMs() * 1000
    if over.all():
        state.remove()
    else:
        event = ~np.repeat(over, kept)
        state.update(tuple(x.tolist() for x in (user[~over], start[~over], end[~over], n[~over], kept[~over], ts[event], ids[event])))
        state.setTimeoutTimestamp(int(-(-end[~over].min() // 1000)) - 1)  # a time-out comes once the watermark is past it
    if over.any():
        bounds = np.concatenate([[0], np.cumsum(kept)])
        names = list(map(str, ids.tolist()))
        texts = [",".join(names[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(over)]
        yield pd.DataFrame({"user_id": [None] * len(texts) if key[0] < 0 else user[over], "start_us": start[over], "end_us": end[over], "n": n[over], "last": texts})


def intents(messages: DataFrame, gap_s: int = 1800, delay: str = "30 minutes", last: int = 10, groups: int = 1024) -> DataFrame:
    """ST5: closed sessions of a user's events (user_id, ts, event_id) by a gap: start_us, end_us, n and the last few ids, newest
    first. Only these ids are kept in state, however long a session is. Append mode.

    State is kept for groups of users (by hash), as flat lists that come and go with the events, so a batch costs one call for each group and
    none for a user or session. A task holds one group's open sessions: more groups make them smaller.
    """
    group = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(groups)))
    user = F.coalesce(F.col("user_id").cast("long"), F.lit(0))
    rows = messages.select(group.cast("int").alias("group"), user.alias("user"), "event_id", "ts", F.unix_micros("ts").alias("ts_us")).withWatermark("ts", delay)
    kind = "user_id long, start_us long, end_us long, n long, last string"
    state = ", ".join(f"{c} array<long>" for c in ("user", "start_us", "end_us", "n", "kept", "ts_us", "ids"))
    closed = partial(_closed, gap_us=gap_s * 1_000_000, last=last)
    return rows.groupBy("group").applyInPandasWithState(closed, kind, state, "append", GroupStateTimeout.EventTimeTimeout)


def look_back(messages: DataFrame, size: str = "24 hours", slide: str = "1 hour", delay: str = "24 hours") -> DataFrame:
    """ST6: events by sliding window and type."""
    g = messages.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
