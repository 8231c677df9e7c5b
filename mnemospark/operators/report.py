"""Statistics, health and snapshot."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import health_status, importance_band
from ..functions.text import floor_days


def active(memories: DataFrame, mtype: str | None = None) -> DataFrame:
    """Active rows, of one type if given, best final score first."""
    out = memories.where("state = 0")
    return (out.where(F.col("mtype") == mtype) if mtype else out).orderBy(F.desc("final_score"), "mid")


def pool_counts(memories: DataFrame) -> DataFrame:
    """Counts by state and type with all totals."""
    return memories.cube("state", "mtype").agg(F.count(F.lit(1)).alias("n"))


def store_stats(memories: DataFrame) -> DataFrame:
    """One row: active, active by type, archived."""
    live = lambda t: F.count_if((F.col("state") == 0) & (F.col("mtype") == t))
    return memories.agg(F.count_if(F.col("state") == 0).alias("active"), live("fact").alias("facts"), live("belief").alias("beliefs"), live("summary").alias("summaries"), F.count_if(F.col("state") == 1).alias("archived"))


def histogram(memories: DataFrame) -> DataFrame:
    """Rows by type and importance band, with the type's whole percent of all rows."""
    n = memories.groupBy("mtype", importance_band(F.col("importance")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    types = n.groupBy("mtype").agg(F.sum("n").alias("t"))
    total = types.agg(F.sum("t").alias("all"))
    return n.join(types, "mtype").crossJoin(F.broadcast(total)).select("mtype", "band", "n", F.floor(F.col("t") * 100 / F.col("all")).alias("percent"))


def rates(rows: DataFrame, column: str) -> DataFrame:
    """Rows by the column's value and their share. The total is a one-row aggregate."""
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select(column, "n", F.round(F.col("n") / F.col("all"), 6).alias("rate"))


def scorer_stats(events: DataFrame, most: int = 5) -> DataFrame:
    """Calls, successes, fallbacks, tokens and the first errors of external scoring, by phase."""
    w = Window.partitionBy("phase").orderBy("eid")
    first = events.where("error IS NOT NULL").select("phase", "eid", "error").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    errors = first.groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("r", "error"))).alias("e"))
    totals = events.groupBy("phase").agg(F.count_if("called").alias("calls"), F.count_if("success").alias("successes"), F.count_if("fallback").alias("fallbacks"), F.sum("tokens").alias("tokens"))
    text = F.coalesce(F.array_join(F.transform("e", lambda e: e["error"]), "|"), F.lit(""))
    return totals.join(errors, "phase", "left").select(*totals.columns, text.alias("errors"))


def health(memories: DataFrame) -> DataFrame:
    """One row of totals: all, active, stale, high priority, conflict. Needs status and importance."""
    count = lambda c: F.count_if(c)
    return memories.agg(F.count(F.lit(1)).alias("total"), count(F.col("status") == "active").alias("active"), count(F.col("status") == "stale").alias("stale"), count(F.col("importance") >= 0.8).alias("high_priority"), count(F.col("status") == "conflict").alias("conflict"))


def entity_counts(links: DataFrame, limit: int | None = None) -> DataFrame:
    """Memories of each entity by name; the first ones if a limit is given."""
    out = links.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy("entity").limit(limit) if limit else out


def violations(memories: DataFrame, links: DataFrame) -> DataFrame:
    """V1: (mid, kind) of rows that break a rule: missing content, wrong type, state or owner, repeated id, orphaned link."""
    bad = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "no_content"), F.when(~F.coalesce(F.col("mtype").isin("fact", "belief", "summary"), F.lit(False)), "type"),
        F.when(~F.coalesce(F.col("state").isin(0, 1, 2), F.lit(False)), "state"), F.when(~F.coalesce(F.col("ownership").isin("user", "assistant", "third_party"), F.lit(False)), "ownership"),
    ))
    rows = memories.select("mid", F.explode(bad).alias("kind"))
    twice = memories.groupBy("mid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", F.lit("repeated").alias("kind"))
    orphans = links.join(memories.select("mid"), "mid", "left_anti").select("mid", F.lit("orphan").alias("kind")).distinct()
    return rows.unionByName(twice).unionByName(orphans)


def migrate(memories: DataFrame) -> DataFrame:
    """V2: adds the columns of the current version that are missing, with their defaults; others stay."""
    new = {"timestamp_s": F.col("created_s"), "session_id": F.lit("legacy"), "source_turn": F.lit(None).cast("int"), "source_quote": F.col("content"), "ownership": F.lit("user"), "supersedes": F.array().cast("array<string>"), "conflict_resolved_s": F.lit(None).cast("long")}
    return memories.withColumns({k: v for k, v in new.items() if k not in memories.columns})


def backfill(memories: DataFrame) -> DataFrame:
    """V3: where timestamp, session or quote is null, all four evidence columns get their defaults."""
    old = F.col("timestamp_s").isNull() | F.col("session_id").isNull() | F.col("source_quote").isNull()
    value = lambda c, v: F.when(old, v).otherwise(F.col(c))
    return memories.withColumns({"timestamp_s": value("timestamp_s", F.col("created_s")), "session_id": value("session_id", F.lit("legacy")), "source_quote": value("source_quote", F.col("content")), "ownership": value("ownership", F.lit("user"))})


def cascade(children: DataFrame, surviving: DataFrame) -> DataFrame:
    """V4: children whose parent survives."""
    return children.join(surviving.select("mid").distinct(), "mid", "left_semi")


def top_by(memories: DataFrame, column: str, n: int) -> DataFrame:
    """The n largest rows by a column, ties by id, with their rank: a top-k, not a global sort."""
    top = memories.orderBy(F.desc(column), "mid").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(column), "mid")))


def top_by_type(memories: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The most important rows of each type, as many as its size."""
    w = Window.partitionBy("mtype").orderBy(F.desc("importance"), "mid")
    limit = F.lit(0)
    for t, n in sizes.items():
        limit = F.when(F.col("mtype") == t, n).otherwise(limit)
    return memories.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def by_dynamic_score(memories: DataFrame, score: Column, n: int = 50) -> DataFrame:
    """The n best records by a score made at read time (P21), to 9 places, with their rank."""
    return top_by(memories.withColumn("dynamic_score", F.round(score, 9)), "dynamic_score", n)


def snapshot(memories: DataFrame, links: DataFrame, sizes=(5, 5, 5, 15, 10)) -> DataFrame:
    """A working-memory snapshot as lines (section, pos, line): critical, high and downgraded records, the ranking, all
    by score, the first entities by name, and totals. memories: active ones; with conflict_downgraded, if it is known."""
    one = F.regexp_replace("content", "\n", " ")
    two = lambda c: F.format_number(c, 2)
    down = F.col("conflict_downgraded") if "conflict_downgraded" in memories.columns else F.lit(False)
    lists = (
        ("critical", F.col("importance") >= 0.9, F.concat(F.lit("- **"), one, F.lit("**"))),
        ("high", (F.col("importance") >= 0.7) & (F.col("importance") < 0.9), F.concat(F.lit("- "), one)),
        ("downgraded", F.coalesce(down, F.lit(False)), F.concat(F.lit("- ~~"), F.substring(one, 1, 40), F.lit("~~ (Score: "), two("importance"), F.lit(" → "), two("score"), F.lit(")"))),
        ("ranking", F.lit(True), F.concat(F.lit("| "), "rank", F.lit(" | "), two("score"), F.lit(" | ["), F.upper(F.substring("mtype", 1, 1)), F.lit("] "), F.substring(one, 1, 40), F.lit(" |"))),
    )
    out = None
    for (name, rows, line), n in zip(lists, sizes, strict=False):
        own = top_by(memories.where(rows), "score", n).select(F.lit(name).alias("section"), F.col("rank").alias("pos"), line.alias("line"))
        out = own if out is None else out.unionByName(own)
    names = entity_counts(links.join(memories.select("mid"), "mid", "left_semi"), sizes[4]).withColumn("pos", F.row_number().over(Window.orderBy("entity")))
    out = out.unionByName(names.select(F.lit("entities").alias("section"), "pos", F.concat(F.lit("- **"), "entity", F.lit("**: "), "n", F.lit(" 条相关记忆")).alias("line")))
    kinds = {"Facts": F.col("mtype") == "fact", "Beliefs": F.col("mtype") == "belief", "Summaries": F.col("mtype") == "summary", "关键信息": F.col("importance") >= 0.9, "重要信息": (F.col("importance") >= 0.7) & (F.col("importance") < 0.9)}
    counts = memories.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in kinds.items()))
    share = lambda k: F.concat(F.lit(" ("), F.floor(F.col(k) * 100 / F.greatest("n", F.lit(1))), F.lit("%)"))
    lines = F.array(*(F.struct(F.lit(i).alias("pos"), F.concat(F.lit(f"- **{k}**: "), k, F.lit(" 条"), share(k) if i < 4 else F.lit("")).alias("line")) for i, k in enumerate(kinds, 1)))
    return out.unionByName(counts.select(F.lit("totals").alias("section"), F.explode(lines).alias("x")).select("section", "x.pos", "x.line"))


SECTIONS = ("critical", "high", "downgraded", "ranking", "entities", "totals")


def snapshot_text(sections: DataFrame) -> DataFrame:
    """One row, the snapshot's text: each section's name and its lines in order; a few dozen lines."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    rows = sections.select(place.alias("s"), F.col("pos").cast("long").alias("pos"), "line")
    heads = sections.select("section").distinct().select(place.alias("s"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("## "), "section").alias("line"))
    return rows.unionByName(heads).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def pending_view(pending: DataFrame, urgent: Column, n: int | None = None) -> DataFrame:
    """Pending rows (ord, content, importance) as lines with an urgency mark, with the totals of A17 on each; the first n."""
    rows = pending.withColumn("urgent", urgent)
    totals = rows.agg(F.count(F.lit(1)).alias("pending"), F.count_if("urgent").alias("urgents"))
    rows = rows.orderBy("ord").limit(n) if n else rows
    line = F.concat(F.when(F.col("urgent"), "🔴").otherwise("⚪"), F.lit(" "), F.substring("content", 1, 50), F.lit("..."))
    return rows.crossJoin(F.broadcast(totals)).select("ord", line.alias("line"), F.round("importance", 1).alias("importance"), "pending", "urgents")


def dashboard(memories: DataFrame, conflict: Column, as_of_s: int, stale_days: int = 30, sizes=None) -> DataFrame:
    """The health dashboard as rows (section, pos, line): totals (A13) and the most important facts and beliefs (T04), each
    with its priority, status (P33) and days since it was verified."""
    days = F.greatest(F.lit(0), floor_days(F.lit(as_of_s), F.coalesce("last_verified_s", "created_s")))
    rows = memories.withColumn("days", days).withColumn("status", health_status(conflict, F.coalesce(F.col("days") > stale_days, F.lit(False))))
    totals = health(rows)
    parts = F.array(*(F.struct(F.lit(i).alias("pos"), F.concat(F.lit(f"| {k} | "), k, F.lit(" |")).alias("line")) for i, k in enumerate(totals.columns, 1)))
    mark = F.when(F.col("importance") >= 0.8, "🔴").when(F.col("importance") >= 0.5, "🟡").otherwise("⚪")
    state = F.when(F.col("status") == "conflict", "🔀").when(F.col("status") == "stale", "⚠️").otherwise("✅")
    text = F.replace(F.regexp_replace(F.substring("content", 1, 40), "\n", " "), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.substring(F.col("mid").cast("string"), 1, 12), F.lit(" | "), text, F.lit("... | "), mark, F.lit(" | "), state, F.lit(" | "), F.col("days"), F.lit(" |"))
    lists = top_by_type(rows, sizes or {"fact": 20, "belief": 10}).select(F.col("mtype").alias("section"), F.col("rank").alias("pos"), line.alias("line"))
    return totals.select(F.lit("totals").alias("section"), F.explode(parts).alias("x")).select("section", "x.pos", "x.line").unionByName(lists)


def token_budget(ranked: DataFrame, budget: int, shares=(0.40, 0.25, 0.15, 0.20)) -> DataFrame:
    """Tokens of each ranked row (rank, n of its query): fixed shares for the first three, the rest shared equally."""
    share = F.when(F.col("rank") <= 3, F.element_at(F.array(*map(F.lit, shares[:3])), F.least(F.col("rank"), F.lit(3)).cast("int"))).otherwise(shares[3] / (F.col("n") - 3))
    return ranked.withColumn("tokens", F.floor(F.lit(budget) * share).cast("long"))


def rollup(memories: DataFrame, unit: str = "week", least: float = 0.8, most: int = 20) -> DataFrame:
    """Rows by period and type: count, and the first ids of important ones in order, at most so many."""
    rows = memories.select("mid", "mtype", "importance", F.date_trunc(unit, F.timestamp_seconds("created_s")).cast("date").alias("period"))
    w = Window.partitionBy("period", "mtype").orderBy("mid")
    top = rows.where(F.col("importance") >= least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    ids = top.groupBy("period", "mtype").agg(F.array_join(F.transform(F.array_sort(F.collect_list("mid")), lambda i: i.cast("string")), ",").alias("important"))
    return rows.groupBy("period", "mtype").agg(F.count(F.lit(1)).alias("n")).join(ids, ["period", "mtype"], "left").withColumn("important", F.coalesce("important", F.lit("")))


def recent(memories: DataFrame, as_of_s: int, days: int, mtype: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the last days, newest first."""
    out = memories.where((F.col("created_s") > as_of_s - days * 86400) & (F.col("created_s") <= as_of_s))
    out = (out.where(F.col("mtype") == mtype) if mtype else out).orderBy(F.desc("created_s"), "mid")
    return out.limit(limit) if limit else out


def latest(log: DataFrame, n: int, column: str = "ts_us") -> DataFrame:
    """The n latest entries of a log."""
    return log.orderBy(F.desc(column), "log_id").limit(n)


