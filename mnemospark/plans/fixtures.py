"""Memory records, entity links, queries and logs derived from the given tables, as DataFrames and as SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1706745600  # 2024-02-01T00:00:00Z

MEM = """SELECT conv_id*1000+turn AS mid, conv_id AS session_id, turn AS source_turn, text AS content,
  CASE role WHEN 'system' THEN 'third_party' ELSE role END AS ownership,
  CASE WHEN (conv_id*7+turn)%10 < 6 THEN 'fact' WHEN (conv_id*7+turn)%10 < 9 THEN 'belief' ELSE 'summary' END AS mtype,
  CAST((conv_id*1000+turn)*37%101 AS DOUBLE)/CAST(100 AS DOUBLE) AS importance,
  CAST((conv_id*1000+turn)*53%97 AS DOUBLE)/CAST(96 AS DOUBLE) AS score,
  CAST((conv_id*1000+turn)*29%11 AS DOUBLE)/CAST(10 AS DOUBLE) AS confidence,
  1704067200 + (conv_id*1000+turn)*7919%720*3600 AS created_s,
  CASE WHEN (conv_id+turn)%4=0 THEN NULL
       ELSE 1704067200 + (conv_id*1000+turn)*7919%720*3600 + (conv_id*1000+turn)*6151%240*3600 END AS last_accessed_s,
  CASE WHEN (conv_id+turn)%5=0 THEN 1704067200 + (conv_id*1000+turn)*3571%900*3600 ELSE NULL END AS expires_s,
  (conv_id*3+turn)%7 AS retrieval_count, (conv_id+turn*2)%5 AS used_in_response_count, (conv_id*2+turn)%3 AS user_mentioned_count
FROM conversations"""
#: mem with edits: three of four records of each fifth session repeat what the next session says at that turn, with one word more.
EDIT = "worthless"
MEMX = f"SELECT m.* REPLACE (CASE WHEN o.content IS NULL THEN m.content ELSE o.content || ' {EDIT}' END AS content) FROM mem m LEFT JOIN mem o ON m.session_id % 5 = 0 AND m.mid % 4 <> 0 AND o.session_id = m.session_id + 1 AND o.source_turn = m.source_turn"
NEW = "SELECT mid, mid AS ord, content, mtype, ownership, importance, score, confidence, created_s, expires_s, last_accessed_s FROM memx WHERE session_id % 5 = 0"
OLD = "SELECT mid, mid AS ord, content, mtype, ownership, importance, score, confidence, created_s, expires_s, last_accessed_s FROM memx WHERE session_id % 5 <> 0"
VIEWS = {
    "mem": MEM,
    "ent": "SELECT DISTINCT mid, e AS entity FROM (SELECT mid, unnest(regexp_extract_all(content, '[A-Z][a-z]+')) AS e FROM mem) t WHERE length(e) > 1",
    "memx": MEMX,
    "entx": "SELECT DISTINCT mid, e AS entity FROM (SELECT mid, unnest(regexp_extract_all(content, '[A-Z][a-z]+')) AS e FROM memx) t WHERE length(e) > 1",
    "mem_new": NEW,
    "mem_old": OLD,
    "qry": "SELECT item_id AS qid, text AS query FROM benchmark WHERE text IS NOT NULL",
    "access_log": "SELECT event_id AS log_id, (user_id % 100)*1000 + event_id % 4 AS mid, CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'used_in_response' ELSE 'user_mentioned' END AS access_type, epoch_us(ts) AS ts_us FROM events WHERE event_type IN ('view', 'click', 'purchase')",
    "attr_version": "SELECT event_id AS vid, user_id AS entity, event_type AS attribute, value, epoch_us(ts) AS ts_us FROM events",
}


def sql(body: str) -> str:
    """DuckDB SQL with the derived views in front; body begins with SELECT or with further 'name AS (...), ... SELECT'."""
    views = ", ".join(f"{k} AS ({v})" for k, v in VIEWS.items())
    return f"WITH RECURSIVE {views}, {body}" if not body.lstrip().upper().startswith("SELECT") else f"WITH RECURSIVE {views} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mem_columns(table(spark, sf_dir, "conversations"))


def mem_columns(conversations: DataFrame) -> DataFrame:
    """The columns of MEM over a batch or stream of conversations."""
    head, _, _ = MEM.partition("\nFROM conversations")
    columns, depth, at = [], 0, 7
    for i in range(7, len(head) + 1):
        c = head[i : i + 1]
        depth += (c == "(") - (c == ")")
        if c in (",", "") and not depth:
            columns.append(head[at:i])
            at = i + 1
    return conversations.selectExpr(*columns)


def memx(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mem(spark, sf_dir)
    edits = m.where("(session_id - 1) % 5 = 0").select((F.col("session_id") - 1).alias("session_id"), "source_turn", F.concat("content", F.lit(f" {EDIT}")).alias("edit"))
    edited = F.when(F.col("mid") % 4 != 0, F.col("edit"))
    return m.join(edits, ["session_id", "source_turn"], "left").withColumn("content", F.coalesce(edited, "content")).select(*m.columns)


def names(memories: DataFrame) -> DataFrame:
    from ..operators.entities import links

    return links(memories, F.regexp_extract_all("content", F.lit("[A-Z][a-z]+"), F.lit(0)))


def ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(mem(spark, sf_dir))


def entx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(memx(spark, sf_dir))


def mem_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memx(spark, sf_dir).where("session_id % 5 = 0").withColumn("ord", F.col("mid"))


def mem_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memx(spark, sf_dir).where("session_id % 5 <> 0").withColumn("ord", F.col("mid"))


def qry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("text IS NOT NULL").selectExpr("item_id AS qid", "text AS query")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'used_in_response' ELSE 'user_mentioned' END AS access_type"
    return table(spark, sf_dir, "events").where("event_type IN ('view', 'click', 'purchase')").selectExpr("event_id AS log_id", "(user_id % 100)*1000 + event_id % 4 AS mid", kind, "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us")


def attr_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS vid", "user_id AS entity", "event_type AS attribute", "value", "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us")
