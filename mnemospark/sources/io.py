"""Readers, collectors and writers."""

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY = T.StructType(
    [T.StructField(k, t()) for k, t in (("mid", T.LongType), ("mtype", T.StringType), ("content", T.StringType), ("importance", T.DoubleType), ("score", T.DoubleType), ("confidence", T.DoubleType), ("created_s", T.LongType), ("ownership", T.StringType), ("state", T.IntegerType))]
)
TRANSCRIPT = "type string, timestamp string, message struct<role: string, content: array<struct<type: string, text: string>>>"


def read_records(spark: SparkSession, path: str, schema=MEMORY) -> DataFrame:
    """Records from JSON lines; blank lines are skipped, lines that don't parse are in _corrupt_record if the schema has it."""
    return spark.read.schema(schema).json(path)


def write_version(df: DataFrame, root: str) -> str:
    """JSON lines in a new folder under root, returned; versions.replace swaps the current version of a table."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.json(path)
    return path


def log_expired(expired: DataFrame, path: str, as_of_s: int) -> None:
    """The expired branch of a run, appended to a log: id, content, when it was made, due and found."""
    append_records(expired.select(F.col("mid").alias("memory_id"), "content", F.col("created_s").alias("created_at"), F.col("expires_s").alias("expires_at"), F.lit(as_of_s).alias("expired_at")), path)


def append_records(df: DataFrame, path: str) -> None:
    """S03/S14/S15."""
    df.write.mode("append").json(path)


def message_text(content: Column) -> Column:
    """Text parts of a nested message joined by line ends, trimmed."""
    return F.trim(F.array_join(F.transform(F.filter(content, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n"))


def user_messages(transcripts: DataFrame, as_of_s: int, hours: int = 24, least: int = 10) -> DataFrame:
    """User messages of the last hours with at least so many characters, boiler plate dropped. transcripts: TRANSCRIPT + session."""
    ts = F.unix_seconds(F.try_to_timestamp("timestamp"))
    rows = transcripts.where((F.col("type") == "message") & (F.col("message.role") == "user") & (ts.isNull() | (ts >= as_of_s - hours * 3600)))
    out = rows.select("session", F.col("timestamp"), message_text(F.col("message.content")).alias("content")).where(F.length("content") >= least)
    return out.where(~F.contains("content", F.lit("Conversation info (untrusted metadata)")) & ~F.startswith("content", F.lit("Read HEARTBEAT.md")) & ~F.startswith("content", F.lit("System:")))


def collect_pending(messages: DataFrame, pending: DataFrame, digits: int = 6) -> DataFrame:
    """Messages as pending rows (id, content, timestamp, session); ids seen before, in pending or earlier in the batch, are skipped."""
    hash_ = F.substring(F.md5(F.concat_ws("_", "content", "timestamp")), 1, digits)
    rows = messages.withColumn("id", F.concat(F.lit("p_"), F.regexp_replace(F.substring("timestamp", 1, 10), "-", ""), F.lit("_"), hash_))
    first = rows.groupBy("id").agg(F.min(F.struct("timestamp", "session", "content")).alias("f")).select("id", "f.content", "f.timestamp", "f.session")
    return first.join(pending.select("id"), "id", "left_anti")


def line_segments(texts: DataFrame, longer_than: int = 5) -> DataFrame:
    """(source, pos, content): trimmed lines of more than so many characters. texts: (source, text)."""
    lines = texts.select("source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("source", "pos", F.trim("line").alias("content")).where(F.length("content") > longer_than)


def pending_segments(pending: DataFrame, batch: str, longer_than: int = 5) -> tuple[DataFrame, DataFrame]:
    """Segments of pending rows, and the rows marked as consumed by this batch."""
    seg = pending.where(F.length(F.trim("content")) > longer_than).select(F.trim("content").alias("content"), F.lit("pending").alias("source"), "session", F.col("timestamp").alias("created"))
    return seg, pending.withColumn("consumed_by", F.lit(batch))


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "mid", order: str = "seq") -> DataFrame:
    """The latest row of each id by `order`; incoming rows win over stored ones of the same order. Columns are united."""
    rows = stored.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_in"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_in")


#: Values of an inserted record's columns where they are missing or null.
DEFAULTS = {"importance": 0.5, "score": 0.5, "confidence": 1.0, "ownership": "user"}


class Upserted(NamedTuple):
    """The next version of the records and of their child tables (mid, value of the array column)."""

    records: DataFrame
    children: dict[str, DataFrame]


def upsert_records(stored: DataFrame, incoming: DataFrame, children: dict[str, DataFrame], arrays: dict[str, str], defaults: dict | None = None) -> Upserted:
    """Incoming records (mid, seq, columns, array columns) replace stored ones of their id.

    Missing values get their defaults and state is 0 whatever comes in. arrays names each array column's child table column; a
    replaced record's child rows are those of its new arrays, the others keep theirs.
    """
    fill = DEFAULTS if defaults is None else defaults
    new = incoming.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in incoming.columns else F.lit(v) for c, v in fill.items()}).withColumn("state", F.lit(0))
    last = upsert(new.limit(0), new)
    records = upsert(stored, last.drop(*arrays))
    kept = {}
    for column, name in arrays.items():
        old = children[column].join(last.select("mid"), "mid", "left_anti").select("mid", name)
        kept[column] = old.unionByName(child_rows(last, column, name))
    return Upserted(records, kept)


def child_rows(records: DataFrame, column: str, name: str) -> DataFrame:
    """Link rows of an array column, distinct."""
    return records.select("mid", F.explode(column).alias(name)).distinct()


def migrate_files(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """One typed table of a JSON-lines path for each type, and (mtype, ok, failed) counts."""
    schema = T.StructType([*MEMORY.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = None
    for mtype, path in paths.items():
        own = spark.read.schema(schema).json(path).withColumn("mtype", F.lit(mtype))
        rows = own if rows is None else rows.unionByName(own)
    bad = F.col("_corrupt_record").isNotNull() | F.col("content").isNull()
    counts = rows.groupBy("mtype").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"))
    return rows.where(~bad).drop("_corrupt_record"), counts


def dual_write(df: DataFrame, json_path: str, parquet_path: str) -> None:
    """The same rows to both stores; the frame is computed once."""
    df = df.persist()
    df.write.mode("append").json(json_path)
    df.write.mode("append").parquet(parquet_path)
    df.unpersist()


def write_text(lines: DataFrame, path: str) -> None:
    """One text column as files, rows of a group in order."""
    lines.select("line").write.mode("overwrite").text(path)


def write_document(text: DataFrame, path: str) -> None:
    """A document (one row, `text`) as one file of its lines in order; bounded, as a snapshot has few lines."""
    text.select("text").coalesce(1).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Postings, relations or profiles by a bounded number of key buckets, sorted by key within files."""
    b = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    df.select("*", b).repartition("bucket").sortWithinPartitions(key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int = 64) -> DataFrame:
    """Df as a table of the session's catalog, bucketed and sorted by key, in the shared folder; returned as read.

    Rows are dealt by the key before they are written, so each bucket is one file. A join or an aggregate on the key reads the
    buckets as they are, without a shuffle of this side.
    """
    spark = df.sparkSession
    table = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    table.option("path", shared_path(spark, name)).format("parquet").mode("overwrite").saveAsTable(name)
    return spark.table(name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, one is made for a local session, which has no other machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: what several results are made from is computed once, and the cut of the
    lineage survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table: complete results replace each other, appended ones add up."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    write = "overwrite" if mode == "complete" else "append"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode(write).parquet(path)

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(path.rpartition("/")[0])


def arriving(df: DataFrame, at: Column, files: int, last: DataFrame | None = None) -> str:
    """df as a folder of files that stand in order of arrival `at`; `last`, rows that end the stream's time, in one more file."""
    spark = df.sparkSession
    path = shared_path(spark, "arriving")
    rows = stored(df.withColumn("_at", at.cast("long")), "ordered")
    cuts = rows.agg(F.percentile_approx("_at", [i / files for i in range(1, files)], 10_000)).first()[0] if files > 1 else []
    for low, high in zip([None, *(cuts or [])], [*(cuts or []), None], strict=True):
        own = rows if low is None else rows.where(F.col("_at") > low)
        own = own if high is None else own.where(F.col("_at") <= high)
        own.drop("_at").coalesce(1).write.mode("append").parquet(path)
    if last is not None:
        last.select(df.columns).coalesce(1).write.mode("append").parquet(path)
    return path


def arriving_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of files as a stream, one file in each micro-batch, oldest first."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
