"""Line dedup (7): levelled sorted runs of line hashes, compacted periodically; batches merge-anti-join the runs."""

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD_SPACE, bitmap, document, free_name, keyed, map_met, parted, slices, store, store_bucketed, texts_of


def line_key(line):
    """The key of a line: ASCII space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WORD_SPACE)), UPPER, LOWER)


def key_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs' columns and hs, the distinct 128-bit key hashes (32 hex digits) of each document's lines."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    kept = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    return docs.withColumn("hs", F.array_distinct(F.transform(kept, lambda k: F.md5(k))))


class Run(NamedTuple):
    """A run as a bucketed, sorted table, and the same rows as plain files."""

    table: DataFrame
    rows: DataFrame


class SortedRuns:
    """Runs of (h, n): line hash and number of documents, each a table that is bucketed and sorted by h.

    All runs have the same buckets, so a batch meets a run bucket by bucket, in order, and only the batch's own hashes are dealt,
    once; runs move when they are compacted. add() writes a new run at level 0; when a level has `fanout` runs they are merged
    into one run of the next level, so that a hash is rewritten at most log(batches) times and a batch meets a few sorted runs.
    What meet() finds for hashes that a run has already goes to levels of its own (`more`), compacted likewise.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int = 16):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[Run]] = [[]]
        self.more: list[list[Run]] = [[]]

    def add(self, counts: DataFrame) -> None:
        self._place(self._run(counts), 0, self.levels)

    def meet(self, counts: DataFrame) -> None:
        """Take in a batch's distinct hashes (h, n): those in no run enter as a run, the others add their counts."""
        if not any(self.levels):
            self.add(counts)
            return
        new = self._run(self.unseen(counts.select("h", "n")))
        self._place(self._run(counts.join(new.table.select("h").hint("merge"), "h", "left_anti")), 0, self.more)
        self._place(new, 0, self.levels)

    def _run(self, counts: DataFrame) -> Run:
        return Run(*store_bucketed(counts.select("h", "n"), "run", "h", self.buckets))

    def _place(self, run: Run, level: int, levels: list[list[Run]]) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) >= self.fanout:
            self.compact(level, levels)

    def compact(self, level: int, levels: list[list[Run]] | None = None) -> None:
        levels = self.levels if levels is None else levels
        merged = self.merged(levels[level])
        levels[level] = []
        self._place(self._run(merged), level + 1, levels)

    @staticmethod
    def merged(runs: list[Run]) -> DataFrame:
        rows = runs[0].rows
        for r in runs[1:]:
            rows = rows.unionByName(r.rows)
        return rows.groupBy("h").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """All hashes with their number of documents over all runs."""
        runs = [r for level in self.levels + self.more for r in level]
        return self.merged(runs) if runs else self.spark.createDataFrame([], "h string, n long")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """rows (with column h) whose hash is in no run: a merge anti-join with each run."""
        for level in self.levels:
            for run in level:
                rows = rows.join(run.table.select("h").hint("merge"), "h", "left_anti")
        return rows


def _kept(min_chars: int):
    strip = WORD_SPACE.encode()
    lower = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))

    def run(batches):
        for batch in slices(batches):
            lines, dropped, kept = [], [], []
            for text, hot in zip(texts_of(batch.column("text")), batch.column("hot").to_pylist(), strict=True):
                own = text.split(b"\n")
                lines.append(len(own))
                if hot:
                    hot = set(hot)
                    own = [x for x in own if hashlib.md5(x.strip(strip).translate(lower)).hexdigest() not in hot]
                dropped.append(lines[-1] - len(own))
                kept.append(b"\n".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array([x.decode() for x in kept], pa.string())],
                names=["doc_id", "tkey", "n_lines", "n_dropped", "text"],
            )

    return run


#: Hashes of all batches for each bucket of the runs, and documents in a batch.
BUCKET_ROWS, BATCH_DOCS = 1_000_000, 50_000_000


def hot_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """h of the line keys that at least min_docs doc_ids of docs have; rows without a doc_id don't count.

    Each batch (a hash of doc_id) has its lines counted by h with partial sums, so a line that every document has costs a
    row for each task. Only rows that repeat a doc_id are shuffled as (doc_id, h) first, to count once. The batches then meet
    the levelled runs one by one. Batches (4 at least) and buckets grow with the input.
    """
    spark = docs.sparkSession
    own = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    again = store(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"), "repeated-ids")
    lines_of = lambda rows: key_hashes(rows, min_chars).select("doc_id", F.explode("hs").alias("h"))
    bits = bitmap(again.select(F.xxhash64("doc_id").alias("a")))
    if bits is None:
        rows = lines_of(own).distinct()
    elif bits.any():
        some, rest = parted(own, bits, F.xxhash64("doc_id"))
        rows = lines_of(some).distinct().unionByName(lines_of(rest))
    else:
        rows = lines_of(own)
    batches = batches or max(4, -(-own.count() // BATCH_DOCS))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    counted = store(rows.select(batch, "h").groupBy("batch", "h").agg(F.count(F.lit(1)).alias("n")), "line-counts")
    runs = SortedRuns(spark, fanout, max(16, -(-counted.count() // BUCKET_ROWS)))
    for k in range(batches):
        runs.meet(counted.where(F.col("batch") == k))
    return store(runs.counts().where(F.col("n") >= min_docs).select("h"), "hot-lines")


#: Hot line hashes are broadcast up to this number (32 bytes each); beyond it they are joined by shuffle.
MAX_BROADCAST = 100_000


def drop_lines(docs: DataFrame, hot: DataFrame, min_chars: int = 1, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Rows of keyed docs as doc_id, tkey, n_lines, n_dropped and text without the lines whose hash is in hot.

    A row for each row, repeated ones too; null and empty texts are one empty line; null doc_ids lose hot lines too. Lines with
    equal keys go together, so there are no ties. An empty table gives an empty table, an empty hot keeps every line; texts of
    any length are taken whole. Other columns are not taken (see keyed).
    """
    if hot.count() <= max_broadcast:
        return docs.mapInArrow(_with_known(_known(hot), min_chars), "doc_id long, tkey long, n_lines long, n_dropped long, text string")
    found = key_hashes(docs, min_chars).select("doc_id", "tkey", F.explode("hs").alias("h")).join(hot, "h", "left_semi")
    per_doc = found.groupBy("doc_id", "tkey").agg(F.collect_set("h").alias("hot"))
    return map_met(docs, store(per_doc, "hot-by-doc"), _kept(min_chars), "doc_id long, tkey long, n_lines long, n_dropped long, text string")


def _known(hot: DataFrame):
    """A broadcast list of hot hashes, whose number has been checked."""
    return hot.sparkSession.sparkContext.broadcast(sorted(r["h"] for r in hot.toLocalIterator()))


def _cut(texts: list[bytes], same: frozenset) -> tuple[list[int], list[int], list[str]]:
    """(lines, dropped lines, what stays) of each text."""
    strip = WORD_SPACE.encode()
    lower = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    lines, dropped, kept = [], [], []
    for text in texts:
        own = text.split(b"\n")
        left = [x for x in own if hashlib.md5(x.strip(strip).translate(lower)).hexdigest() not in same] if same else own
        lines.append(len(own))
        dropped.append(len(own) - len(left))
        kept.append(b"\n".join(left).decode())
    return lines, dropped, kept


def _with_known(known, min_chars: int):
    def run(batches):
        same = frozenset(known.value)
        for batch in slices(batches):
            lines, dropped, kept = _cut(texts_of(batch.column("text")), same)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "tkey", "n_lines", "n_dropped", "text"],
            )

    return run


def _replaced(known):
    def run(batches):
        same = frozenset(known.value)
        for batch in slices(batches):
            text = pa.array(_cut(texts_of(batch.column("text")), same)[2], batch.column("text").type)
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), text)

    return run


def dedup_batch(batch: DataFrame, runs: SortedRuns, min_chars: int = 1) -> DataFrame:
    """Incremental form: lines of batch (doc_id, pos, line) that no earlier batch had, first of each key kept; adds the batch to runs.

    Lines whose key has fewer than min_chars code points always stay and are not recorded.
    """
    lines = batch.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).withColumn("k", line_key("line"))
    short = lines.where(F.char_length("k") < min_chars).select("doc_id", "pos", "line")
    long = lines.where(F.char_length("k") >= min_chars).withColumn("h", F.md5("k"))
    first = long.groupBy("h").agg(F.min(F.struct("doc_id", "pos", "line")).alias("f"), F.count_distinct("doc_id").alias("n"))
    new = store(runs.unseen(first), "new-lines")
    runs.add(new)
    return new.select("f.doc_id", "f.pos", "f.line").unionByName(short)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with every line dropped whose key is found in at least min_docs documents; other columns as they are.

    A null text becomes the empty text. Empty tables give empty tables. Rows that repeat a doc_id count once for a line and
    rows without one don't count, but all lose hot lines. A document all of whose lines are hot stays, with the empty text.
    """
    base = keyed(docs)
    hot = hot_lines(base, min_docs, min_chars)
    if hot.count() <= max_broadcast:
        return docs.mapInArrow(_replaced(_known(hot)), docs.schema)
    name, text = free_name(docs, "_doc"), free_name(docs, "_text")
    new = drop_lines(base, hot, min_chars, max_broadcast).where("n_dropped > 0").dropDuplicates(["doc_id", "tkey"])
    new = new.select(F.struct("doc_id", "tkey").alias(name), F.col("text").alias(text))
    joined = docs.withColumn(name, document()).join(new, name, "left")
    return joined.withColumn("text", F.coalesce(text, "text", F.lit(""))).select(docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = drop_lines(docs, hot_lines(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""
