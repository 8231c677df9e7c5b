"""What the operators share: the shared folder, doc keys, recurring keys and chunks of text bytes."""

import hashlib
import math
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, one is made for a local session, which has no other machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


class _Scratch(threading.local):
    """What store() has written inside the open scratch() blocks of this thread: (path, table name or None)."""

    def __init__(self):
        self.open: list[list[tuple[str, str | None]]] = []


_scratch = _Scratch()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to a path and read back: a cut of the lineage that survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back.

    Inside scratch() the table goes at its end; elsewhere tables stay until the folder is cleared, as a result may be read at
    any time.
    """
    path = place(df.sparkSession, name)
    out = written(df, path)
    if _scratch.open:
        _scratch.open[-1].append((path, None))
    return out


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """store() as a table of the session's catalog that is bucketed and sorted by key, so that joins on the key don't shuffle it;
    and its rows as plain files, for unions: Spark 4.1 takes a union of bucketed tables for bucketed too, but reads one after
    the other, and would add up parts of a group by themselves."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    if _scratch.open:
        _scratch.open[-1].append((path, table))
    return spark.table(table), spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that store() writes inside it when it ends well: for results that are written inside it too. Each thread
    has its own."""
    _scratch.open.append([])
    done = False
    try:
        yield
        done = True
    finally:
        for path, table in _scratch.open.pop() if done else ():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, path)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text) and text. Together doc_id and tkey name a document; repeated rows are one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("tkey"), text.alias("text"))


def text_key(text):
    """32 bits that tell different texts of one doc_id apart."""
    return F.hash(text).cast("long")


def join_docs(docs: DataFrame, info: DataFrame, how: str = "left") -> DataFrame:
    """keyed docs with what info has for (doc_id, tkey); null doc_ids join too."""
    other = info.withColumnsRenamed({"doc_id": "_d", "tkey": "_t"})
    on = docs["doc_id"].eqNullSafe(other["_d"]) & (docs["tkey"] == other["_t"])
    return docs.join(other, on, how).drop("_d", "_t")


# --- recurring keys ------------------------------------------------------------------------------------------------

#: A bitmap of recurring keys is broadcast only up to this size; beyond it, rows go to the join unfiltered.
MAX_BITMAP_BITS = 1 << 28


def bitmap(keys: DataFrame, max_bits: int = MAX_BITMAP_BITS) -> np.ndarray | None:
    """A bitmap over the longs in column `a` with 16 bits or more a key, or None where that would pass max_bits.

    Its size is checked before anything is collected: at most max_bits / 64 words come to the driver.
    """
    n = keys.count()
    bits = max(16, math.ceil(math.log2(max(n, 1) * 16)))
    if 1 << bits > max_bits:
        return None
    slot = F.col("a").bitwiseAND(F.lit((1 << bits) - 1))  # low bits: anchors are minima, so their high bits crowd
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("v")
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    rows = words.toArrow()
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys may be in a bitmap."""
    slot = keys & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def local_bitmap(shared) -> np.ndarray | None:
    """The value of a broadcast bitmap (or of None)."""
    return None if shared is None else shared.value


def _filtered(shared, inside: bool, key: str):
    def run(batches):
        for batch in slices(batches):
            hit = in_bitmap(shared.value, batch.column(key).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(hit if inside else ~hit)).select([x for x in batch.schema.names if x != key])

    return run


def parted(docs: DataFrame, bits: np.ndarray, h) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash h may be in the bitmap, the other rows); no shuffle."""
    key = free_name(docs, "_h")
    shared, own = docs.sparkSession.sparkContext.broadcast(bits), docs.withColumn(key, h)
    return tuple(own.mapInArrow(_filtered(shared, inside, key), docs.schema) for inside in (True, False))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of df has."""
    while name.lower() in {x.lower() for x in df.columns}:
        name += "_"
    return name


def document(doc_id="doc_id", text="text"):
    """A struct that names a document of any table with doc_id and text: equal for equal rows, nulls included."""
    return F.struct(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.coalesce(text, F.lit(""))).alias("tkey"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, any columns, less the documents of gone (doc_id, tkey; a stored table).

    A bitmap of gone (its size is checked) clears most rows; only the others are shuffled for the anti-join.
    """
    name = free_name(docs, "_doc")
    h = F.xxhash64(document().getField("doc_id"), document().getField("tkey"))
    bits = bitmap(gone.select(F.xxhash64("doc_id", "tkey").alias("a")))
    names = gone.select(F.struct("doc_id", "tkey").alias(name))
    drop = lambda rows: rows.withColumn(name, document()).join(names, name, "left_anti").select(docs.columns)
    if bits is None:
        return drop(docs)
    some, rest = parted(docs, bits, h)
    return drop(some).unionByName(rest)


def map_met(docs: DataFrame, info: DataFrame, run, schema: str) -> DataFrame:
    """run over keyed docs with what info, a stored table, has for (doc_id, tkey); info has a row for few of the docs.

    A bitmap of info's documents (its size is checked) parts the docs: texts of the others aren't shuffled and go through one
    Python function with nulls for info's columns. Beyond its bound all texts go to the join.
    """
    docs = docs.select("doc_id", "tkey", "text")
    bits = bitmap(info.select(F.xxhash64("doc_id", "tkey").alias("a")))
    if bits is None:
        return join_docs(docs, info).mapInArrow(run, schema)
    names = [x for x in info.columns if x not in ("doc_id", "tkey")]
    shared, h = docs.sparkSession.sparkContext.broadcast(bits), F.xxhash64("doc_id", "tkey")
    keyed_rows = docs.withColumn("_h", h)

    def lone(batches):
        rows = (b for b in _filtered(shared, False, "_h")(batches) if b.num_rows)
        return run(pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows) for _ in names)], names=[*b.schema.names, *names]) for b in rows)

    some = keyed_rows.mapInArrow(_filtered(shared, True, "_h"), docs.schema)
    return join_docs(some, info).mapInArrow(run, schema).unionByName(keyed_rows.mapInArrow(lone, schema))


# --- bytes in tasks ------------------------------------------------------------------------------------------------


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b''."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches, rows: int = 512):
    """Arrow batches cut to a few rows each, so that what a task holds at a time stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def grouped(texts: list[bytes], limit: int = CHUNK):
    """(first, last) row ranges whose texts have about limit bytes together; a longer text is alone."""
    first = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield first, i
            first, size = i, 0
        size += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


_B = 0x9E3779B97F4A7C15
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        for k, b in (("p", _B), ("q", pow(_B, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


class Rolling:
    """Hashes of any spans of a symbol sequence: equal spans, equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        p, self.q = powers(n + 1)
        self.c = np.zeros(n + 1, np.uint64)
        np.cumsum(values * p[:n], out=self.c[1:])

    def spans(self, start, end) -> np.ndarray:
        return mix((self.c[end] - self.c[start]) * self.q[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.c) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.c[k:] - self.c[: n - k + 1]) * self.q[: n - k + 1])


_V1 = byte_values(11)


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    w = np.zeros(len(data) + 2, np.int8)
    w[1:-1] = is_word[data]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


#: Longer words (in bytes) have a cryptographic hash: sums of powers modulo 2**64 are equal for some unequal words of 1,024 letters.
LONG = 64
_LOWER_BYTES = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def hash_words(data: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a byte array, made a piece at a time so that memory stays bounded."""
    values = _V1.copy()
    if lower:
        values[65:91] = values[97:123]
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + 2 * CHUNK)
        if end < n:
            while end < n and is_word[data[end]]:  # a word is never cut
                end += 1
        piece = data[at:end]
        s, e = word_spans(piece, is_word)
        h = Rolling(values[piece]).spans(s, e)
        for k in np.flatnonzero(e - s > LONG).tolist():
            word = piece[s[k] : e[k]].tobytes()
            h[k] = int.from_bytes(hashlib.blake2b(word.translate(_LOWER_BYTES) if lower else word, digest_size=8).digest(), "little")
        out.append((h, s + at, e + at))
        at = end
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def byte_class(word: str) -> np.ndarray:
    """256 flags: 'space' for words [^\\x20\\x09-\\x0D]+, 'alnum' for [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in lower case."""
    flags = np.ones(256, bool)
    if word == "space":
        flags[[32, 9, 10, 11, 12, 13]] = False
    else:
        flags[:128] = False
        flags[48:58] = flags[97:123] = flags[65:91] = True
    return flags


def slide_min(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    m = len(h) - w + 1
    if m <= 0:
        return h[:0]
    a = np.concatenate([h, np.full((-len(h)) % w, (1 << 64) - 1, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(a, 1).ravel()
    after = np.minimum.accumulate(a[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())
