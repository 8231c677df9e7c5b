"""Substring dedup (3): repeated-phrase automata, compiled in shards, through which all documents are streamed (see repeats)."""

import hashlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, map_met, slices, texts_of
from .repeats import Words, outside, repeated_spans, union

#: Segments (about 26 words each) in a shard on average, and of one anchor in a shard at most.
BLOCK, HOT = 2000, 20_000


#: Code points that letters take (surrogates are left out); a shard of more distinct words has two letters a word.
LETTERS = 1_000_000


def _letters(segs: list[bytes], most: int = LETTERS) -> tuple[list[str], int]:
    """Each segment's words as letters, equal ones for equal words of the shard, and the number of letters a word.

    The first and the second letter of a word come from halves of the alphabet, so words can't be met across their borders.
    """
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in x.split(b" ")] for x in segs]
    codes = np.fromiter((k for x in words for k in x), np.int64, sum(map(len, words)))
    width, half = (1, most) if len(number) <= most else (2, most // 2)
    if width == 2:
        codes = np.stack([codes // half, half + codes % half], 1).ravel()
    codes = (codes + 1).astype(np.uint32)
    codes += np.uint32(0x800) * (codes >= 0xD800)
    text, ends = codes.tobytes().decode("utf-32-le"), (width * np.cumsum([0, *map(len, words)])).tolist()
    return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)], width


def phrase_automaton(length: int, most: int = LETTERS):
    """find() for repeats: confirm the windows that recur in a shard, compile an Aho-Corasick automaton of them over words and
    stream every segment through it; an occurrence of a phrase that was met before is a repeat."""

    def find(segs: list[bytes]):
        texts, width = _letters(segs, most)
        size = length * width
        seen = Counter(x[i : i + size] for x in texts for i in range(0, len(x) - size + 1, width))
        machine = ahocorasick.Automaton()
        for k, x in enumerate(x for x, n in seen.items() if n > 1):
            machine.add_word(x, k)
        del seen
        flags = [np.zeros(max(0, len(x) // width - length + 1), bool) for x in texts]
        if len(machine):
            machine.make_automaton()
            met = bytearray(len(machine))
            for x, own in zip(texts, flags, strict=True):
                for end, k in machine.iter(x):
                    if met[k]:
                        own[(end + 1) // width - length] = True
                    met[k] = 1
        return flags, lambda k, a: b" ".join(segs[k].split(b" ")[a : a + length])

    return find


def repeated_words(docs: DataFrame, length: int = 20, block_rows: int = BLOCK, hot_rows: int = HOT) -> DataFrame:
    """doc_id, tkey, spans of words of keyed docs that lie in a window of `length` words which also starts earlier."""
    return repeated_spans(docs, Words(length), phrase_automaton(length), block_rows, hot_rows)


def _kept(batches):
    for batch in slices(batches):
        n, gone, text = [], [], []
        for x, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            words, runs = x.split(), union(spans)
            n.append(len(words))
            gone.append(sum(b - a for a, b in runs))
            text.append(b" ".join(w for part in outside(words, runs) for w in part).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "tkey", "n_words", "n_removed", "text"])


def dedup_words(docs: DataFrame, length: int = 20, block_rows: int = BLOCK) -> DataFrame:
    """keyed docs as doc_id, tkey, n_words, n_removed and text, the kept words joined by one space.

    Windows are judged on the input. Null and empty texts have no words and give the empty text. Documents are ordered by
    doc_id, null first; different texts of one doc_id by the hash of the text; repeated rows are one document. An empty table
    gives an empty table; long texts are cut into segments in bounded pieces. Other columns of a table are not taken (see keyed).
    """
    return map_met(docs, repeated_words(docs, length, block_rows), _kept, "doc_id long, tkey long, n_words long, n_removed long, text string")


def _digest(batches):
    for batch in _kept(batches):
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in texts_of(batch.column("text"))], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_removed"), sha], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op3(spark, sf_dir: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return map_met(docs, repeated_words(docs), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
t AS (SELECT d.doc_id, u.p, u.word FROM d, LATERAL (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p) u),
k AS (SELECT t.doc_id, count(*) AS n_removed_not, sha256(string_agg(word, ' ' ORDER BY t.p)) AS s FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.p = c.p GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n_removed_not, 0) AS n_removed, coalesce(s, sha256('')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
