"""Best-fit packing (11): documents, cut into pieces of whole token ids, go into few sequences by vector best fit.

A sequence has room for tokens, pieces and attention cost (the sum of squared lengths). Each piece goes to the open sequence
that holds it in every dimension and is left with the least weighted residual norm, or has the largest weighted dot product of
residual and demand. Pieces are dealt evenly over bounded groups; sequences that a group leaves unfilled are dealt again.
"""

import json
import math
import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, slices, store, texts_of

LIMIT, END = 4096, 1
#: Pieces that one task packs at a time.
GROUP = 20_000
#: Bytes of text that are split into words at a time, and words that are encoded and remembered at a time.
TEXT, WORDS, MEMORY = 2 << 20, 20_000, 1_000_000


# The splitting pattern of the tokenizer that texts may be split for here, and the same for simple texts in lower case.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u024f"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
#: Texts whose normal form is their lower case: ASCII and precomposed Latin letters (without dotted capital I).
_SIMPLE = re.compile("[\t-\r -~\u00c0-\u012f\u0131-\u024f]*")


class Encoder:
    """Token ids (little-endian uint32 bytes) of texts by a tokenizer whose tokens never reach over ASCII white space.

    Words are encoded once: unknown ones together, parted by a special token that the tokenizer finds before anything else.
    Words that have a special token's text in them are encoded by themselves. Where the tokenizer composes characters, lower-cases
    and then splits by _PATTERN, simple texts are lower-cased and split here, each part is encoded once, and the model gets parts
    that need neither. What is remembered is bounded and shared by the tasks of a worker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.words, self.parts = Tokenizer.from_file(path), {}, {}
        special = self.model.get_added_tokens_decoder()
        self.marks = [x.content for x in special.values()]
        self.mark = next((i for i, x in special.items() if x.special and not (x.lstrip or x.rstrip or x.single_word or x.normalized)), None)
        self.plain = None
        form = json.loads(self.model.to_str())
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        end = form["model"].get("end_of_word_suffix")
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _PATTERN} and end:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.model.get_vocab_size(), bool)
            self.last[[i for w, i in self.model.get_vocab().items() if w.endswith(end)]] = True

    def _ids(self, model, text: str) -> np.ndarray:
        return np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_parts(self, parts: list[str]) -> None:
        for i in range(0, len(parts), WORDS):
            some = parts[i : i + WORDS]
            ids = self._ids(self.plain, " ".join(some))
            cut, data = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist(), ids.tobytes()
            self.parts.update((w, data[a:b]) for w, a, b in zip(some, [0, *cut[:-1]], cut, strict=True))

    def _learn_words(self, words: list[str]) -> None:
        alone = [w for w in words if self.mark is None or any(x in w for x in self.marks)]
        self.words.update((w, self._ids(self.model, w).tobytes()) for w in alone)
        words = [w for w in words if w not in self.words]
        for i in range(0, len(words), WORDS):
            some = words[i : i + WORDS]
            ids = self._ids(self.model, self.model.id_to_token(self.mark).join(some))
            cut, data = np.flatnonzero(ids == self.mark) * 4, ids.tobytes()
            self.words.update((w, data[a:b]) for w, a, b in zip(some, [0, *(cut + 4).tolist()], [*cut.tolist(), len(data)], strict=True))

    @staticmethod
    def _known(memory: dict, learn, items: list[list[str]]) -> list[bytes]:
        new = set().union(*items) - memory.keys()
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = set().union(*items)
        learn(list(new))
        return [b"".join(map(memory.__getitem__, x)) for x in items]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        text = [x.decode() for x in texts]
        simple = [self.plain is not None and _SIMPLE.fullmatch(x) is not None and not any(m in x for m in self.marks) for x in text]
        by_part = iter(self._known(self.parts, self._learn_parts, [_PARTS.findall(x.lower()) for x, s in zip(text, simple, strict=True) if s]))
        by_word = iter(self._known(self.words, self._learn_words, [[w.decode() for w in x.split()] for x, s in zip(texts, simple, strict=True) if not s]))
        return [next(by_part if s else by_word) for s in simple]


@cache
def encoder(path: str) -> Encoder:
    """A tokenizer, loaded once in each worker; a bounded file that each machine has at the same path."""
    return Encoder(path)


def parts(text: bytes, size: int = TEXT):
    """A text in parts of about size bytes that are cut at white space only."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _cut(path, limit, end, with_ids):
    tail = np.array([end], "<u4").tobytes()
    step = 4 * limit

    def run(batches):
        coder = encoder(path)
        for batch in slices(batches, 2048):
            texts, doc_ids = texts_of(batch.column("text")), batch.column("doc_id").to_pylist()
            for i, j in grouped(texts, TEXT):
                coded = coder.encode(texts[i:j]) if j > i + 1 else [b"".join(y for x in parts(texts[i]) for y in coder.encode([x]))]
                rows = [(d, k, (x + tail)[k * step : (k + 1) * step]) for d, x in zip(doc_ids[i:j], coded, strict=True) for k in range(len(x) // step + 1)]
                columns = {
                    "doc_id": pa.array([d for d, _, _ in rows], pa.int64()), "piece": pa.array([k for _, k, _ in rows], pa.int32()),
                    "start": pa.array([k * limit for _, k, _ in rows], pa.int64()), "length": pa.array([len(x) // 4 for _, _, x in rows], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for _, _, x in rows], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4") for _, _, x in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """A stored table of uid, doc_id, piece, start, length, ids_crc32 (and ids): token ids of each whole text and the id end.

    Documents of more than limit ids are cut into pieces of limit; null and empty texts have the id end alone. Repeated rows
    are documents of their own; an empty table gives no pieces. uid numbers the stored rows.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(rows.mapInArrow(_cut(path, limit, end, with_ids), kind).withColumn("uid", F.monotonically_increasing_id()), "pieces")


def best_fit(demand: np.ndarray, capacity: np.ndarray, weight: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item (a row of demand), largest items first; rule: 'norm' (least residual) or 'dot' (largest product)."""
    n, width = demand.shape
    if (demand > capacity).any():
        raise ValueError("an item is larger than a bin")
    order = np.lexsort((np.arange(n), *(-demand.T[::-1]), -(demand / capacity) @ weight))
    sorted_ = demand[order]
    least = np.minimum.accumulate(sorted_[::-1])[::-1] if n else sorted_  # what the items still to come need at least
    scale = (np.sqrt(weight) / capacity)[:, None]
    room, name, bins, m = np.empty((width, n), np.int64), np.empty(n, np.int64), np.empty(n, np.int64), 0
    made = 0
    for t in range(n):
        x = sorted_[t][:, None]
        left = room[:, :m] - x
        fits = (left >= 0).all(0)
        k = -1
        if fits.any():
            value = ((left * scale) ** 2).sum(0) if rule == "norm" else -((room[:, :m] * scale) * (x * scale)).sum(0)
            k = int(np.where(fits, value, np.inf).argmin())
        else:
            k, m = m, m + 1
            room[:, k], name[k] = capacity, made
            made += 1
        room[:, k] -= sorted_[t]
        bins[order[t]] = name[k]
        if t + 1 < n and (room[:, k] < least[t + 1]).any():  # nothing fits any more: the last open bin takes its place
            m -= 1
            room[:, k], name[k] = room[:, m], name[m]
        if t + 1 < n and (least[t + 1] > least[t]).any():
            stay = np.flatnonzero((room[:, :m] >= least[t + 1][:, None]).all(0))
            m = len(stay)
            room[:, :m], name[:m] = room[:, stay], name[stay]
    return bins


def _packed(round_, limit, capacity, weight, rule, last):
    capacity, weight = np.array(capacity, np.int64), np.array(weight, float)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        length = table.column("length").to_numpy()
        bins = best_fit(np.stack([length, np.ones_like(length), length * length], 1), capacity, weight, rule)
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(length[order])
        filled = np.bincount(bins, length).astype(np.int64)
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - length[order] - (np.cumsum(filled) - filled)[bins[order]]
        group = table.column("part")[0].as_py()
        full = np.ones(len(bins), bool) if last else (limit - filled <= limit // 256)[bins]
        added = {"sequence_id": pa.array((round_ << 54) + (group << 24) + bins, pa.int64()), "offset": pa.array(offset, pa.int64()), "final": pa.array(full)}
        table = table.drop_columns(["part"])
        return pa.table([*table.columns, *added.values()], names=[*table.column_names, *added])

    return run


def pack(items: DataFrame, limit: int = LIMIT, most: int | None = None, attention: int | None = None, weight=(1.0, 1.0, 1.0), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """items (a stored table with uid and length, each length 1 to limit) with sequence_id and offset, gapless from 0.

    A sequence holds at most limit tokens, most pieces and attention cost (defaults that tokens alone imply: limit and limit
    squared); a piece over the attention cost alone is an error. Pieces are dealt by a hash of uid over groups of about `group`,
    so equal documents or sizes never crowd a task. Sequences left unfilled by more than limit / 256 tokens are dealt again, until
    one group holds the rest or a round fills few: what a group wastes is then packed with what others waste.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule: norm or dot")
    capacity = (limit, limit if most is None else most, limit * limit if attention is None else attention)
    columns, done, round_, n = items.columns, None, 0, items.count()
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long, final boolean"
    before = math.inf
    while True:
        groups = max(1, -(-n // group))
        last = groups == 1 or n > 0.9 * before
        dealt = items.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups)))
        packed = store(dealt.groupBy("part").applyInArrow(_packed(round_, limit, capacity, weight, rule, last), kind), "packed")
        final = packed.where("final").select(*columns, "sequence_id", "offset")
        done = final if done is None else done.unionByName(final)
        if last:
            return done
        items, before = packed.where("NOT final").select(columns), n
        n, round_ = items.count(), round_ + 1
        if not n:
            return done


def sequences(docs: DataFrame, path: str, **options) -> DataFrame:
    """sequence_id, doc_ids, ids: the packed sequences themselves, each at most limit ids long."""
    limit = options.get("limit", LIMIT)
    cut = pieces(docs, path, limit=limit, end=options.pop("end", END), with_ids=True)
    placed = pack(cut.select("uid", "length"), **options).join(cut.select("uid", "doc_id", "ids"), "uid")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(ordered.alias("x"))
    return rows.select("sequence_id", F.col("x.doc_id").alias("doc_ids"), F.flatten("x.ids").alias("ids"))


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
