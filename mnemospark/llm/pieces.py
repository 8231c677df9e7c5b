"""SentencePiece encoding and decoding (6) with batched numpy passes over words.

Equal-length words advance together; hashes of their substrings probe the sorted piece keys. Unigram models are encoded by
Viterbi: vectorised maxima over the pieces that end at each place store backpointers. Models whose scores are merge ranks
(BPE) don't define a best path: for these, each pass joins every word's best adjacent pair, the leftmost of equals, until
none is a piece, which gives SentencePiece's own ids.
"""

import hashlib
import heapq
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, mix, powers, slices

SPACE = "▁"
#: Characters of the texts whose new words are encoded together.
TEXT = 1 << 20
SLOTS = 1 << 20
#: Words of more characters (as in scripts without spaces) are merged one by one.
WIDE = 200
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@dataclass
class Pieces:
    """A model's pieces and scores. bytes_at: id of <0x00>, where byte fallback starts; -1 without it."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    bytes_at: int
    unknown: int = 0
    algorithm: str = "auto"
    cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        own = [i for i, x in enumerate(self.plain) if x]
        if self.algorithm == "auto":
            ranks = [s for i in own if (s := self.scores[i]) > -1e8]
            self.algorithm = "bpe" if all(s == int(s) for s in ranks) else "viterbi"
        points = [np.array([ord(c) for c in self.pieces[i]], np.uint64) for i in own]
        keys = np.array([int(_hash(x[None])[0]) for x in points], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(own, np.int32)[order]
        self.values = np.array([self.scores[i] for i in own])[order]
        place = (self.keys & np.uint64(SLOTS - 1)).astype(np.int64)
        self.slot = np.full(SLOTS, -1, np.int32)
        self.slot[place] = np.arange(len(place))
        self.shared = np.bincount(place, minlength=SLOTS) > 1
        self.longest = max((len(x) for x in points), default=1)
        self.rank = {self.pieces[i]: self.scores[i] for i in own}
        self.text = [x.replace(SPACE, " ").encode() if p else b"" for x, p in zip(self.pieces, self.plain, strict=True)]
        for b in range(256 if self.bytes_at >= 0 else 0):
            self.text[self.bytes_at + b] = bytes([b])
        self.floor = min((self.scores[i] for i in own), default=0.0) - 10.0

    @staticmethod
    def load(path: str, algorithm: str = "auto") -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in n]
        first = next((i for i in n if sp.is_byte(i)), -1)
        return Pieces([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], plain, first, sp.unk_id(), algorithm)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes in the sorted keys, -1 for those that are no piece's: by a slot of low bits, searched where keys share one."""
        place = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        at = self.slot[place]
        at = np.where(self.keys[at] == h, at, -1)
        rest = np.flatnonzero((at < 0) & self.shared[place])
        if len(rest):
            found = np.minimum(np.searchsorted(self.keys, h[rest]), len(self.keys) - 1)
            at[rest] = np.where(self.keys[found] == h[rest], found, -1)
        return at

    def _spans(self, sums, s, e):
        r = np.arange(len(sums))
        return mix((sums[r, e] - sums[r, s]) * powers(sums.shape[1])[1][s])

    def merge_words(self, points: np.ndarray) -> np.ndarray:
        """End of the piece that starts at each place (0: none does), by merges of the best adjacent pair."""
        n, width = points.shape
        sums = _sums(points)
        none = -np.inf
        ends = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        pair = np.full((n, width), none)
        for s in range(width - 1):
            at = self.probe(self._spans(sums, np.full(n, s), np.full(n, s + 2)))
            pair[:, s] = np.where(at >= 0, self.values[at], none)
        live = np.arange(n)
        while len(live):
            best = pair[live].argmax(1)
            keep = pair[live, best] > none
            live, best = live[keep], best[keep]
            if not len(live):
                break
            middle = ends[live, best]
            end = ends[live, middle]
            ends[live, best] = end
            ends[live, middle] = 0
            pair[live, middle] = none
            inside = end < width
            before[live[inside], end[inside]] = best[inside]
            self._score(sums, ends, pair, live, best)
            left = before[live, best]
            has = left >= 0
            self._score(sums, ends, pair, live[has], left[has])
        return ends

    def merge_wide(self, word: str) -> np.ndarray:
        """merge_words for one word of very many characters: its pairs wait in a heap, best first, leftmost of equals."""
        n, rank = len(word), self.rank
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-v, s, s + 2) for s in range(n - 1) if (v := rank.get(word[s : s + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, s, e = heapq.heappop(heap)
            middle = ends[s]
            if not middle or middle >= n or ends[middle] != e:  # one side has been joined to something else
                continue
            ends[s], ends[middle] = e, 0
            pairs = [(before[s], e)]
            if e < n:
                before[e] = s
                pairs.append((s, ends[e]))
            for a, b in pairs:
                if a >= 0 and b - a <= self.longest and (v := rank.get(word[a:b])) is not None:
                    heapq.heappush(heap, (-v, a, b))
        return np.array(ends)

    def _score(self, sums, ends, pair, rows, start):
        width = ends.shape[1]
        middle = ends[rows, start]
        ok = middle < width
        pair[rows[~ok], start[~ok]] = -np.inf
        rows, start, middle = rows[ok], start[ok], middle[ok]
        if len(rows):
            at = self.probe(self._spans(sums[rows], start, ends[rows, middle]))
            pair[rows, start] = np.where(at >= 0, self.values[at], -np.inf)

    def best_paths(self, points: np.ndarray) -> np.ndarray:
        """End of the piece that starts at each place (0: none does) on the path of the largest sum of scores (Viterbi)."""
        n, width = points.shape
        sums = _sums(points)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int64)
        for e in range(1, width + 1):
            for s in range(max(0, e - self.longest), e):
                at = self.probe(self._spans(sums, np.full(n, s), np.full(n, e)))
                value = np.where(at >= 0, self.values[at], self.floor if e - s == 1 else -np.inf) + best[:, s]
                better = value > best[:, e]
                best[better, e] = value[better]
                back[better, e] = s
        ends = np.zeros((n, width), np.int64)
        e = np.full(n, width)
        live = np.arange(n)
        while len(live):
            s = back[live, e[live]]
            ends[live, s] = e[live]
            e[live] = s
            live = live[s > 0]
        return ends

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each word."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for width, all_rows in by.items():
            step = max(1, 200_000 // max(1, width))
            for k in range(0, len(all_rows) if width else 0, step):
                rows = all_rows[k : k + step]
                points = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(-1, width).astype(np.uint64)
                if self.algorithm != "bpe":
                    ends = self.best_paths(points)
                else:
                    ends = self.merge_words(points) if width <= WIDE else np.array([self.merge_wide(words[i]) for i in rows])
                r, s = np.nonzero(ends)
                sums = _sums(points)
                at = self.probe(mix((sums[r, ends[r, s]] - sums[r, s]) * powers(width + 1)[1][s]))
                ids = np.where(at >= 0, self.ids[at], -1).astype(np.int32)
                bounds = np.searchsorted(r, np.arange(len(rows) + 1))
                lost = set(r[ids < 0].tolist())
                for j, i in enumerate(rows):
                    own = ids[bounds[j] : bounds[j + 1]]
                    out[i] = own.tobytes() if j not in lost else self._fallback(words[i], own, s[bounds[j] : bounds[j + 1]])
        return out

    def _fallback(self, word: str, ids: np.ndarray, starts: np.ndarray) -> bytes:
        parts = []
        for k, s in zip(ids.tolist(), starts.tolist(), strict=True):
            parts += [k] if k >= 0 else [self.bytes_at + b for b in word[s].encode()] if self.bytes_at >= 0 else [self.unknown]
        return np.array(parts, np.int32).tobytes()

    def encode(self, texts: list[str], limit: int = 200_000) -> list[np.ndarray]:
        """ids of each whole text. Words met before come from a bounded cache."""
        split = [_WORDS.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        new = {w for words in split for w in words if w not in self.cache}
        if len(self.cache) + len(new) > limit:
            self.cache.clear()
            new = {w for words in split for w in words}
        new = list(new)
        self.cache.update(zip(new, self.encode_words(new), strict=True))
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]
        if len(self.cache) > limit:
            self.cache.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, the first word's border dropped; ids of control pieces are nothing."""
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _sums(points: np.ndarray) -> np.ndarray:
    n, width = points.shape
    out = np.zeros((n, width + 1), np.uint64)
    np.cumsum(mix(points + np.uint64(1)) * powers(width + 1)[0][:width], 1, out=out[:, 1:])
    return out


def _hash(points: np.ndarray) -> np.ndarray:
    return mix(_sums(points)[:, -1])


@cache
def loaded(path: str, algorithm: str) -> Pieces:
    """A model, loaded once in each worker; a bounded file that each machine has at the same path."""
    return Pieces.load(path, algorithm)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encoded(path, algorithm, arrays):
    def run(batches):
        model = loaded(path, algorithm)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = [x for i, j in grouped(texts, TEXT) for x in model.encode(texts[i:j])]
            back = [model.decode(x) for x in ids]
            same = pa.array([x == y.replace(SPACE, " ") for x, y in zip(back, texts, strict=True)], pa.bool_())
            count = pa.array(list(map(len, ids)), pa.int64())
            if arrays:
                cols, names = [pa.array(ids, pa.list_(pa.int32())), count, same], ["ids", "n_tokens", "round_trip"]
            else:
                digest = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
                cols = [pa.array([len(x.encode()) for x in texts], pa.int64()), count, digest(x.tobytes() for x in ids), digest(x.encode() for x in back), same]
                names = ["n_bytes", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *names])

    return run


def encode_checked(docs: DataFrame, path: str | None = None, algorithm: str = "auto") -> DataFrame:
    """doc_id, ids (array of int), n_tokens and round_trip of each whole text; null and empty texts have no ids.

    A map over rows: repeated rows give equal rows, an empty table an empty one, and texts and words of any length are encoded
    whole. round_trip: the ids decode to the text (U+2581, which stands for a space in pieces, to a space).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encoded(path or model_path(), algorithm, True), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of a table with doc_id and ids; null ids give a null text."""
    file = path or model_path()

    def run(batches):
        model = loaded(file, "auto")
        for batch in slices(batches, 64):
            texts = [None if x is None else model.decode(np.array(x, np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str | None = None, algorithm: str = "auto") -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_sha256 (little-endian int32), decoded_sha256, round_trip of each whole text.

    U+2581 stands for a space in pieces, so it decodes to a space; round_trip allows that and nothing else. A map over rows, as
    encode_checked: null and empty texts have no ids, repeated rows give equal rows, an empty table an empty one, texts and words
    of any length are encoded whole, and further columns aren't taken.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encoded(path or model_path(), algorithm, False), "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op6(spark, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
