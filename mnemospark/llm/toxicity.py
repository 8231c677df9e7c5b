"""Toxicity (8): a support vector machine over a gapped subsequence string kernel with Nystroem landmarks.

Words (letters only, lower case, between border marks; a run of single letters counts as one word) are compared with the
landmarks by the normalised subsequence kernel, whose decay tolerates gaps and inserted characters. The machine parts words
of toxic documents that letter sequences give away from the words of other documents. A document's score is a logistic
function of its two largest margins and of the share of its words on the toxic side, fitted on the training documents.
"""

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store

#: Labelled documents that are sampled for training, toxic and other (at most).
TOXIC_ROWS, OTHER_ROWS = 1200, 2800
LANDMARKS, ORDER, DECAY, WIDTH = 48, 3, 0.6, 26
#: Lengths of the letter sequences that point out landmarks.
GRAMS = range(4, 8)
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def encode(words: list[str]) -> np.ndarray:
    """Words of up to WIDTH letters as rows of codes 1 to 63 (0: none)."""
    out = np.zeros((len(words), WIDTH), np.uint8)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), n)
    code = np.where((points >= 97) & (points <= 122), points - 96, 27 + points * np.uint32(2654435761) % 35)
    code = np.where(points == 60, 62, np.where(points == 62, 63, code))  # < and >: a word's borders
    out[row, np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)] = code
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gapped subsequence kernel of each row of x with each row of y: common subsequences of ORDER letters, each weighted by
    DECAY to the power of the lengths that it spans in both."""
    n, m, width = len(x), len(y), int((y > 0).sum(1).max(initial=0))
    decay = np.float32(DECAY)
    match = [np.where((y[None, :, j] == np.arange(64)[:, None]) & (y[None, :, j] > 0), decay * decay, 0).astype(np.float32) for j in range(width)]
    k, run, step = (np.zeros((n, m), np.float32) for _ in range(3))
    prefix = [None, *(np.zeros((width + 1, n, m), np.float32) for _ in range(ORDER - 1))]
    for a in range(int((x > 0).sum(1).max(initial=0))):
        same = [t[x[:, a]] for t in match]
        for j in range(width):
            k += np.multiply(same[j], prefix[ORDER - 1][j], out=step)
        for i in range(ORDER - 1, 0, -1):
            run[:] = 0
            for j in range(width):
                run *= decay
                run += np.multiply(same[j], prefix[i - 1][j], out=step) if i > 1 else same[j]
                prefix[i][j + 1] *= decay
                prefix[i][j + 1] += run
    return k


def own_kernel(x: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself."""
    n, width = len(x), int((x > 0).sum(1).max(initial=0))
    k, decay = np.zeros(n, np.float32), np.float32(DECAY)
    prefix = [np.ones((width + 1, n), np.float32)] + [np.zeros((width + 1, n), np.float32) for _ in range(ORDER - 1)]
    for a in range(width):
        same = decay * decay * ((x[:, a] == x[:, :width].T) & (x[:, a] > 0))
        k += (same * prefix[ORDER - 1][:width]).sum(0)
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(width):
                run = decay * run + same[j] * prefix[i - 1][j]
                prefix[i][j + 1] = decay * prefix[i][j + 1] + run
    return k


def normal_kernel(x: np.ndarray, y: np.ndarray, block: int = 2000) -> np.ndarray:
    """The kernel over the root of both rows' own kernels; rows of x go in blocks of like length."""
    own = np.sqrt(own_kernel(y)) + 1e-9
    out = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort((x > 0).sum(1), kind="stable")
    for i in range(0, len(x), block):
        at = order[i : i + block]
        out[at] = kernel(x[at], y) / ((np.sqrt(own_kernel(x[at])) + 1e-9)[:, None] * own)
    return out


def letters_of(token: str) -> str:
    """The token's letters between border marks."""
    return f"<{token if token.isalpha() else ''.join(filter(str.isalpha, token))}>"


def tokens(text: str) -> Counter:
    """Tokens of a text with their counts, and the words that runs of single characters spell."""
    low = text.lower()
    out = Counter(low.split())
    if sum(len(x) == 1 for x in out) > 2:
        out.update("".join(m.group().split()) for m in _SPACED.finditer(low))
    return out


def pieces(word: str) -> list[str]:
    """A word, or overlapping parts of a longer one."""
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


@dataclass
class Model:
    """Landmarks, the machine over their kernels, and the weights of (1, largest margin, second, log share of toxic words)."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __post_init__(self):
        self.codes = encode(self.landmarks)

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's margin of each word, the largest one of a long word's parts; words too short for the kernel have the bias."""
        out = np.full(len(words), self.bias)
        at = [(i, p) for i, w in enumerate(words) if len(w) >= ORDER + 2 for p in pieces(w)] if self.landmarks else []
        for b in range(0, len(at), 50_000):
            own = at[b : b + 50_000]
            k = normal_kernel(encode([p for _, p in own]), self.codes)
            np.maximum.at(out, np.array([i for i, _ in own]), k @ self.weights + self.bias)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.document, -30, 30)))


def document_features(model: Model, texts: list[str], cache: dict[str, float], limit: int = 250_000) -> np.ndarray:
    """(1, largest margin, second, log share of toxic words) of each whole text. cache: margins of tokens met before, emptied
    at its limit."""
    out = np.tile([1.0, model.bias, model.bias, np.log(0.5 / 20)], (len(texts), 1))
    counts = [tokens(x) for x in texts]
    for first in range(0, len(texts), 64):
        own = counts[first : first + 64]
        new = list({t for c in own for t in c if t not in cache})
        if len(cache) + len(new) > limit:
            cache.clear()
            new = list({t for c in own for t in c})
        cache.update(zip(new, model.margins([letters_of(t) for t in new]).tolist(), strict=True))
        for i, c in enumerate(own, first):
            if not c:
                continue
            m = np.fromiter(map(cache.__getitem__, c), np.float64, len(c))
            n = np.fromiter(c.values(), np.int64, len(c))
            top = int(m.argmax())
            best = m[top]
            if n[top] == 1:
                m[top] = model.bias
            bad = int(n[m > 0].sum()) + int(n[top] == 1 and best > 0)
            out[i, 1:] = best, m.max(), np.log((bad + 0.5) / (int(n.sum()) + 20))
    return out


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge, weights c for the rows) by Newton steps over the rows inside the margin."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, before = np.zeros(z.shape[1]), None
    for _ in range(steps):
        inside = np.flatnonzero(y * (z @ w) < 1)
        if before is not None and np.array_equal(inside, before):
            break
        before, own = inside, z[inside] * c[inside, None]
        w = np.linalg.solve(np.eye(z.shape[1]) + 2 * own.T @ z[inside], 2 * own.T @ y[inside])
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic fit (Newton steps, ridge on all but the constant, the rarer class raised half-way)."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    c = np.where(y > 0, (pos * len(y)) ** -0.5, (neg * len(y)) ** -0.5)
    mean, size = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.concatenate([x[:, :1], (x[:, 1:] - mean) / size], 1)
    w, pull = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * (z.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + pull, z.T @ (c * (p - y)) + pull @ w)
        w = w - np.clip(step, -2, 2)
    out = w.copy()
    out[1:] /= size
    out[0] -= (out[1:] * mean).sum()
    return out


def _g2(k: np.ndarray, c: np.ndarray, n: int, m: int) -> np.ndarray:
    """G-squared of k of n against c of m, 0 unless the first share is 10 times the second (half a count more)."""
    p = (k + c) / (n + m)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    g = 2 * (part(k, n * p) + part(c, m * p) + part(n - k, n * (1 - p)) + part(m - c, m * (1 - p)))
    return np.where(k * (m + 1.0) < 10 * (c + 0.5) * n, 0.0, g)


def _grams(codes: np.ndarray, known: np.ndarray | None = None, block: int = 20_000):
    """(rows, packed letter sequences of the lengths in GRAMS), each once a row; only those in the sorted array known."""
    for first in range(0, len(codes), block):
        x = codes[first : first + block].astype(np.uint64)
        rows, keys = [], []
        for k in GRAMS:
            packed = np.zeros((len(x), WIDTH - k + 1), np.uint64)
            for i in range(k):
                packed = packed << np.uint64(6) | x[:, i : WIDTH - k + 1 + i]
            r, a = np.nonzero(x[:, k - 1 :])
            g = packed[r, a]
            if known is not None and len(known):
                keep = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
                r, g = r[keep], g[keep]
            rows.append(r)
            keys.append(g)
        r, g = np.concatenate(rows), np.concatenate(keys)
        by = np.lexsort((r, g))
        r, g = r[by], g[by]
        once = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])[: len(g)]
        yield r[once] + first, g[once]


def _unpacked(gram: int) -> bytes:
    out = []
    while gram:
        out.append(gram & 63)
        gram >>= 6
    return bytes(out[::-1])


def _grown(gram: bytes, words: list[str], codes: list[bytes], weight: np.ndarray, least: float = 0.8) -> str:
    """The gram's letters in the words that hold it, with the letters before and after that most of them agree on."""
    at = [c.find(gram) for c in codes]
    lo, hi, total = 0, len(gram), weight.sum()
    for step in (-1, 1):
        while hi - lo < WIDTH:
            k = lo - 1 if step < 0 else hi
            found: Counter = Counter()
            for a, w, n in zip(at, words, weight.tolist(), strict=True):
                if 0 <= a + k < len(w):
                    found[w[a + k]] += n
            if not found or found.most_common(1)[0][1] < least * total:
                break
            lo, hi = (lo - 1, hi) if step < 0 else (lo, hi + 1)
    first = max(range(len(words)), key=lambda i: (0 <= at[i] + lo and at[i] + hi <= len(words[i]), weight[i], words[i]))
    return words[first][max(0, at[first] + lo) : at[first] + hi]


def landmarks(words: list[str], clean: np.ndarray, n_clean: int, toxic: list[np.ndarray], most: int = LANDMARKS):
    """(landmarks, numbers of toxic documents in which they explain each word). toxic: each toxic document's words, by number.

    Landmarks are letter sequences that toxic documents have and others lack, the strongest first. One explains the toxic
    documents' words that hold it; the next is sought among the other words. A document counts half as much for each word
    that is explained, so that words which copies of a toxic document share by chance don't pass for insults.
    """
    codes = encode(words)
    doc = np.repeat(np.arange(len(toxic)), [len(x) for x in toxic])
    word = np.concatenate([np.zeros(0, np.int64), *toxic])
    bad = np.bincount(word, minlength=len(words)).astype(float)
    own = np.flatnonzero(bad > 0)
    found = list(_grams(codes[own]))
    row, key = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
    known, place = np.unique(key, return_inverse=True)
    row = own[row.astype(np.int64)]
    often = np.bincount(place, bad[row], len(known)) >= 3
    row, key, known = row[often[place]], key[often[place]], known[often]
    gram = np.searchsorted(known, key)
    c = np.zeros(len(known))
    for r, g in _grams(codes, known) if len(known) else ():
        np.add.at(c, np.searchsorted(known, g), clean[r])
    length = np.array([len(_unpacked(int(g))) for g in known.tolist()])
    chance = 2 * np.log(max(2, len(known))) - 2  # what chance gives the best of so many sequences is no evidence
    out: list[str] = []
    explained, weight = np.zeros(len(words), bool), np.ones(len(toxic))
    while len(out) < most and len(known):
        k = np.bincount(gram, np.bincount(word, weight[doc], len(words))[row], len(known))
        n = float(weight.sum())
        g2 = _g2(np.minimum(k, n), np.minimum(c, n_clean), n, n_clean)
        if g2.max() <= chance:
            break
        best = max(np.flatnonzero(g2 >= 0.95 * g2.max()).tolist(), key=lambda i: (length[i], g2[i], i))
        new = np.unique(row[gram == best])
        mark = _grown(_unpacked(int(known[best])), [words[i] for i in new.tolist()], [bytes(codes[i]) for i in new.tolist()], bad[new])
        if mark not in out:
            out.append(mark)
        explained[new] = True
        gone = np.isin(row, new)
        c -= np.bincount(gram[gone], clean[row[gone]], len(known))
        row, gram = row[~gone], gram[~gone]
        weight *= 0.5 ** np.bincount(doc[np.isin(word, new)], minlength=len(toxic))
    return out, np.where(explained, bad, 0.0)


def fit(counts: dict[str, int], n_clean: int, toxic: list[list[str]], most: int = LANDMARKS) -> Model:
    """Landmarks and machine from the words of toxic training documents and the numbers of others that each word is in.

    The machine parts words that landmarks explain, weighted by their toxic documents, from all words of other documents.
    """
    number: dict[str, int] = {}
    split = {w: [number.setdefault(p, len(number)) for p in pieces(w)] if len(w) >= ORDER + 2 else [] for w in sorted({*counts, *(w for x in toxic for w in x)})}
    clean = np.zeros(len(number))
    for w, c in counts.items():
        clean[split[w]] += c
    words = list(number)
    rows = [np.unique(np.array([k for w in x for k in split[w]], np.int64)) for x in toxic]
    marks, bad = landmarks(words, clean, n_clean, rows, most) if toxic and n_clean else ([], None)
    rate = np.log((len(toxic) + 0.5) / (n_clean + 0.5))
    if not marks:
        return Model([], np.zeros(0), 0.0, np.array([rate, 0.0, 0.0, 0.0]))
    values, vectors = np.linalg.eigh(normal_kernel(encode(marks), encode(marks)).astype(np.float64))
    root = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
    positive, negative = np.flatnonzero(bad), np.flatnonzero(clean)
    every = np.concatenate([positive, negative])
    x = normal_kernel(encode([words[i] for i in every.tolist()]), encode(marks)) @ root
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    c = np.concatenate([1000 * bad[positive] / bad.sum(), 3000 * np.sqrt(clean[negative]) / np.sqrt(clean[negative]).sum()])
    w, bias = svm(x, y, c)
    return Model(marks, root @ w, bias, np.array([rate, 0.0, 0.0, 0.0]))


def words_of(text: str | None) -> list[str]:
    """Distinct words of a text, in order."""
    return sorted(set(map(letters_of, tokens(text or ""))))


def _words(batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([words_of(x) for x in batch.column("text").to_pylist()], pa.list_(pa.string()))], names=["toxic", "words"])


def _featured(shared):
    def run(batches):
        model, cache = shared.value, {}
        for batch in slices(batches):
            f = document_features(model, [x or "" for x in batch.column("text").to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(f[:, i]) for i in range(4))], names=["toxic", "f0", "f1", "f2", "f3"])

    return run


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS, seed: int = 5) -> Model:
    """Fit on toxic_rows toxic and other_rows other labelled documents (or all), those whose doc_id hashes least.

    A doc_id is toxic if one of its labels is 1; labels other than 0 and 1 and null ids don't count. Of several texts of a
    doc_id the least is taken. Equal tables give equal models. Without toxic or without other rows the model has no
    landmarks, and every document gets the share of toxic rows as its score. The driver holds the sample's distinct words, of
    each toxic document and of all others together.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    here = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = (F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    sample = here.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(here.where("toxic = 0").orderBy(*order).limit(other_rows))
    sample = store(sample, "toxicity-sample")  # at most toxic_rows + other_rows pairs of numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = store(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-rows")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    words = store(rows.mapInArrow(_words, "toxic int, words array<string>"), "toxicity-words")
    found = words.where("toxic = 0").select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).toArrow()
    toxic = [x.as_py() for batch in words.where("toxic = 1").select("words").toArrow().to_batches() for x in batch.column(0)]
    model = fit(dict(zip(found["w"].to_pylist(), found["c"].to_pylist(), strict=True)), n.get(0, 0), sorted(toxic))
    if model.landmarks:
        got = rows.mapInArrow(_featured(spark.sparkContext.broadcast(model)), "toxic int, f0 double, f1 double, f2 double, f3 double").toPandas().to_numpy(float)
        model.document = logistic(got[:, 1:], got[:, 0])
    return model


def _scored(shared):
    def run(batches):
        model, cache = shared.value, {}
        for batch in slices(batches):
            s = model.scores(document_features(model, [x or "" for x in batch.column("text").to_pylist()], cache))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of docs' whole texts (doc_id, held_out, text), a row for each row.

    A map over rows: a null text is an empty one, repeated rows score alike, an empty table stays empty, and a document of
    any length is taken whole. Equal margins of different words don't matter, as only the margins' values are used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out)
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text"), train(docs, labels))
