"""Language ID (4): sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL-proximal."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, slices

BITS = 16
ORDERS = (1, 2, 3)
SCALE = 30.0
#: Training documents sampled for each language (expected number): a bounded sample of labelled rows.
PER_LANGUAGE = 800

_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngrams(points: np.ndarray, order: int) -> np.ndarray:
    """Hash buckets of the n-grams of code points that start at each place (the last ones run into what follows)."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ points[i : i + n]) * _MUL[i]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, one after the other, and the bounds."""
    low = [x.lower() for x in texts]
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, low)])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, relative frequencies) of all orders' n-grams of the whole text."""
    points, _ = code_points([text])
    b = np.concatenate([ngrams(points, k) for k in ORDERS])
    if not len(b):
        return b, np.zeros(0)
    n = np.bincount(b, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at] / len(b)


def letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels, idf and scale included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Sums over each whole text; texts go together in chunks of bounded size, a long text in pieces."""
        out = np.zeros((len(texts), len(self.labels)))
        count = np.zeros(len(texts))
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                size += len(texts[last])
                last += 1
            points, bounds = code_points(texts[first:last])
            for k in ORDERS:
                for i in range(last - first):
                    if (total := bounds[i + 1] - bounds[i] - k + 1) <= 0:
                        continue
                    count[first + i] += total
                    for a in range(bounds[i], bounds[i + 1] - k + 1, CHUNK):
                        b = ngrams(points[a : min(a + CHUNK + k - 1, bounds[i + 1])], k)
                        out[first + i] += self.weights[b].sum(0, dtype=np.float64)
            first = last
        return out / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        own = [i for i, x in enumerate(texts) if self.labels and letters(x)]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if own:
            p = softmax(self.logits([texts[i] for i in own]) / self.temperature)
            for i, k, s in zip(own, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                names[i], scores[i] = self.labels[k], s
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, seed: int = 7):
    """Follow the regularised leader with elastic-net penalties, by coordinate rates. rows: (buckets, values, label)."""
    z, n = np.zeros((1 << BITS, n_labels)), np.zeros((1 << BITS, n_labels))
    bias, rng = np.zeros(n_labels), np.random.default_rng(seed)
    weight = lambda z, n: -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            w = weight(z[at], n[at])
            p = softmax((x @ w + bias)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
            bias -= 0.01 * p
    return weight(z, n), bias


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy on held-out rows, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _document_frequencies(batches):
    df = np.zeros(1 << BITS, np.int64)
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            if text:
                seen = np.zeros(1 << BITS, bool)
                points, _ = code_points([text])
                for k in ORDERS:
                    seen[ngrams(points, k)] = True
                df += seen
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["b", "df"])


def _sampled(batches):
    for batch in slices(batches):
        found = [features(x or "") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in found], pa.list_(pa.float32()))], names=["lang", "at", "tf"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 7) -> Model:
    """Fit on rows of docs with text and lang.

    Document frequencies cover all of these rows. The regression is fitted on a sample by hash of doc_id of about
    per_language rows a language (or all, if it has fewer), of which a fifth is kept for the temperature. It is the same in
    every run; rows that repeat a doc_id are taken together. The driver gets the sample's bucket counts, no texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    labels = sorted(counts)
    if not labels:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    df = docs.select("text").mapInArrow(_document_frequencies, "b long, df long").groupBy("b").agg(F.sum("df").alias("df")).toArrow()
    seen = np.zeros(1 << BITS)
    seen[df["b"].to_numpy()] = df["df"].to_numpy()
    idf = np.log((1 + sum(counts.values())) / (1 + seen)) + 1
    rate = F.create_map(*(F.lit(v) for k in labels for v in (k, min(1.0, per_language / counts[k]))))
    part = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = docs.where(part < rate[F.col("lang")]).mapInArrow(_sampled, "lang string, at array<int>, tf array<float>")
    rows = []
    for batch in sample.toArrow().to_batches():
        for lang, at, tf in zip(*(batch.column(i) for i in range(3)), strict=True):
            at, tf = at.values.to_numpy(), tf.values.to_numpy()
            rows.append((at.astype(np.int64), tf * idf[at] * SCALE, labels.index(lang.as_py())))
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    held = [r for i, r in enumerate(rows) if i % 5 == 0 and len(rows) > 20 * len(labels)]
    own = [r for i, r in enumerate(rows) if i % 5 or len(rows) <= 20 * len(labels)]
    w, bias = ftrl(own, len(labels), seed=seed)
    z = np.array([x @ w[at] + bias for at, x, _ in held]).reshape(len(held), len(labels))
    t = temperature(z, np.array([y for _, _, y in held], int))
    return Model(labels, (w * idf[:, None] * SCALE).astype(np.float32), bias, t)


def _predicted(shared):
    def run(batches):
        for batch in slices(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            rest = [batch.column(k) for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(k for k in batch.schema.names if k != "text"), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, tkey, lang_pred and score of keyed docs' whole texts; 'und' with score 0 if a text is null or has no letter.

    Without training rows every document is 'und'. A map over rows: repeated rows give equal rows, an empty table an empty one,
    and texts of any length count whole. Of labels that tie the first in order is taken; further columns aren't.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "tkey", "text").mapInArrow(_predicted(shared), "doc_id long, tkey long, lang_pred string, score double")


def learnable(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    return docs.where(F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) != held, F.lit(False)))


def _confident(shared, min_score: float):
    def run(batches):
        for batch in slices(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, min_score: float = 0.5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs without the documents that language ID rejects: 'und', or a calibrated score under min_score.

    A map over rows that keeps all columns, whatever their names. Null and empty texts are 'und' and go; repeated rows are
    judged alike; an empty table stays empty; texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(learnable(docs), per_language))
    return docs.mapInArrow(_confident(shared, min_score), docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(learnable(docs))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tkey"), "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return predict(base, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
