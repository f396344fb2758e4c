"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 lower-cased code points, weighted (1 + ln tf) * idf and
scaled to length 1. Document frequencies come from every learnable document. The weights are
fitted with follow-the-regularised-leader and elastic-net penalties on a bounded sample
(``PER_LANGUAGE`` documents of each language, those with the smallest hashes, as long as their vectors take
``SAMPLE_BYTES`` together at most, in equal shares), and a temperature is then fitted on a part of that sample that the
weights have not seen.

Defined results: a null text or one without a letter is ``und`` with score 0; without any
learnable row every document is ``und`` with score 0; ties go to the smaller language name;
repeated rows each give their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_fold, may_learn

BITS = 15
SIZE = 1 << BITS
#: Bound of the sample that the weights are fitted on, for each language.
PER_LANGUAGE = 1000
#: Bound of the sample's vectors in bytes; each language has an equal share, and its first document in any case.
SAMPLE_BYTES = 256 << 20
#: Languages whose counts, and the ids of whose sample, are broadcast at most.
LANGUAGES_SENT = 1000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: Code points that are hashed at once.
CHUNK = 1 << 20


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the whole text and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(SIZE, np.int64)
    for a in range(0, len(codes), CHUNK):
        c = codes[a : a + CHUNK + 2]
        one = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        new = len(c) if a + CHUNK + 2 >= len(codes) else CHUNK  # n-grams that begin in this chunk
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + c[2:]
        for h in (one, two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)):
            total += np.bincount(h[:new] >> np.uint32(32 - BITS), minlength=SIZE)
        if new == len(c):
            break
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = ngram_counts(text)
    x = (1 + np.log(n)) * idf[found]
    return found, x / np.sqrt(x @ x)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        found, x = weighted(text, self.idf)
        p = _softmax((x @ self.weights[found] + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; the bias is a coordinate of its own, without penalties."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    l1 = np.full((SIZE + 1, 1), L1)
    l1[SIZE] = 0

    def solve(zz, nn, ll):
        return np.where(np.abs(zz) <= ll, 0.0, -(zz - np.sign(zz) * ll) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(epochs):
        for found, x, y in rows:
            at, v = np.append(found, SIZE), np.append(x, 1.0)
            zz, nn = z[at], n[at]
            w = solve(zz, nn, l1[at])
            p = _softmax(v @ w)
            p[y] -= 1
            g = np.outer(v, p)
            more = nn + g * g
            z[at] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / ALPHA * w
            n[at] = more
    w = solve(z, n, l1)
    return w[:SIZE], w[SIZE]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(batches):
    total, docs = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                total[ngram_counts(text)[0]] += 1
                docs += 1
    if docs:
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, SIZE).astype(np.int32)), pa.array(np.append(total[found], docs))], names=["feature", "n"]
        )


def fit(docs: DataFrame) -> Model:
    """Learns from text and non-null lang of documents outside the held-out fold."""
    learnable = docs.select("doc_id", "text", "lang").where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n_docs = np.zeros(SIZE), 0
    counted = learnable.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for feature, n in counted.collect():  # SIZE + 1 rows at most
        if feature == SIZE:
            n_docs = n
        else:
            df[feature] = n
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    # hashes are even, so a bound on them leaves few more rows than wanted to be ranked, however frequent a language is
    counts = learnable.groupBy("lang").agg(F.count("*").alias("n"))
    sent = F.broadcast if counts.limit(LANGUAGES_SENT + 1).count() <= LANGUAGES_SENT else lambda df: df
    enough = PER_LANGUAGE + 10 * PER_LANGUAGE**0.5 + 100
    bound = F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(enough) / F.col("n")) * F.lit(2.0**64)
    few = learnable.select("doc_id", "lang").join(sent(counts), "lang").where(F.xxhash64("doc_id").cast("double") <= bound).drop("n")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= PER_LANGUAGE)
    sample = learnable.select("doc_id", "text").join(sent(chosen.select("doc_id", "lang", "k")), "doc_id")

    def featured(batches):
        for batch in batches:
            out = [(lang, k, *weighted(t, idf)) for lang, k, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "k", "text"))) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.int32()),
                    pa.array([x[2].astype(np.uint16).tobytes() for x in out], pa.binary()),
                    pa.array([x[3].astype(np.float32).tobytes() for x in out], pa.binary()),
                ],
                names=["lang", "k", "at", "x"],
            )

    with Scratch(docs.sparkSession) as scratch:
        vectors = scratch(sample.select("lang", "k", "text").mapInArrow(featured, "lang string, k int, at binary, x binary"), "language-sample")
        n_languages = vectors.select("lang").distinct().count()
        running = F.sum(F.octet_length("at") + F.octet_length("x")).over(Window.partitionBy("lang").orderBy("k"))
        own = Window.partitionBy("lang").orderBy("k")
        fits = vectors.withColumn("size", running).withColumn("i", F.row_number().over(own)).where((F.col("size") <= SAMPLE_BYTES // max(1, n_languages)) | (F.col("i") == 1))
        got = fits.select("lang", "k", "at", "x").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("k", "lang", "at", "x"))))
    languages = sorted({r[1] for r in rows})
    data = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(float), languages.index(lang)) for _, lang, a, x in rows]
    if not languages:
        return Model([], idf, np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    held = data[4::5]
    weights, bias = ftrl([r for k, r in enumerate(data) if k % 5 != 4], len(languages))
    logits = np.array([x @ weights[a] + bias for a, x, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(logits, np.array([y for *_, y in held], int)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""

    def rows(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    asked = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "text")
    return asked.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")
