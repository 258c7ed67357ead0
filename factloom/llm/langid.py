"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character n-grams of the lower-cased text (one to three code points) in 2**15 hash slots, weighted ``(1 + ln tf) * idf`` and
scaled to unit length. Document frequencies are counted over all training documents, one vector for each task. The weights come from
the follow-the-regularised-leader (proximal) rule with elastic-net penalties, over a bounded sample of labelled documents (the lowest
seeded hashes of id and text: ``per_label`` for each label, ``most_rows`` in all but five for each label at least; no label is left out). A last part of the sample, which the
rule never sees, sets the temperature that calibrates the scores.

Only text and label of training documents are learned from; nothing but the text enters a prediction.

Defined results: a text that is null or has no letter is ``und`` with score 0.0; without any labelled training text every text is ``und``; repeated
rows are predicted alike, and rows with a null id are like any others; whole texts count, however long; ties go to the alphabetically first label; an empty table
gives an empty result; other columns are kept whatever their names, but ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import words
from factloom.llm.storage import fresh

SLOTS = 1 << 15
ORDERS = (1, 2, 3)
PER_LABEL = 400
MOST_ROWS = 4000
NONE = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def slots(text: str, lowered: bool = False) -> np.ndarray:
    """The hash slot of every n-gram occurrence."""
    code = np.frombuffer((text if lowered else text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(code), np.uint32)
        for n in ORDERS:
            if len(code) < n:
                break
            h = (h[: len(code) - n + 1] ^ (code[n - 1 :] * _MIX[n - 1])) * np.uint32(0x2C1B3C6D)
            out.append(((h ^ (h >> np.uint32(15))) >> np.uint32(17)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of the unit vector of a text.

    One text at a time on purpose: its counts stay in the processor's cache. Tables of 8 to 64 texts at once took five times as long.
    """
    tf = np.bincount(slots(text), minlength=SLOTS)
    at = np.flatnonzero(tf)
    w = (1.0 + np.log(tf[at])) * idf[at]
    return at, w / max(float(np.sqrt((w * w).sum())), 1e-12)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots by labels
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, w = features(text, self.idf)
        return (w @ self.weights[at] + self.bias) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        """(label, probability)."""
        if not self.labels or not text or not any(map(str.isalpha, text)):
            return NONE, 0.0
        z = self.logits(text)
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.labels[best], float(p[best] / p.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: weights and bias. The bias is a slot of its own without penalties."""
    z, n = np.zeros((SLOTS + 1, n_labels)), np.zeros((SLOTS + 1, n_labels))
    order = np.random.default_rng(seed)

    def weights(at):
        zi, ni = z[at], n[at]
        one = np.where(at < SLOTS, l1, 0.0)[:, None]
        two = np.where(at < SLOTS, l2, 0.0)[:, None]
        return np.where(np.abs(zi) <= one, 0.0, -(zi - np.sign(zi) * one) / ((beta + np.sqrt(ni)) / alpha + two))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, SLOTS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            g2 = n[at] + g * g
            z[at] += g - (np.sqrt(g2) - np.sqrt(n[at])) / alpha * w
            n[at] = g2
    every = weights(np.arange(SLOTS + 1))
    return every[:SLOTS], every[SLOTS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least log loss, by golden-section search over its logarithm.

    A share of 1 / (n + 2) of every row's weight is spread over the other labels, so that n rows without an error do not make
    the scores more certain than n rows can show.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    slack, row = 1.0 / (len(y) + 2), np.arange(len(y))
    others = (logits.shape[1] - 1) / slack

    def loss(t: float) -> float:
        p = np.log(softmax(logits / np.exp(t)) + 1e-300)
        own = p[row, y]
        return float(-((1 - slack) * own + (p.sum(1) - own) / others).mean())

    a, b, r = -5.0, 5.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many of them each slot occurs; one vector leaves each task."""

    def count(batches):
        df, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    df[np.bincount(slots(text), minlength=SLOTS) > 0] += 1
                n += 1
        words.trim()
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.astype("<i8").tobytes()]})

    def add(batches):
        # Partial sums: a few tasks' worth of vectors go to the driver, however many tasks counted.
        df, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n += i
                df += np.frombuffer(v, "<i8")
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.astype("<i8").tobytes()]})

    parts = texts.mapInArrow(count, "n long, df binary").repartition(8).mapInArrow(add, "n long, df binary").collect()
    return sum(r["n"] for r in parts), sum((np.frombuffer(r["df"], "<i8") for r in parts), np.zeros(SLOTS, np.int64))


def fit(train: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = PER_LABEL, most_rows: int = MOST_ROWS) -> Model:
    """Learns from the rows of ``train`` with a text and a label."""
    usable = train.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    n, df = document_frequencies(usable.select(text))
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    counts = {r[label]: r["count"] for r in usable.groupBy(label).count().collect()}  # a number for each label
    labels = sorted(counts)
    if not labels:
        return Model([], idf, np.zeros((SLOTS, 0)), np.zeros(0), 1.0)
    each = max(5, min(per_label, most_rows // len(labels)))
    # A share of each label's hashes that holds several times the sample; the exact number is then cut from these few rows.
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), text, F.lit(9)), F.lit(1 << 31))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * each / n) * (1 << 31))])
    lowest = F.row_number().over(Window.partitionBy(label).orderBy("_place", F.xxhash64(text)))
    chosen = usable.select(key, label, text, place.alias("_place")).filter(F.col("_place") < F.try_element_at(share, F.col(label))).withColumn("_row", lowest).filter(F.col("_row") <= each)

    def vectors(batches):
        for batch in batches:
            out = []
            for a, b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, w = features(a, idf)
                out.append({"label": b, "row": c, "at": at.astype("<i4").tobytes(), "w": w.astype("<f4").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("label", pa.string()), ("row", pa.int32()), ("at", pa.binary()), ("w", pa.binary())]))

    found = chosen.select(text, label, "_row").mapInArrow(vectors, "label string, row int, at binary, w binary").collect()
    no = {x: i for i, x in enumerate(labels)}
    rows = sorted(((r["row"], no[r["label"]], np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["w"], "<f4").astype(float)) for r in found), key=lambda r: r[:2])
    fitted, kept = [r for r in rows if r[0] % 5], [r for r in rows if not r[0] % 5]
    weights, bias = ftrl([(at, w, y) for _, y, at, w in fitted], len(labels))
    logits = np.array([w @ weights[at] + bias for _, _, at, w in kept]).reshape(-1, len(labels))
    return Model(labels, idf, weights, bias, temperature(logits, np.array([y for _, y, _, _ in kept], int)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``. The model has a fixed size (slots by labels)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        model_ = shared.value
        out = pd.DataFrame([model_.predict(t) for t in texts], columns=["lang", "score"])
        words.trim()
        return out

    own = fresh(docs, "guess")
    return docs.withColumn(own, guess(text)).withColumns({"lang_pred": F.col(f"{own}.lang"), "score": F.col(f"{own}.score")}).drop(own)


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Predicts every document; learns from those whose crc32 of the id is not 2 modulo 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
