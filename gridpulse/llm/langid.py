"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

* Features: 1-, 2- and 3-grams of the lower-cased text, every run of non-letters being one space, hashed to `2**bits`
  columns. The term frequency is the share of the document's n-grams, scaled; document frequencies are counted over all
  learnable documents.
* Fit: follow-the-regularised-leader with L1 and L2 penalties on a sample of at most about `per_class` documents a
  language (drawn by hash of the id, so the bound does not depend on the table); a fifth of the sample is left out to
  fit the temperature that calibrates the probabilities.
* Prediction reads every whole text once.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridpulse.llm.common import fold, free_name, slices

ORDERS = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    bits: int = 15
    per_class: int = 1500
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    scale: float = 20.0
    unknown: str = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2**bits + 1, languages), the last row is the bias; IDF is multiplied in
    temperature: float
    settings: Settings


@functools.cache
def _letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str, bits: int) -> np.ndarray:
    """Hashed n-grams of a text with at least one letter, one entry per occurrence."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint32)
    shift = np.uint32(32 - bits)
    out, h = [], np.zeros(len(code), dtype=np.uint32)
    for n in ORDERS:
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
        out.append((h * np.uint32(0x9E3779B1)) >> shift)
    return np.concatenate(out)


def _document_frequency(learn: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of learnable documents and, for each column, of those that hold it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(1 << bits, dtype=np.int64)
        seen = np.zeros(1 << bits, dtype=bool)
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                if has_letter(text):
                    seen[:] = False
                    seen[grams(text, bits)] = True
                    df += seen
                    total += 1
        at = np.flatnonzero(df)
        yield pa.record_batch({"h": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(df[at], total), pa.int64())})

    rows = learn.select("text").mapInArrow(count, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << bits)
    known = rows[rows["h"] >= 0]
    df[known["h"].to_numpy()] = known["n"].to_numpy()
    return int(rows.loc[rows["h"] < 0, "n"].sum()), df


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], columns: int, classes: int, s: Settings) -> np.ndarray:
    """Weights after `epochs` passes of FTRL-proximal; an example is (columns, values, class)."""
    z, n = np.zeros((columns, classes)), np.zeros((columns, classes))

    def weights(rows):
        zz = z[rows]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n[rows])) / s.alpha + s.l2)

    order = np.random.default_rng(5)
    for _ in range(s.epochs):
        for i in order.permutation(len(examples)):
            at, x, y = examples[i]
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / s.alpha * w
            n[at] = new
    return weights(slice(None))


def fit_temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """Temperature with the least cross entropy on the left-out part, by golden-section search on its logarithm.

    Targets are smoothed by one error in n + 2, so that a part without errors does not drive probabilities to one."""
    if not len(truth) or scores.shape[1] < 2:
        return 1.0
    wrong = 1 / (len(truth) + 2)
    target = np.full(scores.shape, wrong / (scores.shape[1] - 1))
    target[np.arange(len(truth)), truth] = 1 - wrong

    def loss(log_t):
        v = scores / np.exp(log_t)
        v = v - v.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(v).sum(1)) - (target * v).sum(1)))

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from rows (doc_id, text, lang) with a language and an id; the caller leaves out what must stay unseen."""
    learn = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    columns = 1 << settings.bits
    if not languages:
        return Model([], np.zeros((columns + 1, 0)), 1.0, settings)
    total, df = _document_frequency(learn, settings.bits)
    idf = np.log((1 + total) / (1 + df)) + 1
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, settings.per_class / n))).otherwise(share)
    sample = learn.where(draw < share)
    held = sample.sparkSession.sparkContext.broadcast(idf)
    bits, scale, index = settings.bits, settings.scale, {name: i for i, name in enumerate(languages)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct columns and TF-IDF values of the sampled documents."""
        for part in slices(batches):
            rows = []
            for doc_id, text, lang in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                if has_letter(text):
                    at, n = np.unique(grams(text, bits), return_counts=True)
                    rows.append((doc_id, index[lang], at.tolist(), (scale * n / n.sum() * held.value[at]).tolist()))
            if rows:
                a, b, c, d = zip(*rows)
                yield pa.record_batch({"doc_id": pa.array(a, pa.int64()), "y": pa.array(b, pa.int32()),
                                       "at": pa.array(c, pa.list_(pa.int32())), "x": pa.array(d, pa.list_(pa.float64()))})

    def learn_all(table: pa.Table) -> pa.Table:
        """One bounded group: the sample. Rows are sorted, so that the result does not depend on their arrival."""
        table = table.sort_by([("doc_id", "ascending"), ("y", "ascending")])
        examples = [
            (np.append(at.as_py(), columns), np.append(x.as_py(), 1.0), y.as_py())
            for at, x, y in zip(table.column("at"), table.column("x"), table.column("y"))
        ]
        left_out = [e for i, e in enumerate(examples) if i % 5 == 4]
        w = train_ftrl([e for i, e in enumerate(examples) if i % 5 != 4], columns + 1, len(languages), settings)
        scores = np.array([x @ w[at] for at, x, _ in left_out])
        t = fit_temperature(scores, np.array([y for *_, y in left_out], dtype=int))
        row, col = np.nonzero(w)
        return pa.table({"row": pa.array(np.append(row, -1), pa.int32()), "col": pa.array(np.append(col, -1), pa.int32()),
                         "w": pa.array(np.append(w[row, col], t), pa.float64())})

    found = (
        sample.mapInArrow(sparse, "doc_id long, y int, at array<int>, x array<double>")
        .groupBy(F.lit("sample").alias("part")).applyInArrow(learn_all, "row int, col int, w double").toPandas()
    )
    weights = np.zeros((columns + 1, len(languages)))
    real = found[found["row"] >= 0]
    weights[real["row"].to_numpy(), real["col"].to_numpy()] = real["w"].to_numpy()
    weights[:columns] *= (scale * idf)[:, None]
    t = found.loc[found["row"] < 0, "w"]
    return Model(languages, weights, float(t.iloc[0]) if len(t) else 1.0, settings)


def predict_one(text: str | None, model: Model) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return model.settings.unknown, 0.0
    g = grams(text, model.settings.bits)
    score = (model.weights[g].sum(0) / len(g) + model.weights[-1]) / model.temperature
    p = np.exp(score - score.max())
    best = int(p.argmax())
    return model.languages[best], float(p[best] / p.sum())


def language_udf(spark: SparkSession, model: Model):
    """Column function text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(Model(model.languages, model.weights.astype(np.float32), model.temperature, model.settings))

    @F.pandas_udf("lang_pred string, score double")
    def predict(text):
        import pandas as pd

        return pd.DataFrame([predict_one(t, shared.value) for t in text], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and lang_pred, score. NULL texts and texts without a letter are `und` with score 0; columns of
    these two names are replaced. Every row is predicted by its own text, repeated rows alike. With nothing to learn from, all is `und`."""
    predict = language_udf(docs.sparkSession, model)
    rest = docs.drop("lang_pred", "score")
    found = free_name(rest, "lang_found")
    return rest.withColumn(found, predict("text")).select(*rest.columns, f"{found}.lang_pred", f"{found}.score")


def learnable(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    return docs.where(fold("doc_id", folds) != held_out)
