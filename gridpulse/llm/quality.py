"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees of a forest fitted on the labelled documents give conjunctive rules, one for each path. A logistic
regression with a lasso penalty weighs the rules and drops most of them. What is left is compiled into one Spark column
expression over the statistics columns.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridpulse.llm.common import Scratch, slices
from gridpulse.llm.trees import parse, paths, simplify

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "punctuation", "symbols", "bars", "shouts",
    "line_ends", "non_ascii", "capitalised", "sentence_ends", "distinct_words", "top_word", "repeated_lines", "line_words",
    "repeated_pairs",
]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(b"0123456789"), _table(b".,;:?'\"()-"), _table(b"#$%&*+/<=>@[\\]^_`{}~"),
    _table(b"|"), _table(b"!"), _table(b"\n"), _table(bytes(range(128, 256))),
])


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS; a NULL or empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [math.log1p(len(raw)), *[0.0] * (len(STATISTICS) - 1)]
    size, n = len(raw), len(words)
    share = (_CLASSES @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(lines)
    pairs = n - 1
    return [
        math.log1p(size), math.log1p(n), sum(map(len, words)) / n, float(max(map(len, words))), *share.tolist(),
        sum(w[:1].isupper() for w in words) / n, sum(w[-1:] in b".!?" for w in words) / n, len(counts) / n,
        max(counts.values()) / n, 1 - len(seen) / len(lines), n / len(lines),
        1 - len(set(zip(words, words[1:]))) / pairs if pairs else 0.0,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), *((s, pa.float64()) for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = np.array([statistics(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rules:
    intercept: float
    weights: list[tuple[tuple, float]]  # conditions (statistic, is_greater, threshold) and weight

    def score(self) -> Column:
        """Probability of a good document, as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: tuple) -> Column:
    out = F.lit(True)
    for feature, greater, threshold in rule:
        column = F.col(STATISTICS[feature])
        out = out & (column > threshold if greater else column <= threshold)
    return out


def fit(table: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> Rules:
    """Rules from rows with the statistics and `label` (0.0 or 1.0). With one label or none, no rule is learned."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    seen = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    good, bad = seen.get(1.0, 0), seen.get(0.0, 0)
    if not good or not bad:
        return Rules(math.log((good + 1) / (bad + 1)), [])
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(table)
    forest = RandomForestRegressor(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7,
        minInstancesPerNode=5, seed=seed).fit(rows.select("x", "label"))
    rules = sorted({simplify(p) for t in forest.trees for p in paths(parse(t.toDebugString))})
    if not rules:
        return Rules(math.log(good / bad), [])
    marks = F.array(*[F.when(holds(r), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules])
    lasso = LogisticRegression(featuresCol="r", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    model = lasso.fit(table.select(array_to_vector(marks).alias("r"), "label"))
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients) if w]
    return Rules(float(model.intercept), kept)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of docs, learned from labels (doc_id, quality).

    NULL and empty texts are scored by their (zero) statistics. Labels that are NULL or not 0 or 1 are not used; a
    document that bears several counts with each. A NULL doc_id is scored, but never learned from; repeated rows are scored
    one by one; extra columns are not carried. Without documents there are no rows, without labels all score one half.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.write(with_statistics(docs), "statistics")
    wanted = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label"))
    known = scratch.write(table.join(wanted, "doc_id"), "labelled")
    return table.select("doc_id", fit(known).score().alias("score"))
