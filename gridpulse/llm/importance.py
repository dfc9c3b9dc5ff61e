"""Target-distribution importance resampling over hashed runs of words.

Features are the runs of 1 to `longest` consecutive words, hashed into buckets by CRC-32. Each normalised text is scanned
once, keeping its running CRCs; the CRC of any run follows from two prefixes, as the contribution of the shorter one
is cancelled by a GF(2)-linear shift (`terms.run_crcs`), so no run is cut out or hashed by itself.

1. Buckets are counted over all documents and over the target texts; each task sends one row per bucket.
2. A bucket's gain is its log ratio of smoothed frequencies. The gains, a table bounded by the number of buckets, go to
   the tasks that add them up per document.
3. Log weights plus Gumbel noise of the id's hash are ranked; the highest ones are a draw without replacement in
   proportion to the weights. Ranks are positions in a table dealt by ranges of (score, id), so no task holds all.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridpulse.llm.common import Scratch
from gridpulse.llm.terms import run_crcs, running, words_of

_PART_BITS = 33  # rows of one task in monotonically_increasing_id


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 1) -> DataFrame:
    """bucket, n: how often each bucket is met in column `text`; buckets that are not met are left out."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for _, parts in words_of(batches, longest - 1):
            for found in parts:
                crcs = running(found.data)
                for length in range(1, longest + 1):
                    counts += np.bincount(run_crcs(found, crcs, length)[1] % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], schema=schema)

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed frequencies), target over source, for each bucket."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(scale * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _counted(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    out = np.zeros(buckets, dtype=np.int64)
    for r in bucket_counts(texts, buckets, longest).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for some, parts in words_of(batches, longest - 1):
            n_words, n_features, weight = (np.zeros(len(some), dtype=np.int64) for _ in range(3))
            for found in parts:
                crcs = running(found.data)
                for length in range(1, longest + 1):
                    text, crc = run_crcs(found, crcs, length)
                    many = np.bincount(text, minlength=len(some))
                    n_features += many
                    if length == 1:
                        n_words += many
                    # texts come in order, so sums of neighbours are exact integers
                    total = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                    edge = np.cumsum(many)
                    weight += total[edge] - total[edge - many]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id").cast(pa.int64()), *map(pa.array, (n_words, n_features, weight))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int, scale: int = 1000) -> Column:
    """floor(scale * Gumbel noise) from the hash of `seed:doc_id`; a NULL id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, least_words: int = 20, percent: int = 10,
             seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is NULL for rows that are not drawn.

    Of the N rows with at least `least_words` words, floor(percent * N / 100) are drawn: highest scores first, ties to
    the smaller doc_id (a NULL one last), rows equal in both in any order. NULL and empty texts, on either side, have no
    words; their weight is 0. Repeated rows count and are ranked one by one. Very long texts are read in parts. Extra
    columns are not carried. Empty tables give no rows, an empty target counts as zero everywhere.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    gain = gains(_counted(docs, buckets, longest), _counted(target, buckets, longest))
    rows = scratch.write(
        weighed(docs, gain, longest).withColumn("enough", F.col("n_words") >= least_words)
        .withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "weights")
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = scratch.write(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    scratch.drop("weights")
    part = F.shiftright("place", _PART_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("enough").alias("enough")).collect()  # one row per task
    drawn = percent * sum(r["enough"] for r in sizes) // 100
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << _PART_BITS) - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
