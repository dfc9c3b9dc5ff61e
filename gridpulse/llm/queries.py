"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridpulse.llm import chat, config_packing, decontam, importance, langid, packing, quality, ranked, recompress, secrets, sharding, simhash, topk
from gridpulse.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_packing")
def op1(spark, sf_dir):
    pieces = packing.pack(read(spark, sf_dir, "documents"), capacity=1024)
    return pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op2_decontamination")
def op2(spark, sf_dir):
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), passages=True)


@query("op3_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
""")
def op3(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").where(topk.usable("embedding")).select("vec_id", topk.quantise("embedding").alias("v"))
    return topk.top_k(v, v.where("vec_id % 50 = 0"), k=5)


@query("op4_simhash")
def op4(spark, sf_dir):
    groups = simhash.near_groups(read(spark, sf_dir, "documents"), shingle=3, words=1, radius=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_language")
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(langid.learnable(docs))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


@query("op6_repeats")
def op6(spark, sf_dir):
    cut = recompress.remove_repeats(read(spark, sf_dir, "documents"), width=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_chat")
def op7(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(rows))


@query("op8_shards")
def op8(spark, sf_dir):
    placed = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_quality")
def op9(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    rated = quality.rate(read(spark, sf_dir, "documents"), labels)
    return rated.select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_secrets")
def op10(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"), secrets.default_forest(spark))


@query("op11_config_packing")
def op11(spark, sf_dir):
    pieces = config_packing.pack_whole(read(spark, sf_dir, "documents"), capacity=4096)
    return pieces.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")


@query("op12_ranked", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), total AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS words FROM d WHERE len(words) > 0),
tf AS (SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY r, word),
item AS (
  SELECT item_id, word, count(*) AS times
  FROM (
    SELECT item_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)
  ) GROUP BY item_id, word
), weight AS (
  SELECT word, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total WHERE word IN (SELECT word FROM item) GROUP BY word, docs
), score AS (
  SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(d.words) * total.docs) // total.words)))) AS BIGINT) AS score
  FROM item JOIN weight USING (word) JOIN tf USING (word) JOIN d USING (r), total GROUP BY item_id, r
)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS k FROM score JOIN d USING (r) WHERE score > 0)
WHERE k <= 20
""")
def op12(spark, sf_dir):
    return ranked.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


@query("op13_importance", r"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), source AS (SELECT r, unnest(words) AS word FROM low),
word AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM source UNION ALL SELECT word FROM target)),
steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step
), bucket AS (
  SELECT word, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i:
        16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
      lambda a, b: xor(step[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) % 10000 AS bucket
  FROM word, steps
), s AS (SELECT bucket, count(*) AS n FROM source JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN bucket USING (word) GROUP BY bucket),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
    / (CAST(s.n + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weight AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM source JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS DOUBLE) + 0.5)
      / 4294967296))) AS BIGINT) AS score
  FROM low LEFT JOIN weight USING (r)
), ranked AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id ASC NULLS LAST) AS k FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN k <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN k END AS rank
FROM ranked
""")
def op13(spark, sf_dir):
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), buckets=10_000, longest=1, least_words=20,
                                percent=10, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
