"""Checked queries: ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.catalog import SIGNAL_ALIASES, TAG_POINTS
from gridpulse.session import fresh_dir
from gridpulse.sources import bronze, landing
from gridpulse.sources.driver_tables import table
from gridpulse.suite.base import query, readings
from gridpulse.suite.sql import READINGS, r, with_

# Each event becomes one historian item; the kind of event decides the kind of value.
# Numbers are scaled by powers of two, which is exact, to reach very large and very small ones.
_SIZES = (1.0, 2.0**30, 2.0**-24, 1.0, 2.0**60, 2.0**-13)
_SIZED = "(value * CASE event_id % 6 " + " ".join(f"WHEN {i} THEN CAST({x!r} AS DOUBLE)" for i, x in enumerate(_SIZES)) + " END)"
_SPLIT_SQL = f"""
    {r(f"CASE event_type WHEN 'view' THEN {_SIZED} WHEN 'click' THEN value END", "value")},
    CASE event_type WHEN 'view' THEN CAST({_SIZED} AS VARCHAR)
        WHEN 'click' THEN replace(CAST(value AS VARCHAR), '.', ',')
        WHEN 'purchase' THEN ' ' || CAST(value AS VARCHAR) || 'd'
        WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END END AS value_text,
    CASE WHEN event_type = 'signup' THEN event_id % 2 = 0 END AS value_bool"""


def _json_value():
    v = F.col("value").cast("string")
    kind = F.col("event_type")
    sized = F.element_at(F.array(*[F.lit(x) for x in _SIZES]), (F.col("event_id") % len(_SIZES) + 1).cast("int")) * F.col("value")
    return (
        F.when(kind == "view", sized.cast("string"))
        .when(kind == "click", F.concat(F.lit('"'), F.replace(v, F.lit("."), F.lit(",")), F.lit('"')))
        .when(kind == "error", F.lit('{"Name":"No Data"}'))
        .when(kind == "purchase", F.concat(F.lit('" '), v, F.lit('d"')))
        .otherwise((F.col("event_id") % 2 == 0).cast("string"))
    )


@query("value_split", f"SELECT event_id, {_SPLIT_SQL} FROM events")
def value_split(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.parse_json(_json_value()).alias("v"))
    return ev.select("event_id", *[e.alias(n) for n, e in landing.split_value(F.col("v")).items()])


@query(
    "landing_items",
    f"""SELECT user_id % 4 AS asset_id, event_type AS tag, CASE WHEN event_id % 11 <> 0 THEN ts END AS timestamp, {_SPLIT_SQL},
        CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE '__missing__' END AS date FROM events""",
)
def landing_items(spark, sf):
    """Items written as landed JSON, read back as variants, split and typed; unreadable times stay in."""
    stamp = F.when(F.col("event_id") % 11 == 0, F.lit("no time")).otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )
    page = F.concat(F.lit('{"Items":[{"Timestamp":"'), stamp, F.lit('","Value":'), _json_value(), F.lit("}]}"))
    ev = table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("asset_id"), F.col("event_type").alias("tag"), page.alias("page")
    )
    path = fresh_dir(spark, "landing")
    ev.write.partitionBy("asset_id", "tag").text(path)
    return landing.to_bronze_rows(landing.read_items(spark, path, page_per_file=False))


@query("distinct_tags", with_([READINGS], "SELECT DISTINCT tag FROM readings"))
def distinct_tags(spark, sf):
    return bronze.distinct_tags(readings(spark, sf))


_CATALOGUE = "catalogue AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', 'TR1.{TAG_POINTS[a]}')" for a, s in SIGNAL_ALIASES.items()
) + ") t(tag, source_path))"


@query(
    "tag_catalogue_join",
    with_([READINGS, _CATALOGUE], "SELECT tag, source_path, count(*) AS readings FROM readings LEFT JOIN catalogue USING (tag) GROUP BY ALL"),
)
def tag_catalogue_join(spark, sf):
    from gridpulse.functions.joins import attach_bounded
    from gridpulse.operators.panel import signal_of

    cat = landing.tag_catalogue(spark).withColumn("tag", signal_of(F.col("tag")))
    counts = readings(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("readings"))
    return attach_bounded(counts, cat, ["tag"])


@query(
    "high_water_mark",
    with_([READINGS], "SELECT asset_id, tag, date_trunc('second', max(ts)) AS mark FROM readings GROUP BY ALL"),
)
def high_water_mark(spark, sf):
    return bronze.high_water_marks(readings(spark, sf))


@query(
    "time_column_marks",
    with_([READINGS], """SELECT 'ts' AS source, asset_id, tag, max(ts) AS mark FROM readings GROUP BY asset_id, tag
        UNION ALL SELECT 'timestamp', asset_id, tag, max(ts) FROM readings GROUP BY asset_id, tag"""),
)
def time_column_marks(spark, sf):
    """Tables that name their time column `ts` or `timestamp` are read alike."""
    new = readings(spark, sf)
    named = {"ts": new, "timestamp": new.withColumnRenamed("ts", "timestamp")}
    found = [bronze.exact_marks(df).select(F.lit(name).alias("source"), "asset_id", "tag", "mark") for name, df in named.items()]
    return found[0].unionByName(found[1])


@query(
    "numbered_names",
    with_([READINGS], """SELECT asset_id AS position, tag || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS name
        FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY asset_id) - 1 AS n FROM (SELECT DISTINCT asset_id, tag FROM readings))"""),
)
def numbered_names(spark, sf):
    """Series of several assets side by side: repeated names get a number, in order."""
    from gridpulse.operators.clean import numbered_names as number

    return number(readings(spark, sf).select(F.col("asset_id").alias("position"), F.col("tag").alias("name")).distinct())


_RESUME = """marks AS (SELECT asset_id, tag, max(ts) AS mark FROM readings
    WHERE ts < TIMESTAMP '2024-01-16' AND tag <> 'voltage_value' GROUP BY ALL)"""


def _resume(spark, sf, exact):
    new = readings(spark, sf)
    stored = new.where((F.col("ts") < F.lit("2024-01-16").cast("timestamp")) & (F.col("tag") != "voltage_value"))
    marks = bronze.exact_marks(stored) if exact else bronze.high_water_marks(stored)
    return bronze.resume(new, marks, F.lit("2024-01-10").cast("timestamp"), exact=exact)


@query(
    "resume_filter",
    with_([READINGS, _RESUME], f"""SELECT asset_id, tag, ts, {r("value", "value")} FROM readings LEFT JOIN marks USING (asset_id, tag)
        WHERE coalesce(ts > mark, ts >= TIMESTAMP '2024-01-10')"""),
)
def resume_filter(spark, sf):
    return _resume(spark, sf, True)


@query(
    "resume_after_second",
    with_([READINGS, _RESUME], f"""SELECT asset_id, tag, ts, {r("value", "value")} FROM readings LEFT JOIN marks USING (asset_id, tag)
        WHERE coalesce(ts >= date_trunc('second', mark) + INTERVAL 1 SECOND, ts >= TIMESTAMP '2024-01-10')"""),
)
def resume_after_second(spark, sf):
    return _resume(spark, sf, False)


@query(
    "date_ranges",
    """WITH RECURSIVE spans AS (SELECT user_id % 4 AS asset_id, min(ts) AS s, max(ts) AS e FROM events GROUP BY ALL),
    w AS (SELECT asset_id, s AS window_start, least(s + INTERVAL 7 DAY, e) AS window_end, e FROM spans
      UNION ALL SELECT asset_id, window_end + INTERVAL 1 SECOND, least(window_end + INTERVAL 1 SECOND + INTERVAL 7 DAY, e), e
      FROM w WHERE window_end + INTERVAL 1 SECOND < e)
    SELECT asset_id, window_start, window_end FROM w""",
)
def date_ranges(spark, sf):
    spans = table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("asset_id")).agg(
        F.min(F.col("ts").cast("timestamp")).alias("start"), F.max(F.col("ts").cast("timestamp")).alias("end")
    )
    return landing.load_windows(spans, 7)


@query(
    "missing_date_partition",
    """SELECT CASE WHEN event_id % 7 = 0 THEN '__missing__' ELSE strftime(ts, '%Y-%m-%d') END AS date, count(*) AS rows
       FROM events GROUP BY ALL""",
)
def missing_date_partition(spark, sf):
    ev = table(spark, sf, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp")).alias("timestamp"))
    return landing.with_date_partition(ev).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "invalid_time_report",
    """SELECT event_type AS tag, count(*) AS rows, count(*) FILTER (WHERE event_id % 7 = 0) AS invalid_timestamps
       FROM events GROUP BY ALL""",
)
def invalid_time_report(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("tag"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts")
    )
    return bronze.invalid_time_report(ev)


def _bronze_like(spark, sf):
    """Tags with only numbers, only texts, only booleans, and numbers mixed with texts."""
    kind, v = F.col("event_type"), F.col("value")
    mixed = (kind == "signup") & (F.col("event_id") % 5 != 0)
    return table(spark, sf, "events").select(
        "event_id",
        (F.col("user_id") % 4).alias("asset_id"),
        kind.alias("tag"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind.isin("view", "purchase") | ((kind == "signup") & ~mixed), v).alias("value"),
        F.when((kind == "click") | mixed, v.cast("string")).alias("value_text"),
        F.when(kind == "error", v > 20).alias("value_bool"),
    )


@query(
    "value_channel_unify",
    f"""SELECT event_id, user_id % 4 AS asset_id, event_type AS tag, ts AS timestamp,
        {r("CASE WHEN event_type = 'error' THEN CAST(value > 20 AS INTEGER) WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN NULL ELSE value END", "value")}
        FROM events""",
)
def value_channel_unify(spark, sf):
    return bronze.unify_value(_bronze_like(spark, sf))


@query(
    "typed_rows",
    f"""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS timestamp,
        {r("CASE WHEN event_id % 4 <> 0 THEN value END", "value")}, CAST(NULL AS VARCHAR) AS value_text,
        CAST(NULL AS BOOLEAN) AS value_bool, event_type AS tag,
        CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE '__missing__' END AS date FROM events""",
)
def typed_rows(spark, sf):
    """Text columns cast to the Bronze types; what cannot be cast is NULL and no row is lost."""
    text = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, F.lit("?")).otherwise(F.col("ts").cast("string")).alias("timestamp"),
        F.when(F.col("event_id") % 4 == 0, F.lit("bad")).otherwise(F.col("value").cast("string")).alias("value"),
        F.col("event_type").alias("tag"),
    )
    return bronze.conform(text)


@query(
    "keep_tags",
    with_([READINGS], "SELECT asset_id, tag, count(*) AS rows FROM readings WHERE tag IN ('temp_oil_value', 'voltage_value') GROUP BY ALL"),
)
def keep_tags(spark, sf):
    kept = bronze.keep_tags(readings(spark, sf), ["temp_oil_value", "voltage_value", "not_there"])
    return kept.groupBy("asset_id", "tag").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "combine_batches",
    f"""SELECT event_id, {r("CASE WHEN event_type <> 'click' THEN value END", "value")},
        CASE WHEN event_type = 'click' THEN CAST(value AS VARCHAR) END AS value_text FROM events""",
)
def combine_batches(spark, sf):
    ev = table(spark, sf, "events")
    numbers = ev.where("event_type <> 'click'").select("event_id", "value")
    texts = ev.where("event_type = 'click'").select("event_id", F.col("value").cast("string").alias("value_text"))
    return bronze.combine_batches(numbers, texts)


@query(
    "bronze_append_scan",
    with_([READINGS], f"""SELECT asset_id, tag, count(*) AS rows, {r("sum(value)", "total")}, min(ts) AS first_ts, max(ts) AS last_ts
        FROM readings WHERE tag IN ('temp_oil_value', 'tap_position_value') GROUP BY ALL"""),
)
def bronze_append_scan(spark, sf):
    """Two appends with different columns, then a pruned scan of two tag partitions."""
    path = fresh_dir(spark, "bronze")
    rows = readings(spark, sf).withColumnRenamed("ts", "timestamp")
    early = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp")
    bronze.append(rows.where(early), path)
    bronze.append(rows.where(~early).withColumn("source", F.lit("second")), path)
    back = bronze.read(spark, path, ["temp_oil_value", "tap_position_value"])
    return back.groupBy("asset_id", "tag").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    )
