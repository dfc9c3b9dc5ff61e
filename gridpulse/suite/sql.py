"""SQL statements of the same steps, for the comparison engine. Built from common table expressions."""

from __future__ import annotations

from gridpulse.catalog import MECHANICAL, SIGNALS, THERMAL, plausible_range

HOUR_US = 3600000000
TAP = MECHANICAL[0]
LINE = [c for c in SIGNALS if c != TAP]


def r(expr: str, name: str | None = None) -> str:
    """Six decimals, ties nudged the same way as on the Spark side."""
    return f"round(({expr}) + 1e-9, 6)" + (f" AS {name}" if name else "")


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_PARTS = [
    ("view", "temp_oil_value", "20 + value * 0.8"),
    ("click", "temp_spot_hot_value", "30 + value"),
    ("error", "temp_ambient_value", "value * 0.5"),
    ("purchase", "current_load_value", "value * 25"),
    ("signup", "tap_position_value", "CAST(least(floor(value / 5), 20) AS DOUBLE)"),
    ("view", "temp_oil_oltc_value", f"20 + {_K} * 0.5"),
    ("click", "temp_bubbling_value", f"100 + {_K}"),
    ("error", "voltage_value", f"120 + {_K} / 5.0"),
    ("purchase", "power_apparent_value", f"{_K} / 2.0"),
]

READINGS = "readings AS (" + " UNION ALL ".join(
    f"SELECT user_id % 4 AS asset_id, '{tag}' AS tag, ts, CAST({expr} AS DOUBLE) AS value FROM events WHERE event_type = '{kind}'"
    for kind, tag, expr in _PARTS
) + ")"

BUCKETS = f"""buckets AS (
  SELECT asset_id, tag, epoch_us(ts) // {HOUR_US} AS hour,
         {r(f"CASE WHEN tag = '{TAP}' THEN arg_max(value, ts) ELSE avg(value) END", "value")},
         {r("avg(value) FILTER (WHERE ts = date_trunc('hour', ts))", "on_hour")},
         min(ts) AS first_ts, max(ts) AS last_ts
  FROM readings GROUP BY asset_id, tag, epoch_us(ts) // {HOUR_US})"""

RANGES = f"""ranges AS (
  SELECT asset_id, CAST(round_even(epoch_us(max(lo)) / {HOUR_US}.0, 0) AS BIGINT) AS lo_hour,
         CAST(round_even(epoch_us(min(hi)) / {HOUR_US}.0, 0) AS BIGINT) AS hi_hour
  FROM (SELECT asset_id, tag, min(first_ts) AS lo, max(last_ts) AS hi FROM buckets GROUP BY ALL) GROUP BY asset_id)"""


def hour_ts(h: str) -> str:
    return f"make_timestamp(({h}) * {HOUR_US})"


PANEL = f"""spine AS (SELECT asset_id, unnest(range(lo_hour, hi_hour + 1)) AS hour FROM ranges),
clipped AS (
  SELECT b.asset_id, b.tag, b.hour, CASE WHEN b.hour = hi_hour THEN on_hour ELSE value END AS value
  FROM buckets b JOIN ranges USING (asset_id) WHERE b.hour BETWEEN lo_hour AND hi_hour),
wide AS (SELECT asset_id, hour, {", ".join(f"max(value) FILTER (WHERE tag = '{c}') AS {c}" for c in SIGNALS)}
  FROM clipped GROUP BY ALL),
panel AS (SELECT s.asset_id, s.hour, {", ".join(f"w.{c}" for c in SIGNALS)}
  FROM spine s LEFT JOIN wide w ON w.asset_id = s.asset_id AND w.hour = s.hour)"""

BACK = "OVER (PARTITION BY asset_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (PARTITION BY asset_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def fill(src: str, out: str, line: list[str], edges: str, forward: list[str] = (), backward: list[str] = ()) -> str:
    """Two CTEs: neighbours of every gap, then the filled columns; other signals pass through."""
    near, cols = [], []
    for c in line:
        x = f"CASE WHEN {c} IS NOT NULL THEN CAST(hour * {HOUR_US} AS DOUBLE) END"
        near += [
            f"last_value({c} IGNORE NULLS) {BACK} AS pv_{c}", f"last_value({x} IGNORE NULLS) {BACK} AS pt_{c}",
            f"first_value({c} IGNORE NULLS) {AHEAD} AS nv_{c}", f"first_value({x} IGNORE NULLS) {AHEAD} AS nt_{c}",
        ]
        mid = f"pv_{c} + (nv_{c} - pv_{c}) / nullif(nt_{c} - pt_{c}, 0) * (CAST(hour * {HOUR_US} AS DOUBLE) - pt_{c})"
        tail = {"both": f", pv_{c}, nv_{c}", "inside": ""}[edges]
        cols.append(f"coalesce({c}, {mid}{tail}) AS {c}")
    for c in [*forward, *backward]:
        near.append(f"last_value({c} IGNORE NULLS) {BACK} AS pv_{c}")
    for c in [*backward, *forward]:
        near.append(f"first_value({c} IGNORE NULLS) {AHEAD} AS nv_{c}")
    cols += [f"CASE WHEN nv_{c} IS NOT NULL THEN pv_{c} END AS {c}" for c in forward]  # up to the last reading
    cols += [f"coalesce(pv_{c}, nv_{c}) AS {c}" for c in backward]
    rest = [c for c in SIGNALS if c not in {*line, *forward, *backward}]
    return (
        f"{out}_near AS (SELECT *, {', '.join(near)} FROM {src}),\n"
        f"{out} AS (SELECT asset_id, hour, {', '.join(cols + rest)} FROM {out}_near)"
    )


def nullify(c: str) -> str:
    lo, hi = plausible_range(c)
    return f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}"


CONSOLIDATED = fill("panel", "consolidated", THERMAL, "inside", forward=[TAP])
PLAUSIBLE_CTE = f"plausible AS (SELECT asset_id, hour, {', '.join(nullify(c) for c in SIGNALS)} FROM consolidated)"
FILLED = fill("plausible", "filled", LINE, "both", backward=[TAP])
CLEAN = f"""clean AS (SELECT asset_id, hour, {hour_ts("hour")} AS ts, {", ".join(r(c, c) for c in SIGNALS)} FROM filled)"""

TO_BUCKETS = [READINGS, BUCKETS]
TO_PANEL = [*TO_BUCKETS, RANGES, PANEL]
TO_CLEAN = [*TO_PANEL, CONSOLIDATED, PLAUSIBLE_CTE, FILLED, CLEAN]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---- classification ---------------------------------------------------------------------------------------------

def _oil_hot() -> tuple[str, str]:
    overload = "(current_load_value > 2000 AND (temp_oil_value > 70 OR temp_oil_oltc_value > 70))"
    steep = (
        "(CASE WHEN temp_spot_hot_value - temp_oil_value > 25 THEN temp_spot_hot_value - temp_oil_value "
        "WHEN temp_spot_hot_value - temp_oil_oltc_value > 25 THEN temp_spot_hot_value - temp_oil_oltc_value END)"
    )
    return overload, steep


def classified() -> list[str]:
    from gridpulse.catalog import GRADIENT_TEXT, OVERLOAD_TEXT, RULES
    from gridpulse.operators.rules import rule_columns

    hits, crits, names, texts, alerts = [], [], [], [], []
    for rule in RULES:
        for c in rule_columns(SIGNALS, rule.variable):
            def band(b, c=c):
                top = f" AND {c} < {b[1]}" if b[1] != float("inf") else ""
                return f"coalesce({c} >= {b[0]}{top}, false)"

            i = len(crits)
            hits.append(f"{band(rule.critical)} AS c{i}, {band(rule.alert)} AS b{i}")
            crits.append(f"c{i}")
            alert = f"(b{i} AND NOT ({' OR '.join(crits)}))"
            alerts.append(alert)
            names.append(f"CASE WHEN c{i} OR {alert} THEN '{c}' END")
            texts.append(f"CASE WHEN c{i} THEN '{rule.description} CRÍTICO' WHEN {alert} THEN '{rule.description} ALERTA' END")
    overload, steep = _oil_hot()
    crit = f"({' OR '.join(crits)} OR coalesce({overload}, false))"
    grad = f"(CASE WHEN NOT {crit} THEN {steep} END)"
    return [
        f"hits AS (SELECT *, {', '.join(hits)} FROM clean)",
        f"""silver AS (SELECT asset_id, hour, ts, {", ".join(SIGNALS)},
        CASE WHEN {crit} THEN 'CRITICO' WHEN {' OR '.join(alerts)} OR {grad} IS NOT NULL THEN 'ALERTA' ELSE 'NORMAL' END AS estado_operacional,
        CASE WHEN {crit} THEN 2 WHEN {' OR '.join(alerts)} OR {grad} IS NOT NULL THEN 1 ELSE 0 END AS nivel_severidad,
        concat_ws(', ', {', '.join(names)}) AS variables_anomalas,
        concat_ws('; ', {', '.join(texts)}, CASE WHEN {overload} THEN '{OVERLOAD_TEXT}' END,
                  CASE WHEN {grad} IS NOT NULL THEN '{GRADIENT_TEXT} (' || format('{{:.1f}}', {grad}) || '°C)' END) AS descripcion_anomalia
        FROM hits)""",
    ]


TO_SILVER = [*TO_CLEAN, *classified()]


# ---- windows ----------------------------------------------------------------------------------------------------

W = "PARTITION BY asset_id ORDER BY hour"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({W})"


def diff(c: str) -> str:
    return f"({c} - {lag(c)})"


def roll(agg: str, c: str, n: int, min_periods: int = 1) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if min_periods <= 1:
        return f"{agg}({c}) {frame}"
    return f"(CASE WHEN count({c}) {frame} >= {min_periods} THEN {agg}({c}) {frame} END)"
