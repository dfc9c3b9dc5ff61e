"""Classified panel to the Gold dataset: 48 features, 7 labels, temporal split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridpulse.catalog import DEFAULT_PARAMS, LABEL_COLUMNS, Params
from gridpulse.operators.dataset import temporal_split
from gridpulse.operators.features import ELECTRICAL_FEATURES, THERMAL_FEATURES, build
from gridpulse.operators.labels import add_labels, critical_event
from gridpulse.operators.peaks import peak_counts
from gridpulse.operators.series import HOURLY, Series
from gridpulse.sources.store import materialize


def gold_features(silver: DataFrame, p: Params = DEFAULT_PARAMS, s: Series = HOURLY) -> DataFrame:
    """Silver columns followed by the features that its columns allow, in the recorded order."""
    base = list(silver.columns)
    d = build(silver, p=p, s=s)
    if "temp_oil_value" in base:
        cycles = peak_counts(silver.select(*s.keys, s.time, "temp_oil_value"), s=s).drop("temp_oil_value")
        d = d.join(cycles, [*s.keys, s.time], "left")
    made = [c for c in THERMAL_FEATURES + ELECTRICAL_FEATURES if c in d.columns]
    return d.select(*base, *made)


def gold(silver: DataFrame, event: Column | None = None, events: DataFrame | None = None,
         p: Params = DEFAULT_PARAMS, policy: str = "latest", s: Series = HOURLY) -> DataFrame:
    """Features, labels and split.

    Labels and split only need the time axis and the event flag, so their shuffles carry a few narrow columns; the
    wide feature table takes part in one join at the end.
    """
    key = [*s.keys, s.time]
    flag = event if event is not None else critical_event(silver)
    axis = materialize(silver.select(*key, F.coalesce(flag, F.lit(False)).alias("__event")), "axis")
    axis = temporal_split(axis, p.split_ratio, s)
    if events is not None:
        labelled = add_labels(axis.drop("__event"), events=events, p=p, policy=policy, s=s)
    else:
        labelled = add_labels(axis, F.col("__event"), p=p, policy=policy, s=s).drop("__event")
    return gold_features(silver, p, s).join(labelled.select(*key, *LABEL_COLUMNS, "split"), key)
