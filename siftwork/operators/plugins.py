"""Plug-in points: metrics and label sources given as ``module:function``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load(spec: str | Callable) -> Callable:
    if callable(spec):
        return spec
    module, sep, name = spec.partition(":")
    if not sep:
        raise ValueError(f"expected module:function, got {spec!r}")
    return getattr(importlib.import_module(module), name)


def apply_metric(predictions: DataFrame, by: list[str], metric: str | Callable) -> DataFrame:
    """(by.., metric_name, metric) from a plug-in ``f() -> column`` or ``f() -> (name, column)``.

    The plug-in returns an aggregate expression over prediction columns, so it combines
    map-side and no group has to fit one task.
    """
    fn = load(metric)
    out = fn()
    name, value = out if isinstance(out, tuple) else (getattr(fn, "__name__", "metric"), out)
    g = predictions.groupBy(*by).agg(value.cast("double").alias("metric"))
    return g.withColumn("metric_name", F.lit(name))


DELTA_SCHEMA = "sample_id bigint, peft_id string, task_id string, anchor_idx bigint, horizon bigint, delta_raw double"


def measure_deltas(triples: DataFrame, source: str | Callable, schema: str = DELTA_SCHEMA) -> DataFrame:
    """Delta rows from a plug-in over Arrow batches of triples; nothing is shipped here."""
    return triples.mapInPandas(load(source), schema)
