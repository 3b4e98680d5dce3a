"""Fitted models as Parquet: one row for each array of a dataclass, in any folder that Spark can write."""

from __future__ import annotations

from dataclasses import fields

import numpy as np
from pyspark.sql import SparkSession

SCHEMA = "name string, kind string, shape array<int>, numbers array<double>, texts array<string>"


def save(spark: SparkSession, model, path: str) -> None:
    """Arrays (numeric or of text), lists of text and None of a dataclass; numbers pass through doubles."""
    rows = []
    for f in fields(model):
        value = getattr(model, f.name)
        if value is None:
            rows.append((f.name, "none", [], [], []))
            continue
        array = np.asarray(value)
        text = array.dtype.kind in "OUS"
        kind = "list" if isinstance(value, list) else array.dtype.str
        rows.append((f.name, kind, list(array.shape), [] if text else array.reshape(-1).astype(float).tolist(), [str(x) for x in array.reshape(-1)] if text else []))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, kind: type, path: str):
    """The dataclass ``kind`` as :func:`save` has written it."""
    found = {}
    for r in spark.read.parquet(path).collect():
        if r["kind"] == "none":
            found[r["name"]] = None
        elif r["kind"] == "list":
            found[r["name"]] = list(r["texts"]) or list(r["numbers"])
        else:
            found[r["name"]] = np.array(r["texts"] or r["numbers"]).astype(np.dtype(r["kind"])).reshape(r["shape"])
    return kind(**found)
