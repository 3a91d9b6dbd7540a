"""Configurations with presets, results kept by what they were made from, and a row for each run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from panelforge.sources.store import exists


def overlay(base: Mapping, preset: Mapping, where: str = "") -> dict:
    """base with a preset's values laid over it, level by level; a key that base doesn't have is an error."""
    out = dict(base)
    for key, value in preset.items():
        if key not in base:
            raise KeyError(f"unknown setting: {where}{key}")
        nested = isinstance(base[key], Mapping)
        if nested != isinstance(value, Mapping):
            raise TypeError(f"{where}{key} is {'a section' if nested else 'a value'}")
        out[key] = overlay(base[key], value, f"{where}{key}.") if nested else value
    return out


def fingerprint(config: Mapping) -> str:
    """SHA-256 of the configuration as JSON with sorted keys; equal settings have equal prints."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def kept(spark: SparkSession, root: str, name: str, vintage: str, config: Mapping, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made from this vintage with this configuration: read where it is whole, else made and written."""
    path = f"{root}/{name}/vintage={vintage}/config={fingerprint(config)[:16]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def record_run(spark: SparkSession, root: str, run_id: str, config: Mapping, status: str, details: Mapping) -> None:
    """One row for a run; nested details are JSON. A run recorded again replaces its row."""
    row = [(run_id, fingerprint(config), status, json.dumps(config, sort_keys=True), json.dumps(details, sort_keys=True))]
    spark.createDataFrame(row, "run_id string, config_sha256 string, status string, config string, details string").coalesce(1).write.mode("overwrite").parquet(f"{root}/run={run_id}")
