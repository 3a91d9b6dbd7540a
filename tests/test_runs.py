"""Presets, kept results and run records."""

import pytest

from panelforge.sources import runs


def test_overlay():
    base = {"a": 1, "b": {"c": 2, "d": [3]}}
    assert runs.overlay(base, {"b": {"c": 5}}) == {"a": 1, "b": {"c": 5, "d": [3]}}
    assert base["b"]["c"] == 2 and runs.overlay(base, {}) == base
    with pytest.raises(KeyError, match="b.x"):
        runs.overlay(base, {"b": {"x": 1}})
    with pytest.raises(TypeError):
        runs.overlay(base, {"b": 4})
    assert runs.fingerprint({"x": 1, "y": 2}) == runs.fingerprint({"y": 2, "x": 1}) != runs.fingerprint({"x": 1, "y": 3})


def test_kept(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for config in ({"h": 1}, {"h": 1}, {"h": 2}):
        assert runs.kept(spark, str(tmp_path), "t", "v001", config, make).count() == 3
    assert len(made) == 2


def test_record_run(spark, tmp_path):
    for status in ("FAIL", "OK"):
        runs.record_run(spark, str(tmp_path), "r1", {"a": {"b": 1}}, status, {"rows": [1, 2]})
    rows = spark.read.parquet(str(tmp_path)).collect()
    assert [(r.status, r.details) for r in rows] == [("OK", '{"rows": [1, 2]}')]
