"""Choice of input files."""

from __future__ import annotations

import json
import os

import pytest

from tidepanel.sources import inputs


def wide(spark, path, symbols=3, days=60, value=1.0, when=None):
    rows = [(f"2020-{1 + d // 28:02}-{1 + d % 28:02}", *[value + d] * symbols) for d in range(days)]
    spark.createDataFrame(rows, "date string, " + ", ".join(f"S{i} double" for i in range(symbols))).coalesce(1).write.parquet(str(path))
    if when:
        os.utime(path, (when, when))


def test_earlier_patterns_first_then_the_newest(spark, tmp_path):
    for name, when in (("raw_prices.a.parquet", 1000), ("raw_prices.b.parquet", 3000), ("raw_prices.parquet", 9000)):
        wide(spark, tmp_path / name, when=when)
    found = inputs.discover(spark, [f"{tmp_path}/raw_prices.*.parquet", f"{tmp_path}/raw_prices.parquet", f"{tmp_path}/none*"])
    assert [f.rsplit("/", 1)[-1] for f in found] == ["raw_prices.b.parquet", "raw_prices.a.parquet", "raw_prices.parquet"]


def test_small_and_broken_tables_are_no_candidates(spark, tmp_path):
    wide(spark, tmp_path / "raw_prices.new.parquet", symbols=3, days=10, when=5000)
    (tmp_path / "raw_prices.bad.parquet").write_text("no parquet")
    wide(spark, tmp_path / "raw_prices.old.parquet", symbols=60, days=60, value=5.0, when=1000)
    wide(spark, tmp_path / "raw_volume.parquet", symbols=60, days=60, value=100.0)
    panel, paths = inputs.scan_universe(spark, str(tmp_path), symbols=120)
    assert paths["prices"].endswith("raw_prices.old.parquet") and paths["volume"].endswith("raw_volume.parquet")
    first = panel.where("symbol = 'S7'").orderBy("ts").first()
    assert (first.close, first.volume) == (5.0, 100.0) and panel.count() == 3600
    small, paths = inputs.scan_universe(spark, str(tmp_path), symbols=3)
    assert paths["prices"].endswith("raw_prices.new.parquet") and small.count() == 30
    with pytest.raises(FileNotFoundError):
        inputs.scan_universe(spark, str(tmp_path / "none"))


def run(spark, base, name, timestamp, artifacts=None, prices=True):
    out = base / "by_run" / name / "outputs"
    out.mkdir(parents=True)
    if prices:
        wide(spark, out / "raw_prices.parquet")
        wide(spark, out / "raw_volume.parquet")
    (out / "universe_manifest.json").write_text(json.dumps({"timestamp": timestamp, "run_id": name, "extra": {"artifacts": artifacts or {}}}))
    return str(out)


def test_modes(spark, tmp_path):
    assert inputs.resolve_inputs(spark, str(tmp_path), "run_latest").mode == "legacy_latest"
    with pytest.raises(FileNotFoundError):
        inputs.resolve_inputs(spark, str(tmp_path), "run_latest", strict=True)
    assert inputs.resolve_inputs(spark, str(tmp_path), "latest", strict=True, fall_back=True).mode == "legacy_latest"
    run(spark, tmp_path, "RUN-1", "2024-05-01T10:00:00+00:00")
    run(spark, tmp_path, "RUN-2", "2024-06-01T10:00:00+00:00")
    run(spark, tmp_path, "RUN-3", "2024-04-01T10:00:00+00:00")
    run(spark, tmp_path, "PRC-4", "2030-01-01T10:00:00+00:00")
    found = inputs.resolve_inputs(spark, str(tmp_path), " Run_Latest ", strict=True)
    assert found.mode == "run_latest" and found.manifest["run_id"] == "RUN-2" and found.patterns["prices"][0].endswith("RUN-2/outputs/raw_prices.parquet")
    panel, _ = inputs.scan_universe(spark, found.folder, found.patterns)
    assert panel.count() == 180
    with pytest.raises(ValueError, match="unknown"):
        inputs.resolve_inputs(spark, str(tmp_path), "other")


def test_pinned_runs(spark, tmp_path):
    other = tmp_path / "kept.parquet"
    wide(spark, other)
    out = run(spark, tmp_path, "RUN-9", None, {"prices": str(other), "volumes": "elsewhere/vol.parquet"}, prices=False)
    with pytest.raises(FileNotFoundError, match="volume"):
        inputs.resolve_inputs(spark, str(tmp_path), "pinned", out, strict=True)
    wide(spark, tmp_path / "by_run" / "RUN-9" / "outputs" / "vol.parquet")
    found = inputs.resolve_inputs(spark, str(tmp_path), "pinned", out + "/", strict=True)
    assert found.patterns["prices"][0].endswith("kept.parquet") and found.patterns["volume"][0].endswith("outputs/vol.parquet")
    with pytest.raises(ValueError):
        inputs.resolve_inputs(spark, str(tmp_path), "pinned")
    assert inputs.resolve_inputs(spark, str(tmp_path), "pinned", fall_back=True).mode == "legacy_latest"
