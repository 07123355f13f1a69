"""Which files a run reads: ordered patterns with the newest match first, tables too small to be right left out, run folders with a manifest."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.sources.files import read_bars, read_table

#: Names of the modes, of the manifest, and of what it calls prices and volumes; patterns of a working folder, by preference.
LATEST, PINNED, LEGACY = ("run_latest", "latest", "by_run_latest"), ("run_pinned", "pinned"), ("", "legacy_latest", "manual", "runs_data")
MANIFEST = "universe_manifest.json"
ARTIFACTS = {"prices": ("prices_canonical", "prices"), "volume": ("volumes_unadjusted", "volumes_canonical", "volumes")}
PATTERNS = {"prices": ("raw_prices.*.parquet", "raw_prices.parquet"), "volume": ("raw_volume_unadj*.parquet", "raw_volume.*.parquet", "raw_volume.parquet")}
IN_RUN = {"prices": ("raw_prices.parquet",), "volume": ("raw_volume_unadj.parquet", "raw_volume.parquet")}


def _files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Paths that match, files or folders, with their times (ms). By Hadoop's file system, so any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [(s.getPath().toString(), s.getModificationTime()) for s in found or []]


def discover(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Paths of all patterns, each once: those of an earlier pattern first, within one the newest first (then by name)."""
    out: list[str] = []
    for pattern in patterns:
        out += [p for p, _ in sorted(_files(spark, pattern), key=lambda x: (-x[1], x[0])) if p not in out]
    return out


def first_usable(spark: SparkSession, paths: Sequence[str], symbols: int | None = None) -> str | None:
    """The first path that can be read and is not suspiciously small: where at least 100 symbols are expected, a table of under 50 rows with under 50 columns, or under half of the symbols, is. Rows are counted
    from the footers."""
    for path in paths:
        try:
            df = read_table(spark, path)
            wide = len(df.columns) - 1
            small = (symbols or 0) >= 100 and df.count() < 50 and (wide < 50 or wide < 0.5 * symbols)
        except Exception:  # noqa: BLE001  a file that cannot be read is no candidate
            continue
        if not small:
            return path
    return None


def scan_universe(spark: SparkSession, folder: str, patterns: dict[str, Sequence[str]] | None = None, symbols: int | None = None) -> tuple[DataFrame, dict[str, str | None]]:
    """symbol, ts, open, high, low, close, volume of the first usable prices, volumes from the first usable volume file where there is one; and the paths that were read."""
    patterns = patterns or {k: tuple(f"{folder}/{p}" for p in v) for k, v in PATTERNS.items()}
    chosen = {kind: first_usable(spark, discover(spark, patterns[kind]), symbols) for kind in ("prices", "volume")}
    if chosen["prices"] is None:
        raise FileNotFoundError(f"no usable prices for {list(patterns['prices'])}")
    panel = read_bars(spark, chosen["prices"])
    if chosen["volume"] is not None:
        volume = read_bars(spark, chosen["volume"]).select("symbol", "ts", F.coalesce("volume", "close").alias("_v"))  # a wide table of volumes has one column per symbol
        panel = panel.join(volume, ["symbol", "ts"], "left").withColumn("volume", F.coalesce("_v", "volume")).drop("_v")
    return panel, chosen


@dataclass
class Inputs:
    mode: str
    folder: str
    patterns: dict[str, tuple[str, ...]]
    manifest: dict = field(default_factory=dict)


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    found = _files(spark, f"{folder}/{MANIFEST}")
    if not found:
        return None
    try:
        said = json.loads(spark.read.text(found[0][0], wholetext=True).first()[0])
    except (ValueError, TypeError):
        return {}
    return said if isinstance(said, dict) else {}


def _artifact(spark: SparkSession, folder: str, kind: str, said: dict) -> str | None:
    extra = said.get("extra")
    named = extra.get("artifacts") if isinstance(extra, dict) else None
    named = named if isinstance(named, dict) else {}
    tried = [f"{folder}/{n}" for n in IN_RUN[kind]]
    for key in ARTIFACTS[kind]:
        if isinstance(named.get(key), str) and named[key].strip():
            path = named[key]
            # relative to the run's folder; else a file of that name in it
            tried += [path] if path.startswith("/") or ":/" in path else [f"{folder}/{path}", f"{folder}/{path.rsplit('/', 1)[-1]}"]
    return next((found[0][0] for p in tried if (found := _files(spark, p))), None)


def resolve_inputs(spark: SparkSession, base: str, mode: str = "", pinned: str = "", strict: bool = False, fall_back: bool = False) -> Inputs:
    """What to read for a mode: the working folder's patterns; the newest run under base/by_run/RUN-*/outputs, by its manifest's timestamp, then by time; or one pinned run.

    A run's prices and volumes are files of its own folder, or what its manifest names. strict: a run, or a file of it, that is missing raises an error; fall_back: a run that is missing gives the working folder.
    """
    mode = mode.strip().lower()
    legacy = Inputs("legacy_latest", base, {k: tuple(f"{base}/{p}" for p in v) for k, v in PATTERNS.items()})
    if mode in LEGACY:
        return legacy
    if mode in LATEST:
        runs = [(path.rsplit("/", 1)[0], time) for path, time in _files(spark, f"{base}/by_run/RUN-*/outputs/{MANIFEST}")]
        told = [((_manifest(spark, f) or {}).get("timestamp") or "", t, f) for f, t in runs]
        stamps = spark.createDataFrame([(s if isinstance(s, str) else "", t, f) for s, t, f in told], "s string, t long, f string")
        at = F.coalesce(F.try_to_timestamp("s"), F.timestamp_millis("t"))
        newest = stamps.orderBy(at.desc(), F.desc("t"), "f").first() if told else None
        if newest is None:
            if strict and not fall_back:
                raise FileNotFoundError(f"no runs under {base}/by_run")
            return legacy
        name, folder = "run_latest", newest["f"]
    elif mode in PINNED:
        if not pinned.strip():
            if fall_back:
                return legacy
            raise ValueError("a pinned run needs its folder")
        name, folder = "run_pinned", pinned.strip().rstrip("/")
    else:
        raise ValueError(f"unknown input mode {mode!r}")
    said = _manifest(spark, folder)
    found = {kind: _artifact(spark, folder, kind, said or {}) for kind in ("prices", "volume")}
    lack = [k for k, v in found.items() if v is None] + ([MANIFEST] if said is None else [])
    if strict and lack:
        raise FileNotFoundError(f"{folder} lacks {', '.join(lack)}")
    return Inputs(name, folder, {k: (v,) if v else legacy.patterns[k] for k, v in found.items()}, said or {})
