"""YAML settings with includes and local overrides, and dimension tables from YAML lists."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # settings in YAML need it, nothing else does
    yaml = None


class SettingsError(ValueError):
    """Settings that cannot be loaded."""


def merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: mappings merge, everything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(path: str | Path, _above: tuple[Path, ...] = ()) -> dict:
    """Settings of a file on top of its ``include`` list, with ``<name>.local.yaml`` beside it laid over; cycles raise."""
    if yaml is None:
        raise SettingsError("PyYAML is not installed")
    here = Path(path).resolve()
    if here in _above:
        raise SettingsError(f"include cycle at {here}")
    own = yaml.safe_load(here.read_text(encoding="utf-8")) or {}
    if not isinstance(own, dict):
        raise SettingsError(f"{here} holds no mapping")
    names = own.pop("include", [])
    out: dict = {}
    for name in [names] if isinstance(names, str) else names:
        out = merge(out, load(here.parent / name, (*_above, here)))
    out = merge(out, own)
    local = here.with_suffix(".local" + here.suffix)
    return merge(out, yaml.safe_load(local.read_text(encoding="utf-8")) or {}) if local.exists() else out


def dimension(spark: SparkSession, rows: list[dict], schema: str, key: list[str]) -> DataFrame:
    """A dimension table from settings; a repeated key or an unknown field raises."""
    names = [c.split(":")[0].split()[0] for c in schema.split(",")]
    seen = set()
    for row in rows:
        unknown = set(row) - set(names)
        ident = tuple(row.get(k) for k in key)
        if unknown or ident in seen:
            raise SettingsError(f"unknown fields {sorted(unknown)}" if unknown else f"repeated key {ident}")
        seen.add(ident)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
