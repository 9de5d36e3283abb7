"""Configuration on the driver: layered TOML, rosters, document maps."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

GROUPS = ("companies", "people", "places", "other")


def read_toml(path: str | Path) -> dict[str, Any]:
    """A TOML file's tables; a missing file is empty."""
    path = Path(path)
    return tomllib.loads(path.read_text("utf-8")) if path.exists() else {}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Tables are merged key by key; anything else, lists too, is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def load_config(path: str | Path, defaults: Mapping[str, Any] = {}, version: int = 1) -> dict[str, Any]:
    """Defaults overlaid by a file, whose ``[paths]`` are relative to its folder."""
    own = read_toml(path)
    if own.get("schema_version", version) != version:
        raise ValueError(f"configuration version {own['schema_version']}, not {version}")
    config = merged(defaults, own)
    folder = Path(path).parent
    if "paths" in config:
        config["paths"] = {k: str(v if Path(v).is_absolute() else folder / v) for k, v in config["paths"].items()}
    return config


def load_roster(spark: SparkSession, path: str | Path) -> DataFrame:
    """(entity, grp) of a roster file; a missing file has none."""
    groups = read_toml(path)
    return spark.createDataFrame([(e, g) for g in GROUPS for e in groups.get(g, [])], "entity string, grp string")


def save_roster(path: str | Path, groups: Mapping[str, list[str]]) -> None:
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    Path(path).write_text("".join(f"{g} = [{', '.join(map(quote, groups.get(g, [])))}]\n" for g in GROUPS), "utf-8")


def load_document_map(spark: SparkSession, path: str | Path) -> DataFrame:
    """(format, src, out) of a document map; files copied as they are have the format copy."""
    maps = read_toml(path)
    rows = [(kind, src, out) for kind in ("pdf", "office") for src, out in maps.get(kind, {}).items()]
    rows += [("copy", name, name) for names in maps.get("copy_as_is", {}).values() for name in names]
    return spark.createDataFrame(rows, "format string, src string, out string")
