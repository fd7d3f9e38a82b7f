"""Configuration documents: endpoint lists, placeholders, sources, titles."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.numbering import numbered


def enabled(apis: Column) -> Column:
    return F.filter(apis, lambda a: a["enabled"])


def current_api(apis: Column, current: Column) -> Column:
    """The endpoint of the current id (the first if there is none), else the first; whether enabled doesn't matter."""
    named = F.filter(apis, lambda a: (a["id"] == current) | (current == "") | current.isNull())
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(apis, F.lit(1)))


def last_match(apis: Column, api_id: Column) -> Column:
    """The last endpoint of an id."""
    return F.try_element_at(F.filter(apis, lambda a: a["id"] == api_id), F.lit(-1))


def last_of(api: Column, place: Column, matches: Column) -> Column:
    """As ``last_match``, of endpoints that are rows of a group: an aggregate that keeps one of them."""
    return F.max_by(F.when(matches, api), F.when(matches, place))


def current_of(api: Column, place: Column, is_current: Column) -> Column:
    """As ``current_api``, of endpoints that are rows of a group: the first that is current, else the first."""
    return F.min_by(api, F.struct(F.coalesce(~is_current, F.lit(True)).alias("other"), place.alias("place")))


def ranked_options(apis: DataFrame, by_price: bool = True, grouped: bool = True) -> DataFrame:
    """Endpoints in display order: providers (first word of the name) as first seen, inside by price, then place."""
    rows = apis.withColumn("provider", F.substring_index("name", " ", 1))
    seen = rows.groupBy("provider").agg(F.min("pos").alias("first_seen"))
    keys = (["first_seen"] if grouped else []) + (["price"] if by_price else []) + ["pos"]
    placed = numbered(rows.join(seen, "provider").select("pos", "id", "name", "provider", "price", "first_seen"), *keys)
    return placed.select((F.col("row") + 1).alias("place"), "id", "name", "provider", "price")


def persistent(values: Column, key: Column | str, default: str | None = None) -> Column:
    """The value kept under a key of a map, else ``default``; a null map holds nothing."""
    return F.coalesce(F.try_element_at(values, F.lit(key) if isinstance(key, str) else key), F.lit(default))


def placeholders(document: Column) -> Column:
    """All different string values that begin with _PL_, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(document, F.lit(r'"(_PL_[^"]*)"'), F.lit(1))))


def fill_placeholders(value: Any, values: Mapping[str, str]) -> Any:
    """A JSON value with each string that is a placeholder replaced, at any depth."""
    if isinstance(value, str):
        return values.get(value, value)
    if isinstance(value, list):
        return [fill_placeholders(v, values) for v in value]
    if isinstance(value, dict):
        return {k: fill_placeholders(v, values) for k, v in value.items()}
    return value


def expand_variable(value: str, environment: Mapping[str, str] | None = None) -> str:
    """The variable's value for a whole ``${NAME}``; anything else, and unset names, as they are."""
    m = re.fullmatch(r"\$\{([^}]*)\}", value)
    return (os.environ if environment is None else environment).get(m[1], value) if m else value


def source_specs(document: Mapping[str, Any], environment: Mapping[str, str] | None = None) -> list[dict[str, Any]]:
    """Sources of a configuration: folders get the default extensions, all get the common exclusions, headers their variables."""
    section = document.get("source", {})
    out = []
    for p in section.get("paths", []):
        p = {"type": "directory", "path": p} if isinstance(p, str) else dict(p)
        kind = p.get("type", "directory")
        extensions = list(p.get("extensions", []))
        if kind == "directory" and not extensions:
            extensions = list(section.get("default_extensions", []))
        out.append({
            "type": kind, "path": p.get("path", ""), "recursive": bool(p.get("recursive", True)), "extensions": extensions,
            "exclude": [*p.get("exclude", []), *section.get("global_exclude", [])], "url": p.get("url", ""),
            "headers": {k: expand_variable(v, environment) for k, v in p.get("headers", {}).items()}, "url_timeout_ms": int(p.get("url_timeout_ms", 10_000)),
        })
    return out


def api_settings(api: Mapping[str, Any]) -> dict[str, Any]:
    """An endpoint with defaults; camel-case names are taken too."""
    pick = lambda *names, default="": next((api[n] for n in names if n in api), default)
    price = api.get("pricing_tpm", {})
    return {
        "id": pick("id"), "name": pick("name"), "url": pick("api_url", "apiUrl"), "key": expand_variable(pick("api_key", "apiKey")), "model": pick("model"),
        "enabled": bool(pick("enabled", default=True)), "context_length": int(pick("context_length", default=8192)),
        "pricing": {"input": float(price.get("input", 0)), "output": float(price.get("output", 0)), "cached_input": float(price.get("cached_input", 0))},
    }


def project_title(stems: Column) -> Column:
    """File stems joined by slashes until longer than 12 characters."""
    joined = F.aggregate(
        stems, F.lit(""), lambda a, s: F.when(F.octet_length(a) > 12, a).when(a == "", s).otherwise(F.concat(a, F.lit("/"), s))
    )
    return F.when(joined == "", "Unnamed Project").otherwise(joined)


def load(path: str) -> dict[str, Any]:
    """A configuration file; a missing one is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def save(document: Mapping[str, Any], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2)
