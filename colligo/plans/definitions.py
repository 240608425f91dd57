"""Reports that are defined in files: YAML or JSON, one definition or a list of them in each."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Files
from . import templates
from .reports import Parameter, Registry, Report

try:
    import yaml
except ImportError:
    yaml = None

#: Types of parameters, by the names that a definition may use.
KINDS = {"string": "string", "str": "string", "integer": "integer", "int": "integer", "float": "float", "number": "float", "date": "date", "datetime": "datetime", "boolean": "boolean", "bool": "boolean"}


@dataclass(frozen=True)
class Defined(Report):
    """A report whose plan is a template of a definition."""

    version: str = "1.0"
    tags: list[str] = field(default_factory=list)
    template: templates.Block = field(default_factory=templates.Block)


def read_documents(spark: SparkSession, folder: str) -> tuple[list[tuple[str, Any]], dict[str, str]]:
    """What the YAML and JSON files of a folder hold, ``(file, value)`` in order of their names, and why others could not be read."""
    files, found, errors = Files(spark), [], {}
    for name in files.names(folder):
        kind = name.rpartition(".")[2].lower()
        if kind not in ("yaml", "yml", "json"):
            continue
        try:
            text = files.read(f"{folder.rstrip('/')}/{name}")
            if kind != "json" and yaml is None:
                raise ValueError("YAML cannot be read here; JSON can")
            found.append((name, json.loads(text) if kind == "json" else yaml.safe_load(text)))
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {e}"
    return found, errors


def _parameter(data: dict[str, Any]) -> Parameter:
    kind = str(data.get("type", "string")).lower()
    if kind not in KINDS:
        raise ValueError(f"parameter {data.get('name')}: unknown type {kind}; known: {', '.join(KINDS)}")
    out = Parameter(str(data["name"]), KINDS[kind], data.get("default"), bool(data.get("required", False)))
    if out.default is not None:
        out.read(None)
    return out


def definition(data: dict[str, Any]) -> Report:
    """A report from a definition; raises ValueError or KeyError for what it lacks or does not declare.

    ``requires`` has the tables' names, or for each the columns that it needs.
    """
    if not isinstance(data, dict):
        raise ValueError("a definition has to be a mapping")
    if lacks := [k for k in ("name", "sql") if not data.get(k)]:
        raise ValueError(f"missing: {', '.join(lacks)}")
    requires = data.get("requires") or {}
    requires = {t: list(c or []) for t, c in requires.items()} if isinstance(requires, dict) else {t: [] for t in requires}
    parameters = [_parameter(p) for p in data.get("parameters") or []]
    template = templates.parse(str(data["sql"]))
    if undeclared := template.names() - {p.name for p in parameters}:
        raise ValueError(f"undeclared parameters: {', '.join(sorted(undeclared))}")

    def build(tables: dict[str, DataFrame], values: dict[str, Any]) -> DataFrame:
        text, bound = templates.render(template, values)
        for name in requires:
            tables[name].createOrReplaceTempView(name)
        spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
        return spark.sql(text, args=bound)

    return Defined(str(data["name"]), str(data.get("description", "")), requires, build, parameters, str(data.get("category", "general")), str(data.get("version", "1.0")), list(data.get("tags") or []), template)


def load(spark: SparkSession, folder: str, registry: Registry | None = None) -> tuple[Registry, dict[str, str]]:
    """Registers all definitions of a folder; returns the registry, and the error of each file or definition that failed.

    A later definition of a name replaces an earlier one.  A report reads the views of the tables that it
    requires, which are made from the tables that it is run over.
    """
    registry = Registry([]) if registry is None else registry
    documents, errors = read_documents(spark, folder)
    for name, data in documents:
        for i, item in enumerate(data if isinstance(data, list) else [data]):
            try:
                registry.register(definition(item))
            except Exception as e:
                errors[f"{name}#{i}" if isinstance(data, list) else name] = f"{type(e).__name__}: {e}"
    return registry, errors
