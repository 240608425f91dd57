"""Tables from files and frames, their catalog, and what is written out again."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, units
from ..operators.clustering import enrich
from .catalog import Catalog

#: Document types whose tables get shift patterns, if they have a start column (fixed values).
SHIFT_TYPES, START_COLUMNS = ["shift", "schedule", "roster", "attendance"], ["shift_start", "start_time", "scheduled_start"]
#: Where a row stands in its file.
ROW = "_row"


def read_csv(spark: SparkSession, path: str | DataFrame, rows: int | None = None, **options) -> DataFrame:
    """A CSV file with a header, every value as text, so that leading zeros stay; a frame is passed on.

    ``_row`` ascends in file order.
    """
    if isinstance(path, DataFrame):
        return path
    df = spark.read.csv(path, header=True, inferSchema=False, **options)
    df = df.limit(rows) if rows is not None else df
    return df.withColumn(ROW, F.monotonically_increasing_id())


def table_name(document_type: str) -> str:
    """Letters, digits and underscores of any script; never empty, never with a digit first."""
    name = re.sub(r"\W", "_", document_type.strip().lower()) or "table"
    return f"t_{name}" if name[0].isdigit() else name


def renamed(df: DataFrame, mappings: dict[str, str] | None) -> DataFrame:
    """Columns under their targets' names.  Mappings of columns that are not there, to nothing, or to a name taken already are left out."""
    taken, wanted = set(df.columns) - set(mappings or {}), {}
    for source, target in (mappings or {}).items():
        if source in df.columns and target and target not in taken:
            taken.add(target)
            wanted[source] = target
        elif source in df.columns:
            taken.add(source)
    return df.withColumnsRenamed(wanted)


def _iso(value: Column, source: str) -> Column:
    """A date as ``yyyy-MM-dd``; unchanged where it does not fit its format."""
    return F.coalesce(F.date_format(dates.read(value, source), "yyyy-MM-dd"), value.cast("string"))


def converted(df: DataFrame, conversions: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns in other units, or dates in another format: ``{column: (from, to)}``."""
    out: dict[str, Column] = {}
    for name, (source, target) in conversions.items():
        if name in df.columns:
            out[name] = _iso(F.col(name), source.upper()) if source.upper() in dates.FORMATS else units.yes(F.col(name)) if source == "yes_no" else units.convert(F.col(name).cast("string").try_cast("double"), source, target)
    return df.withColumns(out) if out else df


@dataclass
class Loaded:
    """A table of the catalog."""

    document_type: str
    name: str
    source: str
    columns: list[str]
    confidence: float = 1.0
    mappings: dict[str, str] = field(default_factory=dict)
    loaded_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


class Store:
    """Tables by document type, as views of this session; with a folder they outlive it.

    A store opened on a folder has the tables of its newest version, or of the one named.  Loads and
    drops make new versions; an append writes the new rows alone.  Others' versions are seen by ``refresh``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, version: int | None = None):
        self.spark, self.catalog, self.version = spark, Catalog(spark, folder) if folder else None, version
        self._frames: dict[str, DataFrame] = {}
        self._loaded: dict[str, Loaded] = {}
        self.refresh()

    def refresh(self) -> None:
        """Takes up what the folder has now; without one nothing changes."""
        if self.catalog is None:
            return
        entries = self.catalog.entries(self.version)
        for name in set(self._frames) - set(entries):
            self._forget(name)
        for name, entry in entries.items():
            self._show(name, self.catalog.frame(entry), Loaded(**entry["facts"] | {"name": name, "loaded_at": datetime.fromisoformat(entry["facts"]["loaded_at"])}))

    def _show(self, name: str, df: DataFrame, loaded: Loaded) -> Loaded:
        df.createOrReplaceTempView(name)
        self._frames[name], self._loaded[name] = df, loaded
        return loaded

    def _forget(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self._frames.pop(name, None)
        self._loaded.pop(name, None)

    def load(self, source: str | DataFrame, document_type: str, mappings: dict[str, str] | None = None, conversions: dict[str, tuple[str, str]] | None = None, replace: bool = True, confidence: float = 1.0) -> Loaded:
        """Reads, renames, converts and, for shifts, enriches a table; replaces the type's table or appends by column name."""
        if self.version is not None:
            raise ValueError("an older version is only read")
        name = table_name(document_type)
        df = converted(renamed(read_csv(self.spark, source), mappings), conversions or {})
        start = next((c for c in START_COLUMNS if c in df.columns), None)
        if start and any(word in document_type.lower() for word in SHIFT_TYPES):
            df = enrich(df, start)
        loaded = Loaded(document_type, name, source if isinstance(source, str) else "frame", df.columns, confidence, mappings or {})
        if self.catalog is None:
            if not replace and name in self._frames:
                df = self._frames[name].unionByName(df, allowMissingColumns=True)
                loaded.columns = df.columns
            return self._show(name, df, loaded)
        part = self.catalog.write(name, df)

        def how(old: dict) -> dict:
            before = [] if replace or name not in old else old[name]["parts"]
            columns = [] if not before else old[name]["facts"]["columns"]
            facts = asdict(loaded) | {"columns": columns + [c for c in df.columns if c not in columns], "loaded_at": loaded.loaded_at.isoformat()}
            return old | {name: {"parts": [*before, part], "facts": facts}}

        self.catalog.change(how)
        self.refresh()
        return self._loaded[name]

    def tables(self) -> dict[str, DataFrame]:
        return dict(self._frames)

    def status(self) -> list[Loaded]:
        return [self._loaded[n] for n in sorted(self._loaded)]

    def has(self, document_type: str) -> bool:
        return table_name(document_type) in self._frames

    def sample(self, document_type: str, rows: int = 5) -> DataFrame:
        return self._frames[table_name(document_type)].limit(rows)

    def describe(self, document_type: str) -> list[tuple[str, str]]:
        return self._frames[table_name(document_type)].dtypes

    def sql(self, text: str, **arguments) -> DataFrame:
        """A query over the views; ``arguments`` are bound to its ``:name`` markers."""
        return self.spark.sql(text, args=arguments)

    def drop(self, document_type: str) -> bool:
        """Forgets a table; older versions of the folder keep it."""
        name = table_name(document_type)
        there = name in self._frames
        if there and self.catalog is not None:
            self.catalog.change(lambda old: {k: v for k, v in old.items() if k != name})
        self._forget(name)
        return there

    def clear(self) -> None:
        for loaded in self.status():
            self.drop(loaded.document_type)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
