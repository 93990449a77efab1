"""Registry of named jobs: the Spark builder and, where one exists, its SQL twin.

Every entry reads the stored tables under ``sf_dir`` (or data Spark derives
from them) and runs over the whole tables. ``finish`` rounds DOUBLE columns
to 6 decimals with the engine-neutral rounding so the DuckDB twin (wrapped by
``oracle.normalized``) hashes to the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fairplay.functions.numeric import fixed
from fairplay.plans.oracle import normalized

Builder = Callable[[SparkSession, str], DataFrame]


DOUBLES_FILE = Path(__file__).with_name("double_columns.json")


def _schema_doubles() -> dict[str, list[str]]:
    if DOUBLES_FILE.exists():
        return json.loads(DOUBLES_FILE.read_text())
    return {}


@dataclass
class Entry:
    name: str
    build: Builder
    raw_sql: str | None
    doubles: tuple[str, ...] = ()

    @property
    def sql(self) -> str | None:
        if self.raw_sql is None:
            return None
        cols = list(dict.fromkeys([*self.doubles, *_schema_doubles().get(self.name, [])]))
        return normalized(self.raw_sql, cols)


CATALOG: dict[str, Entry] = {}


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(fixed(f.name, 6).alias(f.name))
        else:
            cols.append(df[f.name])
    return df.select(*cols)


def job(name: str, sql: str | None = None, doubles: Iterable[str] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        CATALOG[name] = Entry(name, run, sql, tuple(doubles))
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    """Import every module that registers jobs."""
    from fairplay.plans import (  # noqa: F401
        jobs_features,
        jobs_ingest,
        jobs_models,
        jobs_queries,
        jobs_rules,
        jobs_runs,
        jobs_text,
        jobs_tuning,
    )
    return CATALOG


def write_double_columns(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Record the DOUBLE output columns of every job with SQL (schema analysis only)."""
    out = {}
    for name, e in sorted(load_all().items()):
        if e.raw_sql is None:
            continue
        schema = e.build(spark, sf_dir).schema
        out[name] = [f.name for f in schema.fields
                     if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    DOUBLES_FILE.write_text(json.dumps(out, indent=1, sort_keys=True) + "\n")
    return out
