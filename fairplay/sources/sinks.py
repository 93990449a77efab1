"""Sinks: S4 keyed upsert, S5 CSV, S6 JSON, S7 model persistence.

S4 rewrites only the (league, season) partitions an update batch touches:
read those partitions (their values are a partition predicate of the scan),
merge with a full outer join on the unique key, and write them back with
dynamic partition overwrite. Untouched partitions are never read or rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairplay.session import cut_lineage

UPSERT_KEYS = ["league", "season", "player_name", "team"]
UPDATE_COLUMNS = ["position", "appearances", "fouls", "fouls_drawn", "yellow_cards", "red_cards",
                  "minutes", "source", "scraped_at"]


def merge_rows(target: DataFrame, updates: DataFrame, keys: Sequence[str] = UPSERT_KEYS,
               update_cols: Sequence[str] | None = None,
               keep_cols: Sequence[str] = ()) -> DataFrame:
    """Insert-or-update on ``keys`` (the logical MERGE); a null key equals a null key.

    A matched row takes every ``update_cols`` value from the update, nulls
    included (as ``EXCLUDED.col`` does); ``keep_cols`` keep the stored value
    on a match (the CLI writer keeps ``scraped_at``).
    """
    cols = [c for c in target.columns if c not in keys]
    update_cols = [c for c in (update_cols or cols) if c in updates.columns]
    t = target.select(*[F.col(k).alias(f"__tk_{k}") for k in keys], *[F.col(c).alias(f"__t_{c}") for c in cols], F.lit(True).alias("__t"))
    u = updates.select(*[F.col(k).alias(f"__uk_{k}") for k in keys], *[F.col(c).alias(f"__u_{c}") for c in update_cols],
                       F.lit(True).alias("__u"))
    j = t.join(u, reduce(and_, [F.col(f"__tk_{k}").eqNullSafe(F.col(f"__uk_{k}")) for k in keys]), "full_outer")
    found = [F.coalesce(f"__tk_{k}", f"__uk_{k}").alias(k) for k in keys]
    out = []
    for c in cols:
        told = F.col(f"__t_{c}")
        if c in update_cols and c not in keep_cols:
            v = F.when(F.col("__u").isNotNull(), F.col(f"__u_{c}")).otherwise(told)
        elif c in update_cols:
            v = F.when(F.col("__t").isNotNull(), told).otherwise(F.col(f"__u_{c}"))
        else:
            v = told
        out.append(v.alias(c))
    return j.select(*found, *out).select(*target.columns)


def one_per_key(updates: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None,
                last: bool = True) -> DataFrame:
    """One update per key: the last (or first) in ``order_by``; without it the greatest by all
    columns, so that reruns agree."""
    others = [c for c in updates.columns if c not in keys]
    if not others:
        return updates.distinct()
    order = F.struct(*[F.col(c) for c in [*(order_by or []), *others]])
    pick = F.max_by if last else F.min_by
    best = updates.groupBy(*keys).agg(pick(F.struct(*others), order).alias("__r"))
    return best.select(*keys, "__r.*").select(*updates.columns)


def stored_table(spark: SparkSession, path: str, partition_types: dict[str, T.DataType]) -> DataFrame | None:
    """The table at ``path`` with its own columns; None only where there is no such path.

    Partition columns get the given types ("2020" stays text). Any other failure to read is
    raised: taking it for a first load would replace what is stored.
    """
    try:
        schema = spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    fields = [T.StructField(f.name, partition_types.get(f.name, f.dataType), True) for f in schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _touches(rows: list, columns: list[str]) -> Column:
    """The rows' partitions: one term per value of all columns but the last, whose values are listed."""
    *outer, last = columns
    values: dict[tuple, list] = {}
    for r in rows:
        values.setdefault(tuple(r[c] for c in outer), []).append(r[last])

    def term(named: tuple, listed: list) -> Column:
        known = [v for v in listed if v is not None]
        inner = F.col(last).isin(known) if known else F.lit(False)
        if len(known) < len(listed):
            inner = inner | F.col(last).isNull()
        return reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(outer, named, strict=True)], inner)

    return reduce(or_, [term(named, listed) for named, listed in values.items()])


def upsert_to_path(spark: SparkSession, path: str, updates: DataFrame,
                   keys: Sequence[str] = UPSERT_KEYS,
                   partition_cols: Sequence[str] = ("league", "season"),
                   update_cols: Sequence[str] | None = None,
                   keep_cols: Sequence[str] = (), order_by: Sequence[str] | None = None,
                   last: bool = True) -> int:
    """Upsert ``updates`` into the parquet table at ``path``; returns rows written.

    An empty batch is a no-op returning 0. Stored columns that the batch lacks keep
    their values (null in new rows); columns that only the batch has are added. Of
    several updates of a key the last by ``order_by`` counts (``last=False``: the
    first). The values of the touched partitions become a partition predicate, so only
    these are read. The rewrite is per partition, each replaced as a whole when the job
    commits: a batch that fails before leaves the stored table as it was.
    """
    batch = one_per_key(updates, keys, order_by, last)
    touched = batch.select(*partition_cols).distinct().collect()  # partitions of one batch
    if not touched:
        return 0
    types = {c: updates.schema[c].dataType for c in partition_cols}
    current = stored_table(spark, path, types)
    if current is None:
        merged = batch
    else:
        for c in updates.columns:
            if c not in current.columns:
                current = current.withColumn(c, F.lit(None).cast(updates.schema[c].dataType))
        scope = current.where(_touches(touched, list(partition_cols)))
        # Materialise the merged partitions before overwriting the files they
        # were read from (lineage must not point at the files being replaced).
        merged = cut_lineage(merge_rows(scope, batch, keys, update_cols, keep_cols))
    n = merged.count()
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))
    return n


#: Spark's default text forms of times stop at milliseconds.
TIME_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header (one folder of part files); quotes inside values are doubled
    and times keep their microseconds."""
    df.write.mode("overwrite").options(header=True, escape='"', **TIME_FORMATS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What ``export_csv`` wrote, line breaks inside values included."""
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True, **TIME_FORMATS).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines; nested struct/map/array columns are kept nested, times keep their
    microseconds."""
    df.write.mode("overwrite").options(**TIME_FORMATS).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What ``export_json`` wrote."""
    return spark.read.schema(schema).options(**TIME_FORMATS).json(path)


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model or pipeline."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def save_table(df: DataFrame, path: str) -> None:
    """Side state (label dictionaries, feature lists, scaler state) as parquet."""
    df.write.mode("overwrite").parquet(path)
