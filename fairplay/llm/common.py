"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairplay.session import ensure_checkpoint_dir

#: A word is a run of anything but the six ASCII white-space characters; the
#: same class as ``bytes.split()`` in Python.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def n_words(col: str):
    """Words of a text as long; null text has none."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def utf8_size(col: str):
    """UTF-8 bytes of a text as long; null text has none."""
    return F.octet_length(text_or_empty(col)).cast("long")


def carried(kind: str) -> str:
    """Type in which a key of type ``kind`` goes through pandas: there, a null makes the longs
    of its batch doubles, which lose digits above 2^53; as text they stay exact."""
    return "string" if kind == "bigint" else kind


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the session's shared folder, and read from there.

    Cuts the lineage like a reliable checkpoint, in a smaller form.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
