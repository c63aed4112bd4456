"""Readers, splits and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.plans.scale import TASK_ROWS
from trialstats.session import checkpoint_dir, cut

#: columns of the documents table, in order
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: arrays of start and end; ends are exclusive
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def small(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` to be broadcast if it has at most ``rows`` rows, as it is beyond."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[str]:
    """A database in the shared checkpoint folder for written tables; it goes with them at the end."""
    name = f"work_{uuid.uuid4().hex}"
    spark.sql(f"create database {name} location '{checkpoint_dir(spark)}/{name}'")
    try:
        yield name
    finally:
        spark.sql(f"drop database {name} cascade")


def spread_join(facts: DataFrame, lookup: DataFrame, keys: list[str], rows: str, by: list[str], limit: int = TASK_ROWS) -> DataFrame:
    """Inner join of ``facts`` with a written table, unique on ``keys``, whose column ``rows`` counts the facts of a key.

    Facts of a key with more than ``limit`` rows are dealt over several tasks by the hash of ``by``; there are fewer
    such keys than rows / ``limit``, so their list is broadcast.
    """
    hot = cut(lookup.where(F.col(rows) > limit).select(*keys, F.ceil(F.col(rows) / limit).cast("bigint").alias("_salts")))
    if hot.isEmpty():
        return facts.join(lookup, keys)
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")), F.lit(0).cast("bigint"))
    dealt = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    last = F.greatest(F.lit(0), F.ceil(F.col(rows) / limit) - 1).cast("bigint")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")
