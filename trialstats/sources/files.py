"""Other inputs and outputs: gold records, documents, transcripts, prices, sessions, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.functions.jsonsafe import json_rows, significant
from trialstats.functions.text import unix_lines
from trialstats.operators.grade import GOLD_TYPE
from trialstats.operators.transcripts import MESSAGE, redact

PRICE = "struct<input:double,output:double,cache_read:double,cache_write:double>"


def read_gold(spark: SparkSession, path) -> DataFrame:
    """(doc_id, gold) from JSON lines that hold the gold fields next to the document id."""
    fields = GOLD_TYPE.removeprefix("struct<").removesuffix(">")
    rows = spark.read.schema(f"doc_id string, {fields}").option("mode", "FAILFAST").json(path)
    return rows.select("doc_id", F.struct(*[c for c in rows.columns if c != "doc_id"]).alias("gold"))


def read_documents(spark: SparkSession, path) -> DataFrame:
    """(doc_id, text): one file per document, Unix line ends, the id is the file stem."""
    rows = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    out = rows.select(stem.alias("doc_id"), unix_lines(F.col("value")).alias("text"))
    if out.isEmpty():
        raise ValueError(f"{path}: no documents")
    return out


def read_transcripts(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """(run_id, messages): one JSON file per run, or with ``lines`` the shards of ``write_transcripts``."""
    return spark.read.schema(f"run_id string, messages array<{MESSAGE}>").option(
        "multiLine", not lines).json(path)


def explode_messages(transcripts: DataFrame) -> DataFrame:
    """One row per message with its position."""
    return transcripts.select("run_id", F.posexplode("messages").alias("pos", "m")).select(
        "run_id", "pos", "m.*")


def write_transcripts(transcripts: DataFrame, path: str, hide: bool = False) -> None:
    """Transcripts in shards by the first two digits of the run id, optionally redacted."""
    rows = redact(transcripts) if hide else transcripts
    rows.withColumn("shard", F.substring("run_id", 1, 2)).write.mode("append").partitionBy(
        "shard").json(path)


def read_prices(spark: SparkSession, path) -> DataFrame:
    """(model_id, input, output, cache_read, cache_write) in USD per token; another unit stops."""
    raw = spark.read.schema(f"unit string, models map<string,{PRICE}>").option("multiLine", True).json(path)
    stop = F.raise_error(F.lit("prices must be in usd_per_token")).cast(f"map<string,{PRICE}>")
    models = F.when(F.col("unit") == "usd_per_token", F.col("models")).otherwise(stop)
    return raw.select(F.explode(models).alias("model_id", "p")).select("model_id", "p.*")


def read_sessions(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema("event string, started string, planned double, completed double").json(path)


def file_hashes(spark: SparkSession, path, text: bool = False) -> DataFrame:
    """(path, sha256) of files; text files are hashed with Unix line ends."""
    files = spark.read.format("binaryFile").load(path)
    content = F.decode("content", "UTF-8") if text else F.col("content")
    return files.select("path", F.sha2(unix_lines(content) if text else content, 256).alias("sha256"))


def write_cells_csv(cells: DataFrame, path: str) -> None:
    """Cell table sorted by fault rate and tools, doubles with ten significant digits."""
    doubles = [c for c, t in cells.dtypes if t == "double"]
    cells.orderBy("fault_pct", "tools").withColumns(
        {c: significant(F.col(c)) for c in doubles}).write.mode("overwrite").option("header", True).csv(path)


def write_results(table: DataFrame, path: str) -> None:
    json_rows(table).write.mode("overwrite").text(path)


def write_resamples(index: DataFrame, path: str) -> None:
    """Drawn positions, so that any interval can be recomputed elsewhere."""
    index.write.mode("overwrite").partitionBy("statistic").parquet(path)


def write_manifest(hashes: DataFrame, path: str) -> None:
    hashes.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value")).write.mode(
        "overwrite").text(path)


def read_manifest(spark: SparkSession, path) -> DataFrame:
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).select(parts[1].alias("path"), parts[0].alias("sha256"))


def write_tables(tables: dict[str, DataFrame], path: str, names: Sequence[str] | None = None) -> None:
    """Result tables as Parquet, one folder each."""
    for name in names or tables:
        tables[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
