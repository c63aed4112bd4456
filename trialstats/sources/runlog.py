"""Append-only run logs: JSON lines, one graded run each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.functions.jsonsafe import json_rows
from trialstats.schema import CORRUPT, RUNS, project_runs
from trialstats.sources.committed import append_runs  # noqa: F401


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their file and place in it. Splitting on the bare newline keeps byte counts exact."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("_size"),
        F.struct(F.col("_metadata.file_block_start").alias("start"),
                 F.monotonically_increasing_id().alias("id")).alias("_place"),
    )


def _parsed(lines: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    row = F.from_json("value", f"{RUNS}, {CORRUPT} string", options)
    return lines.where(F.trim("value") != "").withColumn("_r", row)


def log_integrity(spark: SparkSession, path) -> DataFrame:
    """Per file: rows, torn final lines and damaged lines.

    Line lengths plus one newline each exceed the file size by one exactly when the last line has no
    newline; only that line may fail to parse.
    """
    lines = _lines(spark, path)
    bad = F.from_json("value", f"{RUNS}, {CORRUPT} string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})[CORRUPT].isNotNull()
    bad = bad & (F.trim("value") != "")
    t = lines.withColumn("_bad", bad).groupBy("file").agg(
        F.count_if(F.trim("value") != "").alias("lines"),
        F.count_if("_bad").alias("_n_bad"),
        F.max("_place").alias("_last"), F.max(F.when(F.col("_bad"), F.col("_place"))).alias("_last_bad"),
        (F.sum(F.octet_length("value") + 1) > F.max("_size")).alias("open_end"),
    )
    torn = F.col("open_end") & F.coalesce(F.col("_last") == F.col("_last_bad"), F.lit(False))
    return t.select("file", "lines", torn.cast("int").alias("torn"),
                    (F.col("_n_bad") - torn.cast("int")).alias("damaged"), "open_end", F.col("_last").alias("last"))


def read_runs(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """Run rows of a log. A torn final line is skipped; any other bad line stops a strict read."""
    if strict:
        broken = log_integrity(spark, path).where("damaged > 0").select("file").limit(1).collect()
        if broken:
            raise ValueError(f"{broken[0].file}: a line is not valid JSON")
    good = _parsed(_lines(spark, path)).where(F.col(f"_r.{CORRUPT}").isNull())
    return good.select("_r.*").drop(CORRUPT)


def known_ids(spark: SparkSession, path) -> DataFrame:
    """Ids of the complete rows, for resuming a plan. A last line without its newline is not complete, whether it
    parses or not; any other bad line stops the read."""
    checked = log_integrity(spark, path)
    broken = checked.where("damaged > 0").select("file").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0].file}: a line is not valid JSON")
    rows = _parsed(_lines(spark, path)).where(F.col(f"_r.{CORRUPT}").isNull())
    ends = checked.where("open_end").select("file", F.col("last").alias("_place"))
    complete = rows.join(ends, ["file", "_place"], "left_anti")
    return complete.select("_r.run_id").where("run_id is not null").distinct()


def write_log(runs: DataFrame, path: str) -> None:
    """Rows as strict JSON lines in schema order."""
    json_rows(project_runs(runs)).write.mode("append").text(path)
