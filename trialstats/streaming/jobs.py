"""Structured Streaming over the run log: ingest, live counts, stalls and spend."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trialstats.operators.cells import CELL, G
from trialstats.schema import CORRUPT, RUNS
from trialstats.session import cut
from trialstats.sources.committed import append_runs
from trialstats.sources.tail import tail

LATE = "1 hour"


def _parsed(spark: SparkSession, path: str, **options) -> DataFrame:
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    row = F.from_json("value", f"{RUNS}, {CORRUPT} string", how)
    return tail(spark, path, **options).select("value", "file", "start", "utf8", row.alias("_r")).where(F.trim("value") != "")


def _good() -> Column:
    return F.col("utf8") & F.col(f"_r.{CORRUPT}").isNull() & F.col("_r.run_id").isNotNull()


def log_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parsed rows of a log that grows: files are read on where they ended, a last line waits for its newline. Lines that
    do not parse come out of ``damaged_lines``."""
    return _parsed(spark, path, **options).where(_good()).select("_r.*").drop(CORRUPT)


def damaged_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Complete lines of a growing log that are no run rows, with file and place: the other part of ``log_stream``."""
    return _parsed(spark, path, **options).where(~_good()).select("file", "start", "value")


def once_per_id(rows: DataFrame, time: str | None = None, late: str = LATE) -> DataFrame:
    """Each run id once. With an ingest-time column the state is bounded by the watermark; without one it holds every id,
    on disk."""
    keep_state_on_disk(rows.sparkSession)
    if time is None:
        return rows.dropDuplicates(["run_id"])
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["run_id"])


def keep_damaged(spark: SparkSession, path: str, table: str, checkpoint: str, **options):
    """Append the lines that ``ingest`` leaves out to a table of their own, so that none is lost uncounted."""
    return (
        damaged_lines(spark, path, **options).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
    )


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, continuous: bool = False, **options):
    """Exactly-once append of a growing log into a table of committed batches; run ``keep_damaged`` beside it.

    The stream keeps no ids: each batch is appended under its number, ids that the table holds are left out there, so a
    replayed batch adds nothing and state does not grow with the log. Of equal ids the first batch's row wins, in a
    batch the one that comes first in its file.
    """
    rows = _parsed(spark, path, **options).where(_good())

    def save(batch: DataFrame, number: int) -> None:
        order = [F.col("_file"), F.col("_start")]
        named = batch.select("_r.*", F.col("file").alias("_file"), F.col("start").alias("_start")).drop(CORRUPT)
        append_runs(named, table, f"stream-{number:010d}", order)

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def live_cells(rows: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Counts per cell so far. Counts only: decisions wait for the whole plan."""
    return rows.groupBy(*g, *CELL).agg(
        F.count("success").alias("n"), F.count_if("success").alias("k"),
        F.count_if(F.col("success").isNull()).alias("aborted"))


def write_latest(stream: DataFrame, table: str, checkpoint: str):
    """Keep the complete current aggregate of a stream in a table, a folder per batch: a repeated batch replaces its
    own folder, and readers of ``latest`` never see a gap."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        stream.writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, table: str) -> DataFrame:
    """Rows of the last batch that ``write_latest`` finished."""
    rows = spark.read.parquet(table)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def activity_sessions(rows: DataFrame, key: Sequence[str], ts: str, gap: str = "20 minutes",
                      late: str = LATE) -> DataFrame:
    """Spans without a stall; the end of one span and the start of the next enclose a stall."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(*key, F.session_window(ts, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("runs")
    ).select(*key, F.col("_w.start").alias("first"), F.col("_w.end").alias("closes"), "runs")


def open_sessions(rows: DataFrame, closed: DataFrame, key: Sequence[str], ts: str, gap: str = "20 minutes") -> DataFrame:
    """Spans of the rows so far that the stream of ``activity_sessions`` has not written to ``closed``: the ones that
    its watermark has not passed."""
    # Spark pushes an anti join on the windows below their merging, so the spans are written first
    spans, same = cut(activity_sessions(rows, key, ts, gap)), [*key, "first", "closes"]
    done = closed.select(*(F.col(c).alias(f"_{c}") for c in same))
    return spans.join(done, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], "left_anti")


def spend_alerts(priced: DataFrame, cap_usd: float, table: str, checkpoint: str,
                 stop_at: float = 0.95):
    """A row whenever a model's running spend stands above the stop line after a batch, in a folder per batch: a
    repeated batch replaces its own."""
    totals = priced.groupBy("model_id").agg(F.sum("cost_usd").alias("spend_usd"))

    def alert(batch: DataFrame, number: int) -> None:
        batch.where(F.col("spend_usd") > stop_at * cap_usd).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        totals.writeStream.outputMode("update").foreachBatch(alert)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of the streams started from here on lies in RocksDB, not in the heap of the executors."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


#: rows of a model that are held before those beyond the stop line are let go
HELD = 50_000


class SpendLedger(StatefulProcessor):
    """Spend and runs of a model so far, and whether a run was refused: one short row of state per model.

    A run is refused if what was spent and the mean cost so far come above the stop line; the first refusal is given out once.
    Rows of a trigger are taken in the order of their names, later triggers come after earlier ones. Of a trigger's rows
    only those are held that the line can afford: a row with more than the line spent before it comes after the refusal,
    whatever else arrives.
    """

    def __init__(self, line: float):
        self.line = line

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ledger = handle.getValueState("ledger", "spent decimal(38,12), runs bigint, refused boolean")

    def handleInputRows(self, key, rows, timerValues):
        spent, runs, refused = self.ledger.get() if self.ledger.exists() else (Decimal(0), 0, False)
        if refused:
            return
        batch, most, gone = None, HELD, False
        for r in rows:
            if gone and any(c is not None and c < 0 for c in r["cost_usd"]):
                raise ValueError("a negative cost arrived after rows beyond the stop line were let go")
            batch = pd.concat([batch, r[["run_id", "cost_usd"]]]) if batch is not None else r[["run_id", "cost_usd"]]
            if len(batch) > most:
                kept = self.affordable(batch, spent)
                gone, batch = gone or len(kept) < len(batch), kept
                most = 2 * len(batch) + HELD
        batch = batch.sort_values("run_id", kind="stable")
        for run_id, cost in zip(batch["run_id"], batch["cost_usd"], strict=True):
            if float(spent) + (float(spent) / runs if runs else 0.0) > self.line:
                refused = True
                yield pd.DataFrame({"model_id": [key[0]], "stopped_at": [run_id], "started": [runs], "spent_usd": [float(spent)]})
                break
            # an unpriced run costs nothing and is a run all the same
            spent, runs = spent + (Decimal(0) if cost is None else cost), runs + 1
        self.ledger.update((spent, runs, refused))

    def affordable(self, batch: pd.DataFrame, spent: Decimal) -> pd.DataFrame:
        """Rows in order up to the first with more than the line spent before it; all of them if a cost is negative."""
        batch = batch.sort_values("run_id", kind="stable")
        costs = [Decimal(0) if c is None else c for c in batch["cost_usd"]]
        if min(costs) < 0:
            return batch
        for n, cost in enumerate(costs, 1):
            if float(spent) > self.line:
                return batch.iloc[:n].copy()
            spent += cost
        return batch

    def close(self) -> None:
        pass


def spend_stops(priced: DataFrame, cap_usd: float, table: str, checkpoint: str, stop_at: float = 0.95):
    """The first run of each model that the stop rule refuses, in a folder per batch: a repeated batch replaces its own."""
    keep_state_on_disk(priced.sparkSession)
    rows = priced.select("model_id", "run_id", F.col("cost_usd").cast("decimal(38,12)").alias("cost_usd"))
    stops = rows.groupBy("model_id").transformWithStateInPandas(
        SpendLedger(stop_at * cap_usd), "model_id string, stopped_at string, started bigint, spent_usd double", "Append", "None")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stops.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
