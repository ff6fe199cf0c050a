"""Following epoch logs and campaign snapshots as file streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emulake.operators.campaign import STATUSES
from emulake.sources.readers import EPOCH_SCHEMA, SNAPSHOT_SCHEMA


def append_epochs(spark: SparkSession, history: Sequence[dict], folder: str, trial: int | None = None) -> None:
    """Append epoch records as JSON lines, tagged with their trial."""
    names = [c.split()[0] for c in EPOCH_SCHEMA.split(", ")]
    rows = [tuple({"hpo_trial": trial, **h}.get(n) for n in names) for h in history]
    if rows:
        spark.createDataFrame(rows, EPOCH_SCHEMA).coalesce(1).write.mode("append").json(folder)


def follow_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of epoch records as their files appear."""
    return spark.readStream.schema(EPOCH_SCHEMA).json(folder)


def latest_epoch(epochs: DataFrame) -> DataFrame:
    """Per trial: the newest epoch, its losses, and the best validation loss so far. Batch or stream (update)."""
    last = F.max_by(F.struct("train_loss", "val_loss"), "epoch")
    return epochs.groupBy("hpo_trial").agg(F.max("epoch").alias("epoch"), last.alias("s"), F.min("val_loss").alias("best_val_loss")).select(
        "hpo_trial", "epoch", "s.train_loss", "s.val_loss", "best_val_loss")


def follow_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of campaign snapshot lines, each with the snapshot it belongs to: its file in ``folder``, or the folder of its part files."""
    lines = spark.readStream.schema(SNAPSHOT_SCHEMA).option("recursiveFileLookup", True).json(folder)
    return lines.select("*", F.substring_index(F.regexp_replace(F.col("_metadata.file_path"), "/part-[^/]*$", ""), "/", -1).alias("snapshot"))


def snapshot_counts(lines: DataFrame) -> DataFrame:
    """One row of state counts per snapshot. Batch or stream."""
    return lines.where("case_id IS NOT NULL").groupBy("snapshot").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def count_line(counts: DataFrame) -> DataFrame:
    parts = [F.concat(F.lit(f"{s}="), F.col(s).cast("string")) for s in STATUSES]
    return counts.select("snapshot", F.concat_ws(" ", *parts).alias("line"))


CHANGES = "case_id bigint, snapshot string, status string, was string, held boolean, last boolean"


def status_changes(batch: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Every line of a snapshot with the status of the case's snapshot before in ``was``, NULL in its first (schema CHANGES).

    ``held`` has each case's last row so far. Such a row comes back, with ``held`` true, where it is still the last; ``last`` marks what the
    next batch needs. Snapshots of one batch are taken in order of their names; a line of a snapshot that is not later than the one held
    is left out. All cases go through one shuffle and one sort, by case.
    """
    lines = batch.where("case_id IS NOT NULL AND status IS NOT NULL AND snapshot IS NOT NULL").select("case_id", "snapshot", "status", F.lit(False).alias("held"))
    rows = lines if held is None else held.select("case_id", "snapshot", "status", F.lit(True).alias("held")).unionByName(lines)
    ordered = Window.partitionBy("case_id").orderBy("snapshot", F.desc("held"), "status")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = F.lag("snapshot").over(ordered).eqNullSafe(F.col("snapshot"))
    seen = F.max(F.when(F.col("held"), F.col("snapshot"))).over(whole)
    kept = rows.withColumns({"__again": again, "__seen": seen}).where("NOT __again AND (held OR __seen IS NULL OR snapshot > __seen)")
    told = kept.withColumns({"was": F.lag("status").over(ordered), "last": F.lead("snapshot").over(ordered).isNull()})
    return told.where("last OR NOT held").select(*[c.split()[0] for c in CHANGES.split(", ")])


def log_changes(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append, for each new snapshot, how many cases have each status and came from which; a replayed batch overwrites its own output.

    The cases' last rows are a table in the checkpoint folder. A batch reads what the batch before wrote and writes the other of two
    copies, so a replayed batch finds what it found the first time.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own, before = batch.sparkSession, f"{checkpoint}/cases/{batch_id % 2}", f"{checkpoint}/cases/{(batch_id + 1) % 2}"
        held = spark.read.schema(CHANGES).parquet(before).where("last") if batch_id else None
        status_changes(batch, held).write.mode("overwrite").parquet(own)
        new = spark.read.schema(CHANGES).parquet(own).where("NOT held")
        counts = new.groupBy("snapshot", "status", "was").agg(F.count(F.lit(1)).alias("n")).withColumn("logged_at", F.current_timestamp())
        counts.write.mode("overwrite").json(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_log(spark: SparkSession, out: str) -> DataFrame:
    """One line per logged snapshot: status counts, the time, and how many cases are new, changed, and finished since the snapshot before.

    The counts of a snapshot that came in several batches are added up.
    """
    c = spark.read.schema("snapshot string, status string, was string, n bigint, logged_at timestamp").json(out)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    changed = F.col("was") != F.col("status")
    counts = c.groupBy("snapshot").agg(
        *[total(F.col("status") == s).alias(s) for s in STATUSES], F.max("logged_at").alias("logged_at"), total(F.col("was").isNull()).alias("new"),
        total(changed).alias("changed"), total(changed & (F.col("status") == "finished")).alias("newly_finished"))
    return counts.join(count_line(counts), "snapshot").select("snapshot", "logged_at", "line", "new", "changed", "newly_finished")


def log_snapshots(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write one time-stamped status line per new snapshot; a replayed batch overwrites its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = count_line(snapshot_counts(batch)).withColumn("logged_at", F.current_timestamp())
        lines.write.mode("overwrite").json(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
