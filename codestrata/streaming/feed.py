"""The change feed as a stream: effective changes per micro-batch, committed with a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from codestrata.operators.incremental import ConcurrentCommit, IncrementalLedger


def dirty_windows(changes: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """(repo, start, changed): paths changed per repository and window, late rows accepted within the watermark."""
    counted = changes.withWatermark("arrived_at", late).groupBy("repo", F.window("arrived_at", window).alias("w"))
    return counted.agg(F.approx_count_distinct("path").alias("changed")).select("repo", F.col("w.start").alias("start"), "changed")


def read_changes(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """The folder of change files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process_stream(stream: DataFrame, ledger_root: str, checkpoint: str, key: str = "checkout_id", seq: str = "change_id") -> StreamingQuery:
    """Publish every change once through an IncrementalLedger, whatever is replayed after a failure.

    A replayed micro-batch finds its sequence numbers in the ledger and publishes nothing; a batch that died
    before its manifest was written is done again whole.
    """

    def batch(rows: DataFrame, _: int) -> None:
        ledger = IncrementalLedger(rows.sparkSession, ledger_root, [key], seq)
        for _attempt in range(5):
            new = ledger.pending(rows.dropDuplicates([key, seq])).persist()
            try:
                if new.limit(1).count():
                    covered = new.select(key, F.col(seq).alias("lo"), (F.col(seq) + 1).alias("hi"))
                    ledger.commit(new, covered)
                return
            except ConcurrentCommit:
                continue
            finally:
                new.unpersist()
        raise ConcurrentCommit(ledger_root)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, ledger_root: str, key: str = "checkout_id", seq: str = "change_id") -> DataFrame:
    """The newest published change of each (checkout, path)."""
    rows = IncrementalLedger(spark, ledger_root, [key], seq).output()
    return rows.groupBy(key, "path").agg(F.max_by(F.struct("content_sha", "change_kind"), F.struct("arrived_at", seq)).alias("state")).select(key, "path", "state.*")
