"""Structured Streaming: scanning a stream of mails, and running totals over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.plans.scan import scan


def read_mail_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON lines of (message_id, subject, text, html, received_at) as they arrive in a folder."""
    schema = "message_id long, subject string, text string, html string, received_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def scan_stream(mail: DataFrame, threshold: int = 5) -> DataFrame:
    """Stateless: the batch plan on a stream."""
    return scan(mail, threshold)


def scan_metrics(scanned: DataFrame) -> DataFrame:
    """(scans, spam, mean_score, last_id): totals over all that was scanned, and its greatest id; on a stream, for output mode complete."""
    return scanned.agg(F.count(F.lit(1)).alias("scans"), F.count_if("is_spam").alias("spam"), F.avg("rule_score").alias("mean_score"), F.max("message_id").alias("last_id"))


def reply(scanned: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Start to write a reply, one JSON object for each mail, for every batch of a stream; a batch that is repeated after a failure overwrites its replies."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.to_json(F.struct(*batch.columns)).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    out = scanned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def windowed(mail: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Messages per window of arrival, closed once they are later than `late` (an extension)."""
    return mail.withWatermark("received_at", late).groupBy(F.window("received_at", width)).agg(F.count(F.lit(1)).alias("n"))
