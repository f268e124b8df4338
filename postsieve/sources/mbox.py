"""Mailbox files: one row per message, read by Spark's own splittable text reader from any file system that it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.lookups import MBOX_NAMES
from postsieve.operators.datasets import numbered


def read_mbox(spark: SparkSession, path: str, names: str | None = None, number: bool = False) -> DataFrame:
    """(path, raw) of every message in the mailbox files at or below a path; with `number`, also its place in its file, from 0.

    Messages are parted by lines that begin with "From "; a large file is read by many tasks. names: pattern of the file names to read
    (MBOX_NAMES for the usual ones); all by default. A file is taken to begin with such a line, as mailboxes do. Lines that
    were marked ">From " come out unmarked. Empty files give no row.
    """
    made = spark.read.option("lineSep", "\nFrom ").option("recursiveFileLookup", "true").text(path)
    rows = made.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"), "value")
    if names:
        rows = rows.where(F.element_at(F.split("path", "/"), -1).rlike(names))
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace("value", r"\A[^\n]*\n", "")).otherwise("")
    whole = F.when(body.endswith("\n") | (body == ""), body).otherwise(F.concat(body, F.lit("\n")))
    rows = rows.where("value <> ''").select("path", "__block", "__row", F.regexp_replace(whole, r"(?m)^>From ", "From ").alias("raw"))
    if number:
        rows = numbered(rows, ["path"], ["__block", "__row"]).withColumn("number", (F.col("k") - 1).cast("int"))
        return rows.select("path", "number", "raw")
    return rows.select("path", "raw")


__all__ = ["MBOX_NAMES", "read_mbox"]
