"""Preparing labelled sets: checks, merging, numbering, splitting, shuffling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.session import cut_lineage


def balance(df: DataFrame, label: str) -> DataFrame:
    """(rows, ham, spam, balance, unbalanced, small): balance is the smaller class over the larger."""
    s, h = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    n = df.agg(F.count(F.lit(1)).alias("rows"), h.alias("ham"), s.alias("spam"))
    b = F.least("ham", "spam") / F.nullif(F.greatest("ham", "spam"), F.lit(0))
    return n.withColumn("balance", b).withColumn("unbalanced", F.col("balance") < 0.3).withColumn("small", F.col("rows") < 1000)


def numbered(df: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """df with `k`, the place of a row among those with equal `within`, from 1 in the order of `order`, and `n`, how many these are.

    However few groups there are, none is gathered in one task: rows are range-partitioned by group and order, numbered within their
    partition, and moved on by the counts of the partitions before, one row for each group and partition.
    """
    keys = [*within, *order]
    ranged = cut_lineage(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in within] or [F.lit("")]
    ranged = ranged.withColumn("__group", F.concat_ws("\x01", *groups))
    counts = ranged.groupBy("__group", "__part").agg(F.count(F.lit(1)).alias("__here"))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__group", "__part", F.coalesce(F.sum("__here").over(before), F.lit(0)).alias("__before"), F.sum("__here").over(Window.partitionBy("__group")).alias("n"))
    local = F.row_number().over(Window.partitionBy("__group", "__part").orderBy(*order))
    return ranged.withColumn("__k", local).join(offsets, ["__group", "__part"]).withColumn("k", F.col("__k") + F.col("__before")).drop("__group", "__part", "__k", "__before")


def merge(parts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """All parts under one numbering merged_0, merged_1, ... by part and order, each row with its source."""
    all_ = None
    for name, df in sorted(parts.items()):
        part = df.withColumn("source", F.lit(name))
        all_ = part if all_ is None else all_.unionByName(part)
    return numbered(all_, [], ["source", *order]).withColumn("merged_id", F.concat(F.lit("merged_"), (F.col("k") - 1).cast("string"))).drop("k", "n")


def shuffle(df: DataFrame, key: list[str], seed: str) -> DataFrame:
    """A reproducible random order."""
    return df.orderBy(F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(seed)), 256), *key)


def holdout(df: DataFrame, label: str, key: list[str], share: float = 0.8) -> DataFrame:
    """df with `part`: the first share of each class, in order of key, is for training."""
    return numbered(df, [label], key).withColumn("part", F.when(F.col("k") <= F.floor(F.col("n") * share), "train").otherwise("test")).drop("k", "n")


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """df with `fold`, 0 to k - 1, by the hash of a key."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """(hash, n) of values that occur more than once."""
    return df.where(F.col(column).isNotNull()).groupBy(F.sha2(column, 256).alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compare(rows: DataFrame, truth: str, *methods: str) -> DataFrame:
    """(method, correct, n, accuracy): how often each column of `methods` equals the column `truth`."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.coalesce(F.col(m) == F.col(truth), F.lit(False)).alias("right")) for m in methods))).alias("x")
    n = rows.where(F.col(truth).isNotNull()).select(each).groupBy("x.method").agg(F.count_if("x.right").alias("correct"), F.count(F.lit(1)).alias("n"))
    return n.select("method", "correct", "n", (F.col("correct") / F.col("n")).alias("accuracy"))
