"""Records that were delivered more than once under one id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.session import cut_lineage

#: Most rows of one or two numbers that are broadcast.
SMALL = 1_000_000


def first_deliveries(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """df without the rows of a key whose columns differ from those of its first delivery (by loaded_at, nulls first; ties by the hash of the columns).

    Equal deliveries all stay. Only (key, moment, hash) is shuffled; if no key has deliveries that differ, nothing else is done,
    else the few that have are broadcast, or, if they are many, joined by a shuffle.
    """
    hashed = df.withColumn("__h", F.xxhash64(*columns))
    by_key = hashed.groupBy(key).agg(F.min("__h").alias("lo"), F.max("__h").alias("hi"), F.min(F.struct(F.unix_micros(F.col("loaded_at").cast("timestamp")), "__h"))["__h"].alias("__first"))
    odd = cut_lineage(by_key.where("lo <> hi").select(key, "__first"))
    n = odd.count()
    if not n:
        return df
    return hashed.join(F.broadcast(odd) if n <= SMALL else odd, key, "left").where("__first is null or __first = __h").select(*df.columns)
