"""Language of a text by its letter trigrams: which language's most frequent ones it shares most.

The profiles hold `top` trigrams of each language, whatever the size of the data; they go into the plan as literal arrays, so that
detection is one narrow pass without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions import text as T
from postsieve.functions.patterns import let

#: Most languages that profiles are built for.
LANGUAGES = 200


def plain(text: Column) -> Column:
    """Lower case, letters and single blanks only."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[0-9\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\s]+", " "), "^ | $", "")


def grams(text: Column) -> Column:
    """array<string> of the distinct trigrams of a text."""
    none = F.array().cast("array<string>")
    cut = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return let(plain(text), lambda p: F.when(F.length(p) > 2, cut(p)).otherwise(none))


def profiles(labelled: DataFrame, top: int = 200) -> DataFrame:
    """labelled(lang, text) -> (lang, trigram): the top trigrams of each language by the number of texts; ties by the trigram."""
    n = labelled.select("lang", F.explode(grams(F.col("text"))).alias("trigram")).groupBy("lang", "trigram").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "trigram"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "trigram")


def as_lists(profile: DataFrame) -> dict[str, list[str]]:
    """Profiles on the driver: top trigrams for each of at most LANGUAGES languages."""
    rows = profile.groupBy("lang").agg(F.sort_array(F.collect_list("trigram")).alias("t")).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r["lang"]: r["t"] for r in rows}


def best(text: Column, lists: dict[str, list[str]]) -> Column:
    """struct<shared, lang> of the language with most shared trigrams, the last by name of equal ones; null if none is shared."""
    lit = lambda t: F.array(*(F.lit(x) for x in t))
    every = lambda g: F.array_max(F.array(*(F.struct(F.size(F.array_intersect(g, lit(t))).alias("shared"), F.lit(k).alias("lang")) for k, t in sorted(lists.items()))))
    return let(let(grams(text), every), lambda x: F.when(x["shared"] > 0, x))


def detect(texts: DataFrame, profile: DataFrame) -> DataFrame:
    """texts(id, text) -> (id, lang, shared); texts without a known trigram give no row."""
    lists = as_lists(profile)
    if not lists:
        return texts.select("id", F.lit("").alias("lang"), F.lit(0).alias("shared")).limit(0)
    return texts.select("id", best(F.col("text"), lists).alias("m")).where("m is not null").select("id", F.col("m.lang").alias("lang"), F.col("m.shared").cast("long").alias("shared"))


def hybrid(text: Column, lists: dict[str, list[str]], supported: list[str] | None = None) -> Column:
    """Two-letter language of a text: English for what has no letters, or in Latin letters is too short to tell; else the best profile, if
    it is among the supported languages, or else the first of these."""
    found = F.coalesce(best(text, lists)["lang"], F.lit("en"))
    if supported:
        known = lambda x: F.when(x.isin(*supported), x).otherwise(supported[0])
    else:
        known = lambda x: x
    short = F.length(text) < 50
    return F.when(T.language_guard(text), "en").otherwise(let(found, lambda x: F.when(short & ~T.plausible_short(text, x), "en").otherwise(known(x))))
