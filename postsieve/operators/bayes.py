"""Multinomial naive Bayes with add-one smoothing: the model is two small tables; scoring is one narrow pass over the tokens."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.session import cut_lineage

#: Tokens that a model keeps unless told otherwise, and up to how many it is broadcast.
VOCABULARY, BROADCAST = 20_000, 1_000_000
CATEGORIES = 1000


@dataclass
class Model:
    """prior(category, docs) and counts(category, token, n). tokens: how many tokens counts has at most, None if that isn't known."""

    prior: DataFrame
    counts: DataFrame
    tokens: int | None = None

    def kept(self) -> Model:
        """The model written once, to be read by all that follows."""
        return Model(cut_lineage(self.prior), cut_lineage(self.counts), self.tokens)


def train(docs: DataFrame, ham_weight: int = 2, limit: int | None = None) -> Model:
    """docs(category, tokens). Tokens of ham count ham_weight times, its documents once. limit: keep the most frequent tokens only."""
    weight = F.when(F.col("category") == "ham", F.lit(ham_weight)).otherwise(F.lit(1))
    counts = docs.select("category", F.explode("tokens").alias("token")).groupBy("category", "token").agg(F.count(F.lit(1)).alias("c")).select("category", "token", (F.col("c") * weight).alias("n"))
    if limit is not None:
        counts = cut_lineage(counts)
        counts = counts.join(F.broadcast(vocabulary(counts, limit).select("token")) if limit <= BROADCAST else vocabulary(counts, limit).select("token"), "token", "left_semi").select("category", "token", "n")
    return Model(docs.groupBy("category").agg(F.count(F.lit(1)).alias("docs")), counts, limit)


def vocabulary(counts: DataFrame, limit: int = VOCABULARY) -> DataFrame:
    """The most frequent tokens; ties go by the token."""
    return counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(limit)


def dynamic_limit(docs: DataFrame) -> DataFrame:
    """(vocabulary): the number of distinct tokens, at most a tenth of the documents."""
    n = docs.select(F.explode("tokens").alias("t")).distinct().select(F.lit(1).alias("t"), F.lit(0).alias("d"))
    both = n.unionByName(docs.select(F.lit(0).alias("t"), F.lit(1).alias("d")))
    return both.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).select(F.least(F.coalesce("t", F.lit(0)), F.floor(F.coalesce("d", F.lit(0)) * 0.1)).alias("vocabulary"))


def merge(old: Model, new: Model) -> Model:
    """The model of the documents of both."""
    add = lambda a, b, keys, n: a.unionByName(b).groupBy(*keys).agg(F.sum(n).alias(n))
    return Model(add(old.prior, new.prior, ["category"], "docs"), add(old.counts, new.counts, ["category", "token"], "n"))


def wide_scores(docs: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """docs(id, tokens) -> (id, s0, s1, ...): log posterior, up to a constant, of each of the categories that are returned with it.

    Tokens that the model doesn't know don't count; a document without known tokens keeps the priors. The model's tokens are
    broadcast if they are bounded by BROADCAST, else joined by a shuffle; sums are formed before anything of the documents is shuffled.
    """
    model = model.kept()
    total = {r["category"]: r["total"] for r in model.counts.groupBy("category").agg(F.sum("n").alias("total")).limit(CATEGORIES + 1).collect()}
    docs_of = {r["category"]: r["docs"] for r in model.prior.limit(CATEGORIES + 1).collect()}
    if len(docs_of) > CATEGORIES:
        raise ValueError(f"more than {CATEGORIES} categories")
    kinds, size, every = sorted(docs_of), model.counts.select("token").distinct().count(), sum(docs_of.values())
    if not kinds:
        return docs.select("id").distinct(), kinds
    below = {k: float(total.get(k, 0) + size) for k in kinds}
    n = lambda k: F.coalesce(F.sum(F.when(F.col("category") == k, F.col("n"))), F.lit(0))
    weights = model.counts.groupBy("token").agg(*(F.log((n(k) + 1) / F.lit(below[k] or 1.0)).alias(f"w{i}") for i, k in enumerate(kinds)))
    weights = F.broadcast(weights) if size <= BROADCAST else weights
    each = docs.select("id", F.explode_outer("tokens").alias("token")).join(weights, "token", "left")
    prior = [math.log(docs_of[k] / every) for k in kinds]
    return each.groupBy("id").agg(*((F.sum(F.coalesce(f"w{i}", F.lit(0.0))) + F.lit(prior[i])).alias(f"s{i}") for i in range(len(kinds)))), kinds


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(id, category, score)."""
    wide, kinds = wide_scores(docs, model)
    if not kinds:
        return wide.select("id", F.lit("").alias("category"), F.lit(0.0).alias("score")).limit(0)
    each = F.array(*(F.struct(F.lit(k).alias("category"), F.col(f"s{i}").alias("score")) for i, k in enumerate(kinds)))
    return wide.select("id", F.explode(each).alias("x")).select("id", "x.category", "x.score")


def _best(kinds: list[str]) -> Column:
    """The best category; ties go to ham, then to the last by name."""
    each = F.array(*(F.struct(F.col(f"s{i}").alias("score"), F.lit(k == "ham").alias("ham"), F.lit(k).alias("category")) for i, k in enumerate(kinds)))
    return F.array_max(each)["category"]


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(id, category)."""
    wide, kinds = wide_scores(docs, model)
    return wide.select("id", (_best(kinds) if kinds else F.lit(None).cast("string")).alias("category"))


def probabilities(docs: DataFrame, model: Model) -> DataFrame:
    """(id, category, probability): the share of each category; the shares of a document add up to 1."""
    wide, kinds = wide_scores(docs, model)
    if not kinds:
        return wide.select("id", F.lit("").alias("category"), F.lit(0.0).alias("probability")).limit(0)
    cols = [F.col(f"s{i}") for i in range(len(kinds))]
    top = reduce(F.greatest, cols) if len(cols) > 1 else cols[0]
    e = wide.select("id", *(F.exp(c - top).alias(f"e{i}") for i, c in enumerate(cols)))
    total = reduce(lambda a, b: a + b, (F.col(f"e{i}") for i in range(len(kinds))))
    return e.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("category"), (F.col(f"e{i}") / total).alias("probability")) for i, k in enumerate(kinds)))).alias("x")).select("id", "x.category", "x.probability")


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Confusion counts of (id, category) against (id, label)."""
    return predicted.join(labels, "id").groupBy("label", "category").agg(F.count(F.lit(1)).alias("n"))


def categoriser(model: Model):
    """Column of tokens -> Column with the best category, ties to ham. The model must be bounded by BROADCAST tokens: its weights go to the
    tasks as one table, so that scoring is a narrow pass, on batch and streaming input alike."""
    model = model.kept()
    rows = model.counts.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("by")).limit(BROADCAST + 1).collect()
    if len(rows) > BROADCAST:
        raise ValueError(f"more than {BROADCAST} tokens; train the model with a limit, or use classify")
    docs_of = {r["category"]: r["docs"] for r in model.prior.limit(CATEGORIES + 1).collect()}
    kinds = sorted(docs_of, key=lambda k: (k == "ham", k))
    if not kinds:
        return lambda tokens: F.lit(None).cast("string")
    total = {k: sum(r["by"].get(k, 0) for r in rows) for k in kinds}
    below = {k: float(total[k] + len(rows)) or 1.0 for k in kinds}
    weights = {r["token"]: tuple(math.log((r["by"].get(k, 0) + 1) / below[k]) for k in kinds) for r in rows}
    held = model.prior.sparkSession.sparkContext.broadcast((kinds, [math.log(docs_of[k] / sum(docs_of.values())) for k in kinds], weights))

    @F.pandas_udf("string")
    def best(tokens: pd.Series) -> pd.Series:
        names, prior, table = held.value
        out = []
        for ts in tokens:
            s = list(prior)
            for t in ts if ts is not None else ():
                if (w := table.get(t)) is not None:
                    for i, x in enumerate(w):
                        s[i] += x
            out.append(names[max(range(len(s)), key=lambda i: (s[i], i))])
        return pd.Series(out)

    return best
