"""Sender authentication results: normalised, scored, written as a header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.lookups import AUTH_WEIGHTS


def normal(result: Column) -> Column:
    """A result word in lower case; none where it is absent or blank."""
    low = F.lower(F.trim(result))
    return F.coalesce(F.nullif(low, F.lit("")), F.lit("none"))


def score(dkim: Column, spf: Column, dmarc: Column, arc: Column) -> Column:
    """struct<score, tests>: weights of passes and failures; a soft failure of SPF counts 1."""
    got = {"dkim": normal(dkim), "spf": normal(spf), "dmarc": normal(dmarc), "arc": normal(arc)}
    points, tests = [], []
    for kind, (good, bad) in AUTH_WEIGHTS.items():
        points.append(F.when(got[kind] == "pass", F.lit(good)).when(got[kind] == "fail", F.lit(bad)).otherwise(F.lit(0)))
        tests += [F.when(got[kind] == "pass", f"{kind.upper()}_PASS({good})"), F.when(got[kind] == "fail", f"{kind.upper()}_FAIL({bad})")]
    soft = got["spf"] == "softfail"
    points.append(F.when(soft, F.lit(1)).otherwise(F.lit(0)))
    tests.insert(4, F.when(soft, "SPF_SOFTFAIL(1)"))
    return F.struct(reduce(lambda a, b: a + b, points).alias("score"), F.array_compact(F.array(*tests)).alias("tests"))


def normalised(results: dict[str, Column], domains: dict[str, Column] | None = None) -> Column:
    """struct of struct<result, comment, domain> for dkim, spf, dmarc, arc and bimi; what is absent is "none" with a comment that says so."""
    absent = {"dkim": "No DKIM signature found", "spf": "SPF check not performed", "dmarc": "DMARC check not performed", "arc": "No ARC chain found", "bimi": "No BIMI record found"}
    domains = domains or {}
    one = lambda k, c: F.struct(normal(c).alias("result"), F.when(normal(c) == "none", absent[k]).alias("comment"), domains.get(k, F.lit(None).cast("string")).alias("domain"))
    return F.struct(*(one(k, results.get(k, F.lit(None).cast("string"))).alias(k) for k in absent))


def only(results: dict[str, Column], kind: str, domain: Column | None = None) -> Column:
    """The normalised result of one method alone, dkim or spf for instance."""
    return normalised({kind: results[kind]} if kind in results else {}, {kind: domain} if domain is not None else None)[kind]


def of_mail(results: dict[str, Column], host: str, spf_domain: Column) -> Column:
    """struct<results, score, tests, header> of a mail, null where no result was given at all."""
    found = F.coalesce(*results.values())
    s = score(*(results[k] for k in ("dkim", "spf", "dmarc", "arc")))
    line = header(host, results["dkim"], results["spf"], spf_domain, results["dmarc"], results["arc"])
    return F.when(found.isNotNull(), F.struct(normalised(results, {"spf": spf_domain}).alias("results"), s["score"].alias("score"), s["tests"].alias("tests"), line.alias("header")))


def from_header(value: Column) -> dict[str, Column]:
    """Result words of an Authentication-Results header by method; null where it doesn't name the method."""
    return {k: F.nullif(F.lower(F.regexp_extract(value, rf"(?i)(?:^|[;\s]){k}=([a-z]+)", 1)), F.lit("")) for k in ("dkim", "spf", "dmarc", "arc", "bimi")}


def header(host: str, dkim: Column, spf: Column, spf_domain: Column, dmarc: Column, arc: Column) -> Column:
    part = lambda name, c, extra=None: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c) if extra is None else F.concat(F.lit(f"{name}="), c, extra))
    domain = F.when(spf_domain.isNotNull(), F.concat(F.lit(" smtp.mailfrom="), spf_domain)).otherwise("")
    return F.concat_ws(";\n\t", F.lit(host), part("dkim", dkim), part("spf", spf, domain), part("dmarc", dmarc), part("arc", arc))
