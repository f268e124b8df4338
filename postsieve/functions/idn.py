"""Homograph risk of host names. Scores are ordered sums of doubles: each group's subtotal first, then the groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.patterns import let
from postsieve.lookups import BRANDS, CONFUSABLE, CONFUSABLE_LONG, CONTEXT_PATTERNS, IDN_WHITELIST

SCRIPTS = {"Latin": "[A-Za-z]", "Cyrillic": r"[\x{0400}-\x{04FF}]", "Greek": r"[\x{0370}-\x{03FF}]", "CJK": r"[\x{4E00}-\x{9FFF}]", "Hebrew": r"[\x{0590}-\x{05FF}]", "Arabic": r"[\x{0600}-\x{06FF}]"}


def _double(x: float) -> Column:
    return F.lit(float(x))


def is_idn(host: Column) -> Column:
    return host.contains("xn--") | host.rlike(r"[^\x00-\x7F]")


_SHORT, _LONG = "".join(CONFUSABLE), "".join(CONFUSABLE_LONG)


def confusable_count(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, _SHORT + _LONG, ""))


def unconfuse(host: Column) -> Column:
    single = F.translate(host, _SHORT, "".join(CONFUSABLE.values()))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), CONFUSABLE_LONG.items(), single)


def confusable_score(host: Column) -> Column:
    return F.when(F.length(host) > 0, F.least(confusable_count(host).cast("double") / F.length(host) * _double(0.8), _double(0.6))).otherwise(_double(0))


def confusable_factors(host: Column) -> Column:
    """Which characters of a host pass for others, and how many."""
    chars = F.filter(F.split(host, ""), lambda c: c.isin(*CONFUSABLE, *CONFUSABLE_LONG))
    each = F.transform(chars, lambda c: F.concat(F.lit("Confusable character: "), c, F.lit(" → "), unconfuse(c)))
    total = F.concat(F.size(chars).cast("string"), F.lit("/"), F.length(host).cast("string"), F.lit(" characters are confusable"))
    return F.when(F.size(chars) > 0, F.concat(each, F.array(total))).otherwise(F.array().cast("array<string>"))


def plain_domain(host: Column) -> Column:
    return F.regexp_replace(unconfuse(F.lower(host)), r"\.(?:com|org|net|edu|gov)\z", "")


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, _double(1)).otherwise((longest - F.levenshtein(a, b)).cast("double") / longest)


def brand_similarity(host: Column) -> Column:
    """Greatest similarity to a well-known brand; the table is short, so that it is unrolled."""
    return let(plain_domain(host), lambda p: F.greatest(*(similarity(p, F.lit(b)) for b in BRANDS)))


def brand_score(host: Column) -> Column:
    return let(brand_similarity(host), lambda s: F.when(s > 0.8, s * _double(0.7)).otherwise(_double(0)))


def scripts(host: Column) -> Column:
    return F.array_compact(F.array(*(F.when(host.rlike(p), n) for n, p in SCRIPTS.items())))


def script_score(host: Column) -> Column:
    s = scripts(host)
    mixed = F.array_contains(s, "Latin") & (F.array_contains(s, "Cyrillic") | F.array_contains(s, "Greek"))
    return F.when(F.size(s) < 2, _double(0)).when(mixed, _double(0.4)).otherwise(_double(0.2))


def text_score(content: Column) -> Column:
    """What a mail's text adds to the risk of all its hosts."""
    return let(F.lower(F.coalesce(content, F.lit(""))), lambda low: reduce(lambda s, p: s + F.when(low.rlike(p), _double(0.1)).otherwise(_double(0)), CONTEXT_PATTERNS, _double(0)))


def context_score(content: Column, display_differs: Column, reputation: Column | None = None) -> Column:
    """display_differs: whether the shown address is another than the host. reputation: of the sender, 0 to 1; only one below one half, and not 0, counts."""
    start = F.when(display_differs, _double(0.3)).otherwise(_double(0))
    if reputation is not None:
        start = start + F.when((reputation < 0.5) & (reputation != 0), _double(0.2)).otherwise(_double(0))
    low = F.lower(F.coalesce(content, F.lit("")))
    return let(low, lambda t: reduce(lambda s, p: s + F.when(t.rlike(p), _double(0.1)).otherwise(_double(0)), CONTEXT_PATTERNS, start))


#: What a label of a punycode host may hold; another can't be decoded.
_PUNY = r"(?i)^(?:(?:xn--[a-z0-9-]*[a-z0-9]|[^.]*)(?:\.|\z))+\z"


def punycode_score(host: Column) -> Column:
    """Of a host with punycode: its look-alike characters once more, or 0.2 if it can't be decoded."""
    bad = ~host.rlike(_PUNY) | host.rlike(r"(?i)(?:^|\.)xn--(?:\.|\z)")
    return F.when(host.contains("xn--"), F.when(bad, _double(0.2)).otherwise(confusable_score(host) * _double(0.8))).otherwise(_double(0))


def host_score(host: Column) -> Column:
    """struct of what the host alone adds to its risk: before and after the context's share, which comes between."""
    return F.struct((_double(0) + F.when(is_idn(host), _double(0.3)).otherwise(_double(0)) + confusable_score(host) + brand_score(host) + script_score(host)).alias("before"), punycode_score(host).alias("after"))


def risk(host: Column, content: Column, display_differs: Column, reputation: Column | None = None) -> Column:
    s = host_score(host)
    return F.when(host.isin(*IDN_WHITELIST), _double(0)).otherwise(s["before"] + context_score(content, display_differs, reputation) + s["after"])


def risk_factors(host: Column, content: Column, display_differs: Column) -> Column:
    """array<string> of what makes a host risky, in the order in which it is scored."""
    none = F.array().cast("array<string>")
    s = scripts(host)
    brands = F.array_compact(F.array(*(F.when(similarity(plain_domain(host), F.lit(b)) > 0.8, F.concat(F.lit(f"High similarity to {b}: "), F.format_string("%.1f", similarity(plain_domain(host), F.lit(b)) * 100), F.lit("%"))) for b in BRANDS)))
    mixed = F.array_contains(s, "Latin") & (F.array_contains(s, "Cyrillic") | F.array_contains(s, "Greek"))
    low = F.lower(F.coalesce(content, F.lit("")))
    source = lambda p: p.replace(r"[^\n\r]", ".")
    every = F.concat(
        F.array_compact(F.array(F.when(is_idn(host), "Contains non-ASCII characters"))), confusable_factors(host), brands,
        F.array_compact(F.array(F.when(F.size(s) > 1, F.concat(F.lit("Mixed scripts detected: "), F.array_join(s, ", "))), F.when((F.size(s) > 1) & mixed, "Suspicious Latin/Cyrillic or Latin/Greek mixing"))),
        F.array_compact(F.array(F.when(display_differs, "Display text differs from actual domain"), *(F.when(low.rlike(p), f"Suspicious email pattern: {source(p)}") for p in CONTEXT_PATTERNS))),
        F.when(host.contains("xn--"), F.concat(F.array(F.concat(F.lit("Punycode decoded: "), host)), confusable_factors(host))).otherwise(none),
    )
    return F.when(host.isin(*IDN_WHITELIST), none).otherwise(every)


def confidence(risk_score: Column, host: Column) -> Column:
    return F.when(host.isin(*IDN_WHITELIST), _double(1)).otherwise(F.least(risk_score, _double(1)))


def recommendations(risk_score: Column, host: Column) -> Column:
    level = (
        F.when(risk_score > 0.8, "HIGH RISK: Likely homograph attack - block or quarantine")
        .when(risk_score > 0.6, "MEDIUM RISK: Suspicious domain - flag for review")
        .when(risk_score > 0.3, "LOW RISK: Monitor domain activity")
        .otherwise("SAFE: Domain appears legitimate")
    )
    return F.array_compact(F.array(level, F.when(is_idn(host), "Consider displaying punycode representation to users")))
