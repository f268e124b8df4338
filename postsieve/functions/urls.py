"""URLs, domains and addresses: Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.patterns import let
from postsieve.lookups import ATTRIBUTE_SUFFIXES, PRIVATE_SUFFIXES, RULE_SUFFIXES

URL = r"(?i)https?://[^\s<>\"']+"
HOST = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)"


def raw_urls(text: Column) -> Column:
    """URLs of a text in order, trailing punctuation off, repetitions out. The scheme may be in any case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[).,;!?]+\z", "")))


def normalise_url(url: Column, drop_fragment: bool = True) -> Column:
    """Scheme and host in lower case, default port, utm parameters, trailing slash and (if asked) fragment off; query sorted."""
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    rest = F.regexp_replace(url, r"(?i)^https?://", "")
    frag = F.regexp_extract(rest, r"(#.*)\z", 1)
    rest = F.regexp_replace(rest, r"#.*\z", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(?:80|443)\z", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/\z", "")
    query = F.regexp_extract(rest, r"\?(.*)\z", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.startswith("utm_"))), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), F.lit("") if drop_fragment else frag)


def urls(text: Column) -> Column:
    return F.array_distinct(F.transform(raw_urls(text), lambda u: normalise_url(u)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def _root(host: Column, suffixes: list[str]) -> Column:
    host = F.lower(host)
    last = lambda n: F.substring_index(host, ".", -n)
    return F.when(last(2).isin(*suffixes) & (host != last(2)), last(3)).otherwise(last(2))


def root_domain_rules(host: Column) -> Column:
    return _root(host, RULE_SUFFIXES)


def root_domain_attributes(host: Column) -> Column:
    return _root(host, ATTRIBUTE_SUFFIXES)


def public_suffix(host: Column, suffixes: list[str] = tuple(ATTRIBUTE_SUFFIXES), private: list[str] = tuple(PRIVATE_SUFFIXES)) -> Column:
    """struct<hostname, suffix, domain, sld, subdomain, is_ip, is_icann, is_private> of a host, under a list of suffixes of two labels that registries have
    and one of suffixes that firms let out; any last label else is a suffix."""

    def over(h: Column) -> Column:
        ip = h.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z") | h.rlike(r"^\[?[0-9a-f:]*:[0-9a-f:.]*\]?\z")
        two = F.substring_index(h, ".", -2)
        let_out = two.isin(*private)
        suffix = F.when(~ip, F.when(two.isin(*suffixes) | let_out, two).otherwise(F.substring_index(h, ".", -1)))
        stem = F.when(F.length(h) > F.length(suffix), F.substring(h, F.lit(1), F.length(h) - F.length(suffix) - 1))
        sld = F.nullif(F.substring_index(stem, ".", -1), F.lit(""))
        domain = F.when(sld.isNotNull(), F.concat(sld, F.lit("."), suffix))
        sub = F.when(domain.isNotNull(), F.substring(h, F.lit(1), F.greatest(F.lit(0), F.length(h) - F.length(domain) - 1)))
        return F.struct(h.alias("hostname"), suffix.alias("suffix"), domain.alias("domain"), sld.alias("sld"), sub.alias("subdomain"), ip.alias("is_ip"), (~ip & ~let_out).alias("is_icann"), (~ip & let_out).alias("is_private"))

    return let(F.lower(host), over)


def host_of_address(address: Column) -> Column:
    """What follows the first @, in lower case; the empty string without one."""
    return F.lower(F.when(address.contains("@"), F.substring(address, F.instr(address, "@") + 1, F.length(address))).otherwise(""))


def host_of_address_or_domain(value: Column) -> Column:
    return F.lower(F.when(value.contains("@"), F.substring(value, F.instr(value, "@") + 1, F.length(value))).otherwise(value))


def undo_srs(address: Column) -> Column:
    """The address behind one or two forwarding rewrites."""
    zero = r"(?i)^<?srs0=[^=]+=[^=]+=([^=]+)=([^@]+)@.*$"
    one = r"(?i)^<?srs1=[^=]+=[^=]+==[^=]+=[^=]+=([^=]+)=([^@]+)@.*$"
    swap = lambda p: F.concat(F.regexp_extract(address, p, 2), F.lit("@"), F.regexp_extract(address, p, 1))
    return F.when(address.rlike(one), swap(one)).when(address.rlike(zero), swap(zero)).otherwise(address)


def addresses(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9._%+=-]+@[A-Za-z0-9.-]+"), 0), lambda a: F.lower(a))


def all_text(text: Column, html: Column, lines: Column, raw: Column | None = None) -> Column:
    """Text, page, header lines and raw source in one, to be searched for links."""
    none = F.array().cast("array<string>")
    heads = F.array_join(F.coalesce(F.transform(lines, lambda h: h["line"]), none), " ")
    return F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(html, F.lit("")), heads, *([raw] if raw is not None else []))


def address_list(values: Column) -> Column:
    """array<string> of addresses in an array of header values, each of which may hold several, with or without names."""
    return F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: addresses(v)))


def header(lines: Column, name: str) -> Column:
    """Value of the first header line of that name in array<struct<key,line>>; null without one."""
    line = F.get(F.filter(lines, lambda h: F.lower(h["key"]) == name.lower()), F.lit(0))["line"]
    return F.trim(F.regexp_replace(line, r"^[^:]*:", ""))


def received_host(received: Column) -> Column:
    host = F.regexp_extract(F.coalesce(received, F.lit("")), r"(?i)from\s+([^\s(]+)", 1)
    return F.when(host != "", F.lower(host))


def received_ip(received: Column) -> Column:
    text = F.coalesce(received, F.lit(""))
    some = [F.regexp_extract(text, p, 1) for p in (r"\[((?:\d+\.){3}\d+)\]", r"(?i)\[([a-f0-9:]+)\]")]
    return reduce(lambda a, b: F.coalesce(a, b), [F.when(s != "", s) for s in some])
