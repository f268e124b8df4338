"""Attributes of a sender and their reputation, looked up by join and aggregated in the order of the attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions import urls
from postsieve.functions.patterns import let


def _three(address: Column) -> Column:
    """Address, its host and its root host, a forwarding rewrite undone."""
    return let(F.lower(urls.undo_srs(address)), lambda a: F.when(F.coalesce(a, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(a, urls.host_of_address_or_domain(a), urls.root_domain_attributes(urls.host_of_address_or_domain(a)))))


def _clean(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.array_compact(values), lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def attributes(client_host: Column, root_client: Column, ip: Column, from_: Column, reply_to: Column, mail_from: Column) -> Column:
    """Distinct values in order: host, root host, address, then address, host and root host of sender, reply address and envelope sender."""
    return _clean(F.concat(F.array(client_host, root_client, ip), _three(from_), _three(reply_to), _three(mail_from)))


def aligned_attributes(client_host: Column, root_client: Column, ip: Column, from_: Column, reply_to: Column, mail_from: Column, signing_domains: Column, spf: Column) -> Column:
    """As attributes, but each group of three only if it is proven: its host or root host signed the mail, or SPF passed for it.

    signing_domains: array<string> of domains whose signatures passed. spf: map<string, string> of results by domain.
    """
    empty = F.array().cast("array<string>")

    def group(address: Column) -> Column:
        def proven(x: Column) -> Column:
            names = F.slice(x, 2, 2)
            signed = F.coalesce(F.arrays_overlap(names, signing_domains), F.lit(False))
            result = F.coalesce(F.try_element_at(spf, F.get(names, F.lit(0))), F.try_element_at(spf, F.get(names, F.lit(1))))
            return F.when((F.size(x) > 0) & (signed | F.coalesce(result == "pass", F.lit(False))), x).otherwise(empty)

        return let(_three(address), proven)

    return _clean(F.concat(F.array(client_host, root_client, ip), group(from_), group(reply_to), group(mail_from)))


def extract(session: Column, reply_to: Column, dkim: Column, spf: Column, only_aligned: bool = True) -> Column:
    """struct<attributes, signing_domains, aligned_signature> of a session (as sessions.for_attributes gives it). dkim: array<struct<domain, result>> of signatures;
    the domains of those that passed, and their root domains, count as signing. spf: map<string, string> of results by domain."""
    passed = F.filter(F.coalesce(dkim, F.array().cast("array<struct<domain:string,result:string>>")), lambda x: (x["result"] == "pass") & (x["domain"] != ""))
    signing = F.array_distinct(F.flatten(F.transform(passed, lambda x: F.array(F.lower(x["domain"]), urls.root_domain_attributes(x["domain"])))))

    def over(s: Column) -> Column:
        parts = (session["client_host"], session["root_client_host"], session["remote_address"], session["from_address"], reply_to, session["mail_from"])
        attrs = aligned_attributes(*parts, s, spf) if only_aligned else attributes(*parts)
        own = F.array(session["from_domain"], session["from_root"])
        return F.struct(attrs.alias("attributes"), s.alias("signing_domains"), F.coalesce(F.arrays_overlap(own, s), F.lit(False)).alias("aligned_signature"))

    return let(signing, over)


def checked_values(attrs: Column, envelope_sender: Column, reply_to: Column) -> Column:
    """Attributes, then the envelope sender, the reply address and their hosts where they aren't among them."""
    pair = lambda a: F.array(F.lower(a), F.nullif(F.split_part(F.lower(a), F.lit("@"), F.lit(2)), F.lit("")))
    return _clean(F.concat(attrs, pair(envelope_sender), pair(reply_to)))


def aligned(attrs: Column, host: Column, spf_pass: Column, signing_domains: Column) -> Column:
    """The attributes if SPF passed or a signature is of the host's root domain, else none."""
    root = urls.root_domain_attributes(host)
    signed = F.coalesce(F.exists(signing_domains, lambda d: urls.root_domain_attributes(d) == root), F.lit(False))
    return F.when(F.coalesce(spf_pass, F.lit(False)) | signed, attrs).otherwise(F.array().cast("array<string>"))


def look_up(values: DataFrame, reputation: DataFrame) -> DataFrame:
    """values(message_id, attrs) -> one row per message: whether any value is a truth source, allowed or denied, and the first that is.

    The size of the reputation table decides between broadcast and shuffle; unknown values count as false.
    """
    each = values.select("message_id", F.posexplode("attrs").alias("pos", "value"))
    known = reputation.withColumnRenamed("reputation_value", "value")
    joined = each.join(known, "value", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = []
    for c, v in (("is_truth_source", "truth_source_value"), ("is_allowlisted", "allowlist_value"), ("is_denylisted", "denylist_value")):
        out += [F.bool_or(flag(c)).alias(c), F.min_by(F.when(flag(c), F.coalesce(F.col(v), F.col("value"))), F.when(flag(c), F.col("pos"))).alias(v)]
    return joined.groupBy("message_id").agg(*out)
