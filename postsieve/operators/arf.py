"""Abuse reports after RFC 5965: parsing and writing, as Column expressions over the raw message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.lookups import FEEDBACK_TYPES


def unfold(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n[ \t]+", " ")


def boundary(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(unfold(raw), r'(?i)boundary="?([^";\s]+)"?', 1), F.lit(""))


def is_report(raw: Column) -> Column:
    head = F.lower(F.split_part(unfold(raw), F.lit("\n\n"), F.lit(1)))
    return head.rlike(r"content-type:\s*multipart/report") & head.rlike(r"report-type=\"?feedback-report")


def parts(raw: Column) -> Column:
    """The MIME parts between the boundaries, blank ones out."""
    every = F.split(unfold(raw), F.concat(F.lit(r"(?m)^--\Q"), boundary(raw), F.lit(r"\E(?:--)?[ \t]*$")))
    return F.filter(F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0))), lambda p: F.trim(p) != "")


def part_of(raw: Column, kind: str) -> Column:
    """Body of the first part of a content type."""
    p = F.get(F.filter(parts(raw), lambda p: F.lower(p).rlike(r"content-type:\s*" + kind)), F.lit(0))
    return F.regexp_replace(p, r"(?s)\A\n?.*?\n\n", "")


def field(report: Column, name: str) -> Column:
    """First value of a report field, null without one."""
    return F.nullif(F.trim(F.regexp_extract(report, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def fields(report: Column, name: str) -> Column:
    return F.transform(F.regexp_extract_all(report, F.lit(rf"(?im)^{name}:[ \t]*(.*)$"), 1), lambda v: F.trim(v))


def email_of(value: Column) -> Column:
    inside, plain = F.regexp_extract(value, r"<([^>]+)>", 1), F.regexp_extract(value, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+", 0)
    return F.when(value != "", F.when(inside != "", inside).when(plain != "", plain).otherwise(F.trim(value)))


def source_ip(value: Column) -> Column:
    v4, v6 = F.regexp_extract(value, r"((?:\d{1,3}\.){3}\d{1,3})", 1), F.regexp_extract(value, r"([a-fA-F\d:]+:+[a-fA-F\d:]+)", 1)
    return F.when(value != "", F.when(v4 != "", v4).when(v6 != "", v6).otherwise(F.trim(value)))


#: Zone abbreviations of mail dates.
US_ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def date_of(value: Column) -> Column:
    """A moment in any of the notations that postsieve.operators.timestamps reads, as mails write them; null for others."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(value, r"^\s*[A-Za-z]{3},\s*", ""), r"\([^)]*\)", ""))
    zoned = reduce(lambda v, z: F.regexp_replace(v, rf"\b{z[0]}\z", z[1]), US_ZONES.items(), F.regexp_replace(plain, r"\b(?:GMT|UTC|UT|Z)\z", "+0000"))
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    iso = F.regexp_replace(plain, r"Z\z", "+00:00")
    return F.coalesce(*(F.try_to_timestamp(zoned if f.startswith("d ") else iso, F.lit(f)) for f in formats))


def reporting_mta(value: Column) -> Column:
    v = F.trim(value)
    typed = v.rlike(r"^[A-Za-z0-9_]+;")
    kind = F.when(typed, F.lower(F.regexp_extract(v, r"^([A-Za-z0-9_]+);", 1))).otherwise("unknown")
    return F.when(v != "", F.struct(kind.alias("type"), F.trim(F.when(typed, F.regexp_replace(v, r"^[^;]*;", "")).otherwise(v)).alias("name")))


def feedback_type(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*FEEDBACK_TYPES), low).when(low.isNotNull(), "other")


def header_map(message: Column) -> Column:
    """map of the header fields of a raw message by lower-case name; of a repeated field the first."""
    head = F.split_part(message, F.lit("\n\n"), F.lit(1))
    kept = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pairs = F.transform(kept, lambda x: F.struct(F.lower(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.when(message.isNotNull(), F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.get(F.filter(pairs, lambda p: p["k"] == k), F.lit(0))["v"]))))


def with_reputation(parsed: DataFrame, reputation: DataFrame) -> DataFrame:
    """Parsed reports with the reputation of their source address: is_truth_source, is_allowlisted, is_denylisted, allowlist_value, denylist_value. An unknown
    or absent address has none. The size of the reputation table decides between broadcast and shuffle."""
    known = reputation.groupBy(F.col("reputation_value").alias("__ip")).agg(*(F.max(F.struct(*(F.col(c) for c in ("is_truth_source", "is_allowlisted", "is_denylisted", "allowlist_value", "denylist_value")))).alias("__rep"),))
    flag = lambda c: F.coalesce(F.col(f"__rep.{c}"), F.lit(False)).alias(c)
    joined = parsed.join(known, F.col("arf.source_ip") == F.col("__ip"), "left")
    return joined.select(*parsed.columns, flag("is_truth_source"), flag("is_allowlisted"), flag("is_denylisted"), F.col("__rep.allowlist_value").alias("allowlist_value"), F.col("__rep.denylist_value").alias("denylist_value"))


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with a struct `arf`; null where the message is no report or lacks what a report must have (then `error` says what)."""
    step = df.withColumn("__report", part_of(F.col(raw), "message/feedback-report")).withColumn("__text", part_of(F.col(raw), "text/plain"))
    step = step.withColumn("__original", part_of(F.col(raw), "message/rfc822")).withColumn("__heads", part_of(F.col(raw), "text/rfc822-headers"))
    r = F.col("__report")
    kind, agent = field(r, "Feedback-Type"), field(r, "User-Agent")
    error = (
        F.when(~F.coalesce(is_report(F.col(raw)), F.lit(False)), "not a feedback report").when(boundary(F.col(raw)).isNull(), "no boundary")
        .when(r.isNull(), "no report part").when(kind.isNull(), "no feedback type").when(agent.isNull(), "no user agent")
    )
    arf = F.struct(
        F.lit(True).alias("is_arf"), feedback_type(kind).alias("feedback_type"), F.lower(kind).alias("original_feedback_type"), F.coalesce(field(r, "Version"), F.lit("1")).alias("version"), agent.alias("user_agent"),
        date_of(F.coalesce(field(r, "Arrival-Date"), field(r, "Received-Date"))).alias("arrival_date"), source_ip(field(r, "Source-IP")).alias("source_ip"),
        email_of(field(r, "Original-Mail-From")).alias("original_mail_from"), F.transform(fields(r, "Original-Rcpt-To"), email_of).alias("original_rcpt_to"),
        field(r, "Original-Envelope-Id").alias("original_envelope_id"), fields(r, "Authentication-Results").alias("authentication_results"),
        reporting_mta(field(r, "Reporting-MTA")).alias("reporting_mta"), fields(r, "Reported-Domain").alias("reported_domain"), fields(r, "Reported-URI").alias("reported_uri"),
        F.coalesce(F.regexp_extract(field(r, "Incidents"), r"^\s*(-?\d+)", 1).try_cast("int"), F.lit(1)).alias("incidents"), F.regexp_replace(F.col("__text"), r"^\s+|\s+\z", "").alias("human_readable"),
        F.col("__original").alias("original_message"), header_map(F.coalesce(F.col("__original"), F.col("__heads"))).alias("original_headers"), r.alias("raw_feedback_report"),
    )
    return step.withColumn("error", error).withColumn("arf", F.when(F.col("error").isNull(), arf)).drop("__report", "__text", "__original", "__heads")


def create(
    report_id: Column, kind: Column, agent: Column, ip: Column, mail_from: Column, rcpt: Column, date: Column, text: Column, original: Column,
    mta: Column | None = None, domains: Column | None = None, incidents: Column | None = None, envelope_id: Column | None = None, sender: str = "reports@localhost", to: str = "abuse@localhost",
) -> Column:
    """A raw report; its boundary is a hash of the id, so that equal input gives equal output. Fields that are null are left out."""
    mark = F.concat(F.lit("report_"), F.substring(F.sha2(report_id.cast("string"), 256), 1, 24))
    line = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(name + ": "), v.cast("string"), F.lit("\n"))) if v is not None else F.lit("")
    many = lambda name, v: F.array_join(F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.concat(F.lit(name + ": "), x, F.lit("\n"))), "") if v is not None else F.lit("")
    return F.concat_ws(
        "", F.lit(f"From: <{sender}>\nTo: <{to}>\n"), line("Date", date), F.lit("Subject: Abuse Report\nMIME-Version: 1.0\nContent-Type: multipart/report; report-type=feedback-report; boundary=\""), mark, F.lit('"\n\n--'), mark,
        F.lit("\nContent-Type: text/plain; charset=\"utf-8\"\nContent-Transfer-Encoding: 7bit\n\n"), text, F.lit("\n\n--"), mark, F.lit("\nContent-Type: message/feedback-report\n\n"),
        line("Feedback-Type", kind), line("User-Agent", agent), F.lit("Version: 1\n"), line("Source-IP", ip), line("Original-Mail-From", mail_from), many("Original-Rcpt-To", rcpt),
        line("Original-Envelope-Id", envelope_id), line("Arrival-Date", date), line("Reporting-MTA", mta), many("Reported-Domain", domains), line("Incidents", incidents),
        F.lit("\n--"), mark, F.lit("\nContent-Type: message/rfc822\nContent-Disposition: inline\n\n"), original, F.lit("\n\n--"), mark, F.lit("--\n"),
    )
