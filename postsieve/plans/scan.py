"""The whole scan: mails in, one verdict per mail out. The same plan runs on batch and streaming input.

All that reads a mail's content is one narrow pass. What it finds, and no text but the subject, is then joined with the mail's session,
authentication, reputation and block list, as far as these are given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions import text as T
from postsieve.functions import urls
from postsieve.functions.patterns import let
from postsieve.operators import auth as A
from postsieve.operators import bayes, detect, reputation, rules, sessions, verdict
from postsieve.session import cut_lineage

LINES = "array<struct<key:string,line:string>>"
#: Columns that a mail may have besides message_id, and what they are where it hasn't.
OPTIONAL = {
    "subject": "string", "text": "string", "html": "string", "header_lines": LINES, "attachments": "array<struct<filename:string,content_type:string,content:binary>>",
    "from_address": "string", "reply_to": "string", "to": "array<string>", "message_id_header": "string", "date": "timestamp",
}


@dataclass(frozen=True)
class Config:
    """threshold: points from which rules make a mail spam (0 means 5). as_of: moment that dates are judged by, null for now. The check_ flags switch groups of rules.
    sender_needed: a mail without any sender is not judged by rules, only by the test string. risk: from which on a host is suspicious."""

    threshold: int = 5
    as_of: str | None = None
    check_subject: bool = True
    check_body: bool = True
    check_sender: bool = True
    check_headers: bool = True
    check_links: bool = True
    check_exchange: bool = True
    check_vendor: bool = True
    check_spoofing: bool = True
    macros: bool = True
    arbitrary: bool = True
    sender_needed: bool = True
    risk: float = 0.3
    tokens: Callable[[Column], Column] = T.simple_tokens


def whole(mail: DataFrame) -> DataFrame:
    """mail with all OPTIONAL columns, null where it lacks them."""
    return mail.select("message_id", *(F.col(c) if c in mail.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()))


def first_of(df: DataFrame, order: str) -> DataFrame:
    """One row of each message: the first by order, of equal ones the least by the other columns."""
    cols = [c for c in df.columns if c not in ("message_id", order)]
    return df.groupBy("message_id").agg(F.min(F.struct(order, *cols)).alias("m")).select("message_id", *(F.col(f"m.{c}").alias(c) for c in cols))


def content_findings(mail: DataFrame, config: Config = Config(), category: Callable[[Column], Column] | None = None) -> DataFrame:
    """(message_id, subject, from_address, reply_to, f): all that a mail's own content tells, in one narrow pass. category: classifies tokens."""
    t, h, s, lines = F.col("text"), F.col("html"), F.col("subject"), F.col("header_lines")
    head = lambda name: urls.header(lines, name)
    both = F.concat_ws(" ", F.coalesce(t, F.lit("")), F.coalesce(h, F.lit("")))
    as_of = F.current_timestamp() if config.as_of is None else F.lit(config.as_of).cast("timestamp")
    rich = (F.coalesce(h, F.lit("")) != "") | (F.coalesce(F.size("attachments"), F.lit(0)) > 0)
    links = F.coalesce(F.nullif(h, F.lit("")), t)
    everything = F.concat_ws("", F.coalesce(t, F.lit("")), F.coalesce(h, F.lit("")), F.array_join(F.transform(F.coalesce(lines, F.array().cast(LINES)), lambda x: F.concat(F.lit(" "), x["line"])), ""))
    parts = {
        "phrase": rules.blocked_phrase(s), "subject": rules.subject_rules(s) if config.check_subject else None, "body": rules.content_rules(t, h) if config.check_body else None,
        "headers": rules.header_rules(F.coalesce(F.col("message_id_header"), head("message-id")), F.col("date"), as_of, head("x-mailer"), head("mime-version"), rich, F.size(F.coalesce(F.col("to"), F.array().cast("array<string>")))) if config.check_headers else None,
        "links": rules.link_rules(links) if config.check_links else None, "anchors": rules.anchor_rules(links) if config.check_links else None,
        "session": sessions.for_rules(F.coalesce(F.col("from_address"), F.lit("")), lines), "report": F.coalesce(head("x-forefront-antispam-report"), F.lit("")), "ms_auth": F.coalesce(head("x-ms-exchange-authentication-results"), F.lit("")),
        "type_id": head("x-email-type-id"), "php": head("x-php-script"), "mailer": head("x-mailer"), "auto": rules.auto_reply(head("auto-submitted"), head("x-auto-response-suppress"), head("precedence"), head("list-unsubscribe")),
        "macros": F.size(detect.macro_text(both)) if config.macros else F.lit(0), "gtube": detect.gtube(everything), "dates": F.size(detect.date_findings(both)), "paths": F.size(detect.file_paths(both)),
        "hosts": detect.host_findings(t, F.coalesce(F.nullif(t, F.lit("")), h)), "page_hosts": detect.host_findings(both), "files": detect.attachment_findings(F.col("attachments")),
        "category": category(config.tokens(F.concat_ws(" ", F.coalesce(t, F.lit("")), T.strip_tags(F.coalesce(h, F.lit("")))))) if category else F.lit(None).cast("string"),
    }
    found = F.struct(*(c.alias(k) for k, c in parts.items() if c is not None))
    # explode is a fence: what follows reads the findings more than once and must not repeat the patterns
    return whole(mail).select("message_id", "subject", "from_address", "reply_to", F.explode(F.array(found)).alias("f"))


def findings(
    mail: DataFrame, config: Config = Config(), session: DataFrame | None = None, auth: DataFrame | None = None, known: DataFrame | None = None, blocked: DataFrame | None = None, model: bayes.Model | None = None
) -> DataFrame:
    """(message_id, rules struct<score, reasons, category>, counts of findings by detector, reputation and authentication) of every mail.

    session: one row per message of remote_address, client_hostname, root_client_hostname, envelope_from, rcpt_to, signing_domains, spf_domain, is_allowlisted.
    auth: one row per message of dkim, spf, dmarc, arc. known: the reputation table. blocked(host): the block list. model: a classifier.
    """
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    df = content_findings(mail, config, bayes.categoriser(model) if model is not None else None)
    given = {"remote_address": none, "client_hostname": none, "root_client_hostname": none, "envelope_from": none, "rcpt_to": empty, "signing_domains": empty, "spf_domain": none, "is_allowlisted": F.lit(False)}
    if session is not None:
        df = df.join(session.select("message_id", *given), "message_id", "left")
    else:
        df = df.select("*", *(c.alias(k) for k, c in given.items()))
    results = ("dkim", "spf", "dmarc", "arc")
    df = df.join(auth.select("message_id", *results), "message_id", "left") if auth is not None else df.select("*", *(none.alias(k) for k in results))
    sender = F.coalesce(F.nullif("from_address", F.lit("")), F.nullif("envelope_from", F.lit("")))
    client, root = F.coalesce("client_hostname", "f.session.client_host"), F.coalesce("root_client_hostname", "f.session.root_client_host")
    domain = urls.host_of_address(F.lower(sender))
    signed = F.coalesce(F.exists("signing_domains", lambda d: (d == domain) | (d == urls.root_domain_rules(domain))), F.lit(False))
    groups = [F.col("f.phrase")]
    if config.check_exchange:
        groups.append(rules.exchange_rules(client, F.col("f.report"), F.col("f.ms_auth")))
    if config.check_vendor:
        groups.append(rules.vendor_rules(sender, F.col("subject"), client, root, F.col("f.type_id"), F.col("spf_domain"), F.col("f.auto")))
    if config.check_spoofing:
        groups.append(rules.spoofing_rules(sender, F.coalesce("rcpt_to", empty), F.col("spf"), signed, F.col("is_allowlisted"), F.col("f.php"), F.col("subject"), F.col("f.mailer"), urls.root_domain_rules(client) == urls.root_domain_rules(domain)))
    groups += [F.col(f"f.{k}") for k, on in (("subject", config.check_subject), ("body", config.check_body)) if on]
    if config.check_sender:
        groups.append(rules.sender_rules(sender, F.col("reply_to")))
    groups += [F.col(f"f.{k}") for k, on in (("headers", config.check_headers), ("links", config.check_links), ("anchors", config.check_links)) if on]
    points = rules.total([F.struct(g["score"].alias("score"), g["reasons"].alias("reasons"), g["category"].alias("category")) for g in groups])
    judged = F.lit(True) if not config.sender_needed else F.coalesce(sender, F.lit("")) != ""
    nothing = F.struct(F.lit(0).alias("score"), empty.alias("reasons"), none.alias("category"))
    spf = F.when(F.col("spf_domain").isNotNull(), F.create_map(F.lower("spf_domain"), F.col("spf")))
    attrs = reputation.checked_values(reputation.aligned_attributes(client, root, F.coalesce("remote_address", "f.session.remote_address"), sender, F.col("reply_to"), F.col("envelope_from"), F.col("signing_domains"), spf), F.col("envelope_from"), F.col("reply_to"))
    risky = lambda hosts: F.filter(hosts, lambda x: x["type"].isNotNull() & (x["risk"] > config.risk))
    over = (config.threshold or 5) if config.arbitrary else None
    out = df.select("message_id", F.explode(F.array(F.when(judged, points).otherwise(nothing))).alias("rules"), attrs.alias("attrs"), *(F.col(f"f.{k}").alias(f"f_{k}") for k in ("category", "hosts", "page_hosts", "files", "macros", "gtube", "dates", "paths")), *results)
    out = out.select(
        "message_id", "rules", "attrs", A.score(*(F.col(k) for k in results)).alias("auth"), F.col("f_category").alias("category"), F.transform("f_hosts", lambda x: x["host"]).alias("hosts"),
        F.size(risky(F.col("f_hosts"))).alias("phishing"), F.coalesce(F.array_max(F.transform("f_page_hosts", lambda x: x["risk"])), F.lit(0.0)).alias("host_risk"),
        (F.col("f_files.executables") + F.col("f_files.archives")).alias("executables"), (F.col("f_macros") + (F.col("f_files.macros") if config.macros else F.lit(0))).alias("macros"), F.col("f_files.viruses").alias("viruses"),
        ((F.lit(0) if over is None else F.when(F.col("rules.score") >= over, 1).otherwise(0)) + (F.lit(0) if over is None else F.when(F.col("f_gtube"), 1).otherwise(0))).alias("arbitrary"), (F.col("f_dates") + F.col("f_paths")).alias("patterns"),
    )
    if known is not None or blocked is not None:
        out = cut_lineage(out)  # narrow rows, read more than once below; the content is not searched again
    if blocked is not None:
        hit = out.select("message_id", F.explode("hosts").alias("host")).join(blocked.select("host").distinct(), "host").groupBy("message_id").agg(F.countDistinct("host").alias("blocked"))
        out = out.join(hit, "message_id", "left").withColumn("phishing", F.col("phishing") + F.coalesce("blocked", F.lit(0))).drop("blocked")
    flags = ("is_truth_source", "is_allowlisted", "is_denylisted")
    if known is not None:
        found = reputation.look_up(out.select("message_id", "attrs").distinct(), known).select("message_id", *flags)
        out = out.join(found, "message_id", "left")
    else:
        out = out.select("*", *(F.lit(False).alias(c) for c in flags))
    return out


def judge(found: DataFrame, config: Config = Config()) -> DataFrame:
    """(message_id, is_spam, message, rule_score, reasons, category, subtype, score, tests) from the findings of each mail."""
    n = lambda k: F.col(k) > 0
    flags = {
        "classification": F.col("category") == "spam", "phishing": n("phishing"), "executables": n("executables"), "macros": n("macros"), "arbitrary": n("arbitrary"), "viruses": n("viruses"),
        "patterns": n("patterns"), "homograph": F.col("host_risk") > config.risk, "denylisted": F.col("is_denylisted"),
    }
    details = verdict.score_details({k: F.col(k) for k in ("phishing", "executables", "macros", "viruses")}, F.col("category"), F.lit(0.5), F.col("auth"), F.col("is_denylisted"), F.col("is_truth_source"), F.col("is_allowlisted"))
    subtype = F.when(F.col("rules.score") >= (config.threshold or 5), F.coalesce(F.lower("rules.category"), F.lit("pattern")))
    return found.select(
        "message_id", verdict.is_spam(flags).alias("is_spam"), verdict.message(flags, F.col("is_truth_source"), F.col("is_allowlisted")).alias("message"), F.col("rules.score").alias("rule_score"),
        F.col("rules.reasons").alias("reasons"), F.col("category"), subtype.alias("subtype"), let(details, lambda d: d).alias("d"),
    ).select("message_id", "is_spam", "message", "rule_score", "reasons", "category", "subtype", F.col("d.score").alias("score"), F.col("d.is_spam").alias("score_spam"), F.col("d.tests").alias("tests"))


def scan(mail: DataFrame, threshold: int = 5, config: Config | None = None, **tables) -> DataFrame:
    """findings and judge in one. tables: session, auth, known, blocked, model, as findings takes them."""
    config = config or Config(threshold=threshold, sender_needed=False, check_sender=False, check_headers=False)
    return judge(findings(mail, config, **tables), config)
