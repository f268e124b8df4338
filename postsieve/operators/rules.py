"""Heuristic rules: every group gives a score, the reasons for it and perhaps a category; a mail's score is their sum.

Each pattern runs once a row: its match is bound by `let` and read by the points and the reason alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions import urls
from postsieve.functions.patterns import java, let, matches
from postsieve.lookups import (
    BLOCKED_PHRASES, BODY_FAMILIES, BULK_MAILERS, EXCHANGE, KEYWORDS, PAYPAL_TYPES, SENDER_PATTERNS, SHORTENERS, SPOOFED_HOSTS, SPOOFED_NAMES,
    SUBJECT_FAMILIES, SUSPICIOUS_TLDS, SYSADMIN_SUBJECTS,
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _none() -> Column:
    return F.lit(None).cast("string")


def result(rules: list[tuple[Column, int, Column | str]], category: str | None = None) -> Column:
    """struct<score, reasons, category> of (condition, points, reason)."""
    reason = lambda r: F.lit(r) if isinstance(r, str) else r
    hits = F.array_compact(F.array(*(F.when(w, F.struct(F.lit(p).alias("p"), reason(r).alias("r"))) for w, p, r in rules)))
    return let(hits, lambda h: F.struct(_sum(h).alias("score"), F.transform(h, lambda x: x["r"]).alias("reasons"), F.when(F.size(h) > 0, F.lit(category)).alias("category")))


def _sum(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda s, x: s + x["p"])


def _one(points: int, reason: Column | str, category: Column | str) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(points).alias("score"), F.array(as_column(reason)).alias("reasons"), as_column(category).alias("category"))


def _nothing() -> Column:
    return F.struct(F.lit(0).alias("score"), F.array().cast("array<string>").alias("reasons"), _none().alias("category"))


def _families(low: Column, patterns: list[str], label: str, most: int | None = None) -> list[tuple[Column, int, Column]]:
    found = [F.regexp_extract(low, java(p), 0) for p in patterns]
    cut = lambda m: m if most is None else F.substring(m, 1, most)
    return [(m != "", 1, F.concat(F.lit(label), cut(m))) for m in found]


def blocked_phrase(subject: Column) -> Column:
    return result([(matches(F.lower(_text(subject)), BLOCKED_PHRASES), 10, "BLOCKED_PHRASE_IN_SUBJECT")], "SPAM")


def subject_rules(subject: Column) -> Column:
    def over(low: Column) -> Column:
        s = _text(subject)
        upper, letters = F.length(F.regexp_replace(s, "[^A-Z]", "")), F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
        return result([
            *_families(low, SUBJECT_FAMILIES, "SUBJECT_SPAM_PATTERN: "),
            ((letters > 10) & (upper.cast("double") / letters > 0.7), 2, "SUBJECT_ALL_CAPS"),
            (F.length(F.regexp_replace(s, "[^!?$]", "")) >= 3, 1, "SUBJECT_EXCESSIVE_PUNCTUATION"),
            (matches(low, r"^(?:re|fw|fwd):") & (F.length(s) < 20), 1, "SUBJECT_FAKE_REPLY"),
        ])

    return let(F.lower(_text(subject)), over)


def _body(low: Column) -> list[tuple[Column, int, Column | str]]:
    return _families(low, BODY_FAMILIES, "BODY_SPAM_PATTERN: ", 50)


def _keywords(low: Column) -> list[tuple[Column, int, str]]:
    return [(low.contains(k), w, f"SPAM_KEYWORD: {k}") for k, w in KEYWORDS.items()]


def _markup(low: Column, page: Column, text: Column) -> list[tuple[Column, int, str]]:
    images = (F.length(page) - F.length(F.replace(page, F.lit("<img"), F.lit("")))) / 4
    return [
        (matches(page, r"color:\s*#fff|color:\s*white|font-size:\s*[01]px"), 3, "HIDDEN_TEXT"),
        ((images > 5) & (F.length(_text(text)) < 100), 2, "IMAGE_HEAVY_LOW_TEXT"),
        (matches(page, r"data:image/[^;]+;base64,"), 1, "BASE64_IMAGES"),
        (matches(low, SHORTENERS), 2, "URL_SHORTENER"),
    ]


def _content(text: Column, html: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(text, F.lit("")), html, F.lit("")))


def body_rules(text: Column, html: Column) -> Column:
    """Patterns, hidden text, images and shorteners; the text, or the page where there is no text, is searched."""
    return let(_content(text, html), lambda low: let(F.lower(_text(html)), lambda page: result([*_body(low), *_markup(low, page, text)])))


def keyword_rules(text: Column) -> Column:
    return let(F.lower(_text(text)), lambda low: result(_keywords(low)))


def content_rules(text: Column, html: Column) -> Column:
    """body_rules and keyword_rules over one lower-case copy of the content, reasons in the order patterns, keywords, markup."""
    return let(_content(text, html), lambda low: let(F.lower(_text(html)), lambda page: result([*_body(low), *_keywords(low), *_markup(low, page, text)])))


def sender_rules(from_: Column, reply_to: Column) -> Column:
    def over(low: Column) -> Column:
        reply = F.lower(_text(reply_to))
        tld = F.regexp_extract(_text(from_), r"@[^.]+\.([A-Za-z]+)\z", 1)
        second = lambda a: F.split_part(a, F.lit("@"), F.lit(2))
        there = low != ""
        return result([
            (~there, 2, "MISSING_FROM"),
            (there & reduce(lambda a, b: a | b, (matches(low, p) for p in SENDER_PATTERNS)), 2, "SUSPICIOUS_SENDER_PATTERN"),
            (there & F.lower(tld).isin(*SUSPICIOUS_TLDS), 2, F.concat(F.lit("SUSPICIOUS_TLD: "), tld)),
            (there & (second(low) != "") & (second(reply) != "") & (second(low) != second(reply)), 2, "FROM_REPLY_TO_MISMATCH"),
            (there & matches(low, SPOOFED_NAMES) & ~matches(low, SPOOFED_HOSTS), 3, "DISPLAY_NAME_SPOOFING"),
        ])

    return let(F.lower(_text(from_)), over)


def header_rules(message_id: Column, date: Column, as_of: Column, mailer: Column, mime_version: Column, rich: Column, recipients: Column) -> Column:
    """as_of: the moment to judge dates by. rich: whether the mail has HTML or attachments."""
    age = F.unix_seconds(as_of) - F.unix_seconds(date.cast("timestamp"))
    return result([
        (_text(message_id) == "", 1, "MISSING_MESSAGE_ID"),
        (F.coalesce(age < -24 * 3600, F.lit(False)), 2, "FUTURE_DATE"),
        (F.coalesce(age > 365 * 86400, F.lit(False)), 1, "VERY_OLD_DATE"),
        (date.isNull(), 1, "MISSING_DATE"),
        (matches(F.lower(_text(mailer)), BULK_MAILERS), 1, "SUSPICIOUS_MAILER"),
        ((_text(mime_version) == "") & F.coalesce(rich, F.lit(False)), 1, "MISSING_MIME_VERSION"),
        (F.coalesce(recipients, F.lit(0)) > 50, 2, "EXCESSIVE_RECIPIENTS"),
    ])


#: The authority of a URL that can be read: perhaps user data, a host without signs that no host has, a port.
_AUTHORITY = r"(?i)^https?://(?:[^/?#@\\]*@)?(?:\[[0-9a-f:.]+\]|[^\s/?#@:\[\]<>^|%\\]+)(?::\d{0,5})?(?:[/?#\\]|\z)"


def link_rules(content: Column) -> Column:
    """Each kind of suspicious link counts once (a suspicious top-level domain once per domain), in the order of the links."""

    def kinds(u: Column) -> Column:
        host, port = urls.host_of(u), F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?[^/?#:]+:(\d+)", 1)
        tld = F.substring_index(host, ".", -1)
        bad = ~u.rlike(_AUTHORITY) | F.coalesce(F.nullif(port, F.lit("")).try_cast("int") > 65535, F.lit(False))
        return F.when(bad, F.array(F.lit("INVALID_URL"))).otherwise(F.array_compact(F.array(
            F.when(host.rlike(r"^(?:\d+\.){3}\d+\z"), "IP_ADDRESS_URL"),
            F.when(tld.isin(*SUSPICIOUS_TLDS), F.concat(F.lit("SUSPICIOUS_URL_TLD: "), tld)),
            F.when(~port.isin("", "80", "443"), "URL_WITH_PORT"),
            F.when(F.length(u) > 200, "VERY_LONG_URL"),
            F.when(F.size(F.split(host, r"\.")) - 2 > 3, "EXCESSIVE_SUBDOMAINS"),
            F.when(u.rlike(r"(?i)%[\da-f]{2}.*%[\da-f]{2}"), "URL_OBFUSCATION"),
        )))

    found = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(_text(content), F.lit(urls.URL), 0), kinds)))
    return let(found, lambda r: F.struct(F.size(r).alias("score"), r.alias("reasons"), _none().alias("category")))


def anchor_rules(html: Column) -> Column:
    """A link whose visible text is a URL of another host."""
    p = r"(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([^<]+)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(_text(html), F.lit(p), 1).alias("href"), F.regexp_extract_all(_text(html), F.lit(p), 2).alias("text"))
    host = urls.host_of
    differs = F.exists(pairs, lambda x: x["text"].rlike(r"(?i)^https?://") & (host(x["text"]) != "") & (host(x["href"]) != "") & (host(x["text"]) != host(x["href"])))
    return result([(differs, 3, "LINK_TEXT_URL_MISMATCH")])


def exchange_rules(client_host: Column, report: Column, authentication: Column) -> Column:
    """The first verdict of a mail exchanger that applies. Failed authentication counts only if nothing passed and the report, if there is one,
    doesn't clear the mail (SFV:NSPM, or a spam level of 2 at most)."""

    def over(x: Column) -> Column:
        rep, auth = x["rep"], x["auth"]
        here = _text(client_host).endswith(".outbound.protection.outlook.com")
        which = lambda kind: F.coalesce(*(F.when(rep.contains(c), F.lit(c.upper())) for c in EXCHANGE[kind]))
        passed = auth.contains("spf=pass") | auth.contains("dkim=pass") | auth.contains("dmarc=pass")
        failed = auth.contains("spf=fail") | auth.contains("dkim=fail") | auth.contains("dmarc=fail")
        scl = F.regexp_extract(rep, r"scl:(\d+)", 1).try_cast("int")
        cleared = rep.contains("sfv:nspm") | F.coalesce(scl <= 2, F.lit(False))
        named = lambda label, kind: F.concat(F.lit(label + ": "), which(kind))
        high, spoof = which("high"), which("spoof")
        return (
            F.when(~here, _nothing())
            .when(~cleared & failed & ~passed, _one(10, "MS_EXCHANGE_AUTH_FAILURE", "AUTHENTICATION_FAILURE"))
            .when(high.isNotNull(), _one(15, named("MS_HIGH_CONFIDENCE_THREAT", "high"), F.when(high.contains("MALW"), "MALWARE").when(high.contains("PHISH") | high.contains("PHSH"), "PHISHING").otherwise("HIGH_CONFIDENCE_SPAM")))
            .when(which("impersonation").isNotNull(), _one(12, named("MS_IMPERSONATION", "impersonation"), "IMPERSONATION"))
            .when(spoof.isNotNull(), _one(12, named("MS_PHISHING_SPOOF", "spoof"), F.when(spoof.contains("PHSH"), "PHISHING").otherwise("SPOOFING")))
            .when(which("verdict").isNotNull(), _one(10, named("MS_SPAM_VERDICT", "verdict"), "SPAM"))
            .when(which("spam").isNotNull(), _one(10, named("MS_SPAM_CATEGORY", "spam"), "SPAM"))
            .when(scl >= 5, _one(8, F.concat(F.lit("MS_HIGH_SCL: "), scl.cast("string")), "SPAM"))
            .otherwise(_nothing())
        )

    return let(F.struct(F.lower(_text(report)).alias("rep"), F.lower(_text(authentication)).alias("auth")), over)


def vendor_rules(from_: Column, subject: Column, client_host: Column, root_client: Column, type_id: Column, spf_domain: Column, auto_reply: Column) -> Column:
    """The first vendor rule that applies."""

    def over(low: Column) -> Column:
        subj, root, client, spf = _text(subject), _text(root_client), _text(client_host), _text(spf_domain)
        mine = urls.root_domain_rules(urls.host_of_address(low))
        bounce = (low == "postmaster@outlook.com") | client.endswith(".outbound.protection.outlook.com") | (low.startswith("postmaster@") & low.endswith(".onmicrosoft.com"))
        return (
            F.when((mine == "paypal.com") & F.coalesce(type_id.isin(*PAYPAL_TYPES), F.lit(False)), _one(15, F.concat(F.lit("PAYPAL_INVOICE_SPAM: "), type_id), "VENDOR_SPAM"))
            .when((low == "invoice@authorize.net") & (root == "visa.com"), _one(15, "AUTHORIZE_VISA_PHISHING", "PHISHING"))
            .when(low.contains("amazon.co.jp") & ~root.startswith("amazon."), _one(12, "AMAZON_JP_IMPERSONATION", "IMPERSONATION"))
            .when(subj.contains("pCloud") & (mine != "pcloud.com") & low.contains("pcloud"), _one(12, "PCLOUD_IMPERSONATION", "IMPERSONATION"))
            .when(bounce & F.coalesce(auto_reply, F.lit(False)) & (subj.startswith("Undeliverable: ") | subj.startswith("No se puede entregar: ")), _one(10, "MS_BOUNCE_SPAM", "BOUNCE_SPAM"))
            .when((low == "postmaster@163.com") & subj.contains("系统退信"), _one(10, "163_BOUNCE_SPAM", "BOUNCE_SPAM"))
            .when((low == "dse_na4@docusign.net") & (spf.endswith(".onmicrosoft.com") | (spf == "onmicrosoft.com")), _one(12, "DOCUSIGN_MS_SCAM", "PHISHING"))
            .otherwise(_nothing())
        )

    return let(F.lower(_text(from_)), over)


def spoofing_rules(from_: Column, recipients: Column, spf: Column, signed: Column, allowlisted: Column, php_script: Column, subject: Column, mailer: Column | None = None, same_host: Column | None = None) -> Column:
    """A sender that claims the recipients' own domain without any proof of it. signed: whether an aligned signature passed. same_host: whether the
    client is a host of the sender's domain."""

    def over(root: Column) -> Column:
        yes = lambda c: F.coalesce(c, F.lit(False))
        tool = F.lower(_text(mailer)) if mailer is not None else F.lit("")
        same = yes(F.exists(recipients, lambda r: urls.root_domain_rules(urls.host_of_address(F.lower(r))) == root))
        proof = (_text(spf) == "pass") | yes(signed) | yes(allowlisted) | (yes(same_host) if same_host is not None else F.lit(False))
        harmless = (_text(php_script) != "") | tool.contains("php") | tool.contains("drupal") | matches(F.lower(_text(subject)), SYSADMIN_SUBJECTS)
        return result([((root != "") & same & ~proof & ~harmless, 12, "SPOOFING_ATTACK")], "SPOOFING")

    return let(urls.root_domain_rules(urls.host_of_address(F.lower(_text(from_)))), over)


def auto_reply(submitted: Column, suppress: Column, precedence: Column, unsubscribe: Column) -> Column:
    return (~_text(submitted).isin("", "no")) | (_text(suppress) != "") | F.lower(_text(precedence)).isin("bulk", "auto_reply", "list", "junk") | (_text(unsubscribe) != "")


def total(groups: list[Column]) -> Column:
    """struct<score, reasons, category> over groups of rules, in their order; the last group with a category names it."""
    return F.struct(
        reduce(lambda a, b: a + b, (g["score"] for g in groups)).alias("score"), F.concat(*(g["reasons"] for g in groups)).alias("reasons"),
        F.coalesce(*(g["category"] for g in reversed(groups))).alias("category"),
    )
