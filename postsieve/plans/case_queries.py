"""Queries over hand-written cases, for operators whose input no table holds: headers, pages, attachments, raw messages.

Each has its input rows and, written out one by one, the result that the described behaviour asks for; the SQL is just that result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions import idn, stem, text, urls
from postsieve.operators import arf, auth, detect, reputation, rules, sessions, verdict
from postsieve.plans.queries import q, query
from postsieve.sources import mime


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return q(v).replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") if isinstance(v, str) else str(v)


def cases(name: str, columns: str, schema: str, rows: list[tuple], made: Callable[[], dict[str, Callable[[], Column]]], want: list[tuple], types: dict[str, str] | None = None, table=None) -> None:
    """Register a query over rows of (case, ...): the columns that `made` gives, by case; columns are their names. want: (case, value, ...) in their order.
    types: SQL types of null columns. Nothing is made before the query runs, as that needs a session."""
    cols = ["case_no", *columns.split()]
    typed = ", ".join(f"CAST({c} AS {types[c]}) AS {c}" if types and c in types else c for c in cols)
    sql = f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in want)}) AS t({', '.join(cols)})"

    def run(spark, d):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "case_no int, " + schema)
        df = table(df) if table else df
        return df.select("case_no", *(f().alias(k) for k, f in made().items()))

    query(sql, name)(run)


def _first(r: Column) -> dict[str, Callable[[], Column]]:
    return {"score": lambda: r["score"], "reasons": lambda: F.array_join(r["reasons"], ";"), "category": lambda: r["category"]}


c = F.col
OUT = "x1.outbound.protection.outlook.com"
cases(
    "rule_exchange", "score reasons category", "host string, report string, auth string",
    [
        ("mail.example", "CAT:MALW", "spf=fail"), (OUT, "CIP:1.2.3.4;SCL:9;CAT:MALW", None), (OUT, "SFV:NSPM;CAT:HPHSH", "spf=fail"), (OUT, "SCL:6;SFV:SPM;CAT:NONE", "spf=fail dkim=none dmarc=fail"), (OUT, "SCL:6;SFV:SPM", "spf=fail; dkim=pass"),
        (OUT, "SCL:1;CAT:BIMP", "spf=fail"), (OUT, "CAT:SPOOF;SCL:3", None), (OUT, "CAT:PHSH", None), (OUT, "SFV:SKB", None), (OUT, "CAT:OSPM", None), (OUT, "SCL:7", None), (OUT, "SCL:4", None), (OUT, None, "dmarc=fail"), (OUT, None, "spf=softfail"), (None, None, None), (OUT, "CAT:HSPM", None),
    ],
    lambda: _first(rules.exchange_rules(c("host"), c("report"), c("auth"))),
    [
        (1, 0, "", None), (2, 15, "MS_HIGH_CONFIDENCE_THREAT: CAT:MALW", "MALWARE"), (3, 15, "MS_HIGH_CONFIDENCE_THREAT: CAT:HPHSH", "PHISHING"), (4, 10, "MS_EXCHANGE_AUTH_FAILURE", "AUTHENTICATION_FAILURE"), (5, 10, "MS_SPAM_VERDICT: SFV:SPM", "SPAM"),
        (6, 12, "MS_IMPERSONATION: CAT:BIMP", "IMPERSONATION"), (7, 12, "MS_PHISHING_SPOOF: CAT:SPOOF", "SPOOFING"), (8, 12, "MS_PHISHING_SPOOF: CAT:PHSH", "PHISHING"), (9, 10, "MS_SPAM_VERDICT: SFV:SKB", "SPAM"), (10, 10, "MS_SPAM_CATEGORY: CAT:OSPM", "SPAM"), (11, 8, "MS_HIGH_SCL: 7", "SPAM"), (12, 0, "", None), (13, 10, "MS_EXCHANGE_AUTH_FAILURE", "AUTHENTICATION_FAILURE"), (14, 0, "", None), (15, 0, "", None), (16, 15, "MS_HIGH_CONFIDENCE_THREAT: CAT:HSPM", "HIGH_CONFIDENCE_SPAM"),
    ],
)
cases(
    "rule_vendor", "score reasons category", "f string, s string, host string, root string, kind string, spf string, auto boolean",
    [
        ("service@paypal.com", "Invoice", None, None, "RT000238", None, False), ("service@paypal.com", "Invoice", None, None, "PPX1", None, False), ("invoice@authorize.net", "", "a.visa.com", "visa.com", None, None, False), ("x@amazon.co.jp", "", "h.evil.example", "evil.example", None, None, False),
        ("x@amazon.co.jp", "", "h.amazon.com", "amazon.com", None, None, False), ("pcloud@evil.example", "Your pCloud space", None, None, None, None, False), ("a@pcloud.com", "Your pCloud space", None, None, None, None, False), ("postmaster@outlook.com", "Undeliverable: hi", None, None, None, None, True),
        ("postmaster@t.onmicrosoft.com", "No se puede entregar: x", None, None, None, None, True), ("bob@x.example", "Undeliverable: hi", OUT, None, None, None, True), ("postmaster@outlook.com", "Undeliverable: hi", None, None, None, None, False), ("postmaster@163.com", "系统退信/x", None, None, None, None, False),
        ("DSE_na4@docusign.net", "", None, None, None, "t.onmicrosoft.com", False), (None, None, None, None, None, None, None),
    ],
    lambda: _first(rules.vendor_rules(c("f"), c("s"), c("host"), c("root"), c("kind"), c("spf"), c("auto"))),
    [
        (1, 15, "PAYPAL_INVOICE_SPAM: RT000238", "VENDOR_SPAM"), (2, 0, "", None), (3, 15, "AUTHORIZE_VISA_PHISHING", "PHISHING"), (4, 12, "AMAZON_JP_IMPERSONATION", "IMPERSONATION"), (5, 0, "", None), (6, 12, "PCLOUD_IMPERSONATION", "IMPERSONATION"), (7, 0, "", None), (8, 10, "MS_BOUNCE_SPAM", "BOUNCE_SPAM"),
        (9, 10, "MS_BOUNCE_SPAM", "BOUNCE_SPAM"), (10, 10, "MS_BOUNCE_SPAM", "BOUNCE_SPAM"), (11, 0, "", None), (12, 10, "163_BOUNCE_SPAM", "BOUNCE_SPAM"), (13, 12, "DOCUSIGN_MS_SCAM", "PHISHING"), (14, 0, "", None),
    ],
)
cases(
    "rule_headers", "score reasons", "id string, day string, mailer string, mime string, rich boolean, n int",
    [("<a>", "2024-01-01 00:00:00", None, "1.0", True, 3), (None, None, "Mass Mail 2", None, True, 51), ("<a>", "2024-01-03 01:00:00", None, None, False, 50), ("<a>", "2024-01-02 20:00:00", "Outlook", "1.0", False, 0), ("", "2022-12-31 00:00:00", None, "1.0", None, None)],
    lambda: {k: v for k, v in _first(rules.header_rules(c("id"), c("day").cast("timestamp"), F.lit("2024-01-02 00:00:00").cast("timestamp"), c("mailer"), c("mime"), c("rich"), c("n"))).items() if k != "category"},
    [(1, 0, ""), (2, 6, "MISSING_MESSAGE_ID;MISSING_DATE;SUSPICIOUS_MAILER;MISSING_MIME_VERSION;EXCESSIVE_RECIPIENTS"), (3, 2, "FUTURE_DATE"), (4, 0, ""), (5, 2, "MISSING_MESSAGE_ID;VERY_OLD_DATE")],
)
cases(
    "rule_markup", "score reasons", "t string, h string",
    [("hi", "<p style='color: #FFF'>x</p>"), ("short", "<img><IMG><img><img><img><img>"), ("x" * 100, "<img><img><img><img><img><img>"), (None, "<img src='data:image/png;base64,AAAA'> claim your prize"), ("see bit.ly/x and act now", None), (None, None), ("", "font-size: 1px")],
    lambda: {k: v for k, v in _first(rules.body_rules(c("t"), c("h"))).items() if k != "category"},
    [(1, 3, "HIDDEN_TEXT"), (2, 2, "IMAGE_HEAVY_LOW_TEXT"), (3, 0, ""), (4, 2, "BODY_SPAM_PATTERN: claim your prize;BASE64_IMAGES"), (5, 3, "BODY_SPAM_PATTERN: act now;URL_SHORTENER"), (6, 0, ""), (7, 3, "HIDDEN_TEXT")],
)
cases(
    "rule_anchors", "score", "h string",
    [('<a href="http://evil.example/x">https://bank.example</a>',), ("<A class=q HREF='HTTP://Bank.example/1'>HTTPS://bank.EXAMPLE/2</A>",), ('<a href="http://evil.example">click here</a>',), ('<a href="mailto:a@b">http://b.example</a>',), (None,)],
    lambda: {"score": lambda: rules.anchor_rules(c("h"))["score"]}, [(1, 3), (2, 0), (3, 0), (4, 0), (5, 0)],
)
cases(
    "rule_link_kinds", "score reasons", "t string",
    [("http://10.0.0.1:8080/x",), ("HTTP://a.b.c.d.e.example/",), ("https://x.tk/ https://y.TK/ https://z.top",), ("http://bad:port/ and http://ok.example:80/",), ("http://x.example/%41%42 https://x.example:99999/",), ("http://u:p@host.example/" + "a" * 200,), ("no links", ), (None,), ("http://[::1]:81/ http://a|b/",)],
    lambda: {"score": lambda: rules.link_rules(c("t"))["score"], "reasons": lambda: F.array_join(rules.link_rules(c("t"))["reasons"], ";")},
    [(1, 2, "IP_ADDRESS_URL;URL_WITH_PORT"), (2, 1, "EXCESSIVE_SUBDOMAINS"), (3, 2, "SUSPICIOUS_URL_TLD: tk;SUSPICIOUS_URL_TLD: top"), (4, 1, "INVALID_URL"), (5, 2, "URL_OBFUSCATION;INVALID_URL"), (6, 1, "VERY_LONG_URL"), (7, 0, ""), (8, 0, ""), (9, 1, "INVALID_URL")],
)
cases(
    "rule_sender_kinds", "score reasons", "f string, r string",
    [(None, None), ("bob12345@x.example", "bob@x.example"), ("a@shop.xyz", "a@other.example"), ("PayPal Support <x@evil.example>", None), ("service@paypal.com", None), ("bank@bank.example", None), ("x@192.168.1.1", ""), ("abc@mail.ru", "abc@MAIL.ru")],
    lambda: {k: v for k, v in _first(rules.sender_rules(c("f"), c("r"))).items() if k != "category"},
    [(1, 2, "MISSING_FROM"), (2, 2, "SUSPICIOUS_SENDER_PATTERN"), (3, 4, "SUSPICIOUS_TLD: xyz;FROM_REPLY_TO_MISMATCH"), (4, 3, "DISPLAY_NAME_SPOOFING"), (5, 0, ""), (6, 3, "DISPLAY_NAME_SPOOFING"), (7, 2, "SUSPICIOUS_SENDER_PATTERN"), (8, 2, "SUSPICIOUS_SENDER_PATTERN")],
)
cases(
    "rule_auto_reply", "auto", "a string, b string, p string, u string",
    [("auto-replied", None, None, None), ("no", None, None, None), (None, "All", None, None), (None, None, "Bulk", None), (None, None, "first-class", None), (None, None, None, "<mailto:x>"), (None, None, None, None)],
    lambda: {"auto": lambda: rules.auto_reply(c("a"), c("b"), c("p"), c("u"))}, [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True), (7, False)],
)

_LINES = "lines array<struct<key:string,line:string>>"
_RECEIVED = [{"key": "received", "line": "Received: from Mail.Client.co.in (x [198.51.100.7])\n by mx"}, {"key": "received", "line": "Received: from second.example ([203.0.113.9])"}]
_V6 = [{"key": "Received", "line": "Received: from v6.example ([2001:db8::7])"}, {"key": "from", "line": "From: a@b.example"}]
cases(
    "received_headers", "host ip", _LINES, [(_RECEIVED,), (_V6,), ([],), (None,), ([{"key": "received", "line": "Received: by mx without origin"}],)],
    lambda: {"host": lambda: urls.received_host(urls.header(c("lines"), "received")), "ip": lambda: urls.received_ip(urls.header(c("lines"), "received"))},
    [(1, "mail.client.co.in", "198.51.100.7"), (2, "v6.example", "2001:db8::7"), (3, None, None), (4, None, None), (5, None, None)],
)


def _session(s: Column, *names: str) -> dict[str, Callable[[], Column]]:
    return {n: (lambda n=n: s[n]) for n in names}


cases(
    "session_of_rules", "from_address from_domain from_root client_host root_client_host remote_address", f"f string, host string, ip string, {_LINES}",
    [("A@Sub.Shop.co.uk", None, None, _RECEIVED), ("a@x.example", "Given.Host", "192.0.2.1", _RECEIVED), (None, None, None, None)],
    lambda: _session(sessions.for_rules(c("f"), c("lines"), c("host"), c("ip")), "from_address", "from_domain", "from_root", "client_host", "root_client_host", "remote_address"),
    [(1, "a@sub.shop.co.uk", "sub.shop.co.uk", "shop.co.uk", "mail.client.co.in", "client.co.in", "198.51.100.7"), (2, "a@x.example", "x.example", "x.example", "Given.Host", None, "192.0.2.1"), (3, None, None, None, None, None, None)],
)
cases(
    "session_of_attributes", "from_address from_root client_host root_client_host mail_from rcpt", f"f string, t array<string>, cc array<string>, host string, {_LINES}",
    [("SRS0=ab=cd=shop.org.uk=amy@fwd.example", ["Bo <bo@y.example>, cy@z.example"], None, None, _RECEIVED), ("a@x.example", None, ["d@w.example"], "h.net.au", None)],
    lambda: {**_session(sessions.for_attributes(c("f"), c("t"), c("cc"), c("lines"), c("host")), "from_address", "from_root", "client_host", "root_client_host", "mail_from"), "rcpt": lambda: F.array_join(sessions.for_attributes(c("f"), c("t"), c("cc"), c("lines"), c("host"))["rcpt_to"], ",")},
    [(1, "amy@shop.org.uk", "shop.org.uk", "mail.client.co.in", "client.co.in", "amy@shop.org.uk", "bo@y.example,cy@z.example"), (2, "a@x.example", "x.example", "h.net.au", "h.net.au", "a@x.example", "d@w.example")],
)
cases(
    "addresses_and_domains", "all_of host_only host_or_self", "v string",
    [("Amy <A@B.example>, c.d+e@f-g.example",), ("Host.Example",), ("x@Y.example@z",), ("",), (None,)],
    lambda: {"all_of": lambda: F.array_join(urls.addresses(c("v")), ","), "host_only": lambda: urls.host_of_address(c("v")), "host_or_self": lambda: urls.host_of_address_or_domain(c("v"))},
    [(1, "a@b.example,c.d+e@f-g.example", "b.example>, c.d+e@f-g.example", "b.example>, c.d+e@f-g.example"), (2, "", "", "host.example"), (3, "x@y.example", "y.example@z", "y.example@z"), (4, "", "", ""), (5, "", "", None)],
)
cases(
    "srs_kinds", "plain", "a string",
    [("SRS0=H1=T1=example.com=alice@fwd.example",), ("srs0=h=t=Example.com=Bob@fwd.example",), ("SRS1=H2=first.example==H1=T1=example.com=carol@second.example",), ("plain@x.example",), ("SRS0=broken@x.example",), (None,)],
    lambda: {"plain": lambda: urls.undo_srs(c("a"))}, [(1, "alice@example.com"), (2, "Bob@Example.com"), (3, "carol@example.com"), (4, "plain@x.example"), (5, "SRS0=broken@x.example"), (6, None)],
)
cases(
    "suffix_kinds", "domain sld suffix subdomain is_ip is_icann is_private", "h string",
    [("a.b.example.co.uk",), ("Example.COM",), ("com",), ("10.0.0.1",), ("me.github.io",), ("x.me.github.io",), ("github.io",), ("2001:db8::1",), (None,)],
    lambda: {k: (lambda k=k: urls.public_suffix(c("h"))[k]) for k in ("domain", "sld", "suffix", "subdomain", "is_ip", "is_icann", "is_private")},
    [(1, "example.co.uk", "example", "co.uk", "a.b", False, True, False), (2, "example.com", "example", "com", "", False, True, False), (3, None, None, "com", None, False, True, False), (4, None, None, None, None, True, False, False), (5, "me.github.io", "me", "github.io", "", False, False, True), (6, "me.github.io", "me", "github.io", "x", False, False, True), (7, None, None, "github.io", None, False, False, True), (8, None, None, None, None, True, False, False), (9, None, None, None, None, None, None, None)],
)
cases(
    "url_forms", "plain with_fragment", "u string",
    [("HTTP://Example.COM:80/a/?b=2&utm_source=x&a=1#top",), ("https://x.example:443/",), ("https://x.example:8443/p?",), ("http://www.x.example/Path",)],
    lambda: {"plain": lambda: urls.normalise_url(c("u")), "with_fragment": lambda: urls.normalise_url(c("u"), False)},
    [(1, "http://example.com/a?a=1&b=2", "http://example.com/a?a=1&b=2#top"), (2, "https://x.example", "https://x.example"), (3, "https://x.example:8443/p", "https://x.example:8443/p"), (4, "http://www.x.example/Path", "http://www.x.example/Path")],
)
cases(
    "all_text_links", "links", f"t string, h string, {_LINES}",
    [("see https://a.example.", "<a href='https://b.example/'>x</a>", [{"key": "list-help", "line": "List-Help: <https://c.example/h>"}]), (None, None, None)],
    lambda: {"links": lambda: F.array_join(urls.urls(urls.all_text(c("t"), c("h"), c("lines"))), " ")}, [(1, "https://a.example https://b.example https://c.example/h"), (2, "")],
)

cases(
    "executable_bytes", "kind", "x string",
    [("4D5A90000300",), ("7F454C46020101",), ("CAFEBABE00000034",), ("0061736D01000000",), ("504B0304",), ("23212F62696E2F7368",), ("4C0000000114020000",), ("",), (None,)],
    lambda: {"kind": lambda: detect.executable_by_content(F.unhex(c("x")))}, [(1, "exe"), (2, "elf"), (3, "class"), (4, "wasm"), (5, None), (6, None), (7, "lnk"), (8, None), (9, None)],
)
_FILES = "files array<struct<filename:string,content_type:string,content:binary>>"
_file = lambda n, b=b"x": {"filename": n, "content_type": "application/octet-stream", "content": b}
cases(
    "attachments", "executables archives macros viruses", _FILES,
    [([_file("run.EXE", b"MZ.."), _file("a.docm")],), ([_file("x.cab"), _file("y.zip"), _file("z.docx")],), ([_file("r.pdf", b"%PDF-1.7 /JavaScript (x)"), _file("s.pdf", b"%PDF-1.7")],), ([_file(None, b"MZ"), _file("note.txt", b"X5O!P EICAR-STANDARD-ANTIVIRUS-TEST-FILE!")],), ([],), (None,), ([_file("old.doc"), _file("t.vbs")],)],
    lambda: {k: (lambda k=k: detect.attachment_findings(c("files"))[k]) for k in ("executables", "archives", "macros", "viruses")},
    [(1, 2, 0, 1, 0), (2, 1, 2, 0, 0), (3, 0, 0, 1, 0), (4, 1, 0, 0, 1), (5, 0, 0, 0, 0), (6, 0, 0, 0, 0), (7, 1, 0, 2, 0)],
)
cases(
    "macro_names", "kind ext", "n string",
    [("a.vbs",), ("b.PS1",), ("c.docm",), ("d.potm",), ("e.doc",), ("f.ppa",), ("g.docx",), ("noext",), (None,)],
    lambda: {"kind": lambda: detect.macro_by_name(c("n")), "ext": lambda: detect.extension(c("n"))}, [(1, "script", "vbs"), (2, "script", "ps1"), (3, "office_document", "docm"), (4, "office_document", "potm"), (5, "legacy_office", "doc"), (6, "legacy_office", "ppa"), (7, None, "docx"), (8, None, ""), (9, None, None)],
)

cases(
    "homograph_risk", "risk first_advice confidence", "h string, t string, shown boolean, rep double",
    [("google.com", "", False, None), ("www.google.com", "", False, None), ("example.com", None, False, None), ("xn--fiqs8s", "urgent", True, 0.1), ("x.example", "URGENT: suspended, click here", False, None), ("x.example", "", True, None), ("x.example", "", False, 0.4), ("x.example", "", False, 0.0), ("pаypal.com", "", False, None), ("xn--pypal-4ve.com", "", False, None), ("goog1e.net", "", False, 0.5)],
    lambda: {"risk": lambda: F.round(idn.risk(c("h"), c("t"), c("shown"), c("rep")), 6), "first_advice": lambda: F.get(idn.recommendations(idn.risk(c("h"), c("t"), c("shown"), c("rep")), c("h")), F.lit(0)), "confidence": lambda: F.round(idn.confidence(idn.risk(c("h"), c("t"), c("shown"), c("rep")), c("h")), 6)},
    [
        (1, 0.7, "MEDIUM RISK: Suspicious domain - flag for review", 0.7), (2, 0.0, "SAFE: Domain appears legitimate", 0.0), (3, 0.0, "SAFE: Domain appears legitimate", 0.0), (4, 0.0, "SAFE: Domain appears legitimate", 1.0), (5, 0.3, "LOW RISK: Monitor domain activity", 0.3), (6, 0.3, "SAFE: Domain appears legitimate", 0.3), (7, 0.2, "SAFE: Domain appears legitimate", 0.2), (8, 0.0, "SAFE: Domain appears legitimate", 0.0),
        (9, 1.48, "HIGH RISK: Likely homograph attack - block or quarantine", 1.0), (10, 0.3, "SAFE: Domain appears legitimate", 0.3), (11, 0.583333, "LOW RISK: Monitor domain activity", 0.583333),
    ],
    {"risk": "DOUBLE", "confidence": "DOUBLE"},
)
cases(
    "homograph_factors", "factors", "h string, t string, shown boolean",
    [("pаypal.com", "verify your account", True), ("example.com", "", False), ("xn--x", "", False)],
    lambda: {"factors": lambda: F.array_join(idn.risk_factors(c("h"), c("t"), c("shown")), " | ")},
    [(1, "Contains non-ASCII characters | Confusable character: а → a | 1/10 characters are confusable | High similarity to paypal: 100.0% | Mixed scripts detected: Latin, Cyrillic | Suspicious Latin/Cyrillic or Latin/Greek mixing | Display text differs from actual domain | Suspicious email pattern: verify.*account"), (2, ""), (3, "Contains non-ASCII characters | Punycode decoded: xn--x")],
)
cases(
    "confusables", "plain n scripts", "h string",
    [("ɡoogle",), ("аррӏе",), ("𝐚𝐛𝟎ℓⅳ",), ("plain",), ("",)],
    lambda: {"plain": lambda: idn.unconfuse(c("h")), "n": lambda: idn.confusable_count(c("h")), "scripts": lambda: F.array_join(idn.scripts(c("h")), ",")}, [(1, "ɡoogle", 0, "Latin"), (2, "appӏe", 4, "Cyrillic"), (3, "ab0liv", 5, ""), (4, "plain", 0, "Latin"), (5, "", 0, "")],
)

cases(
    "score_details", "score is_spam tests", "category string, p double, phishing int, executables int, macros int, viruses int, auth_score int, denied boolean, truth boolean, allowed boolean",
    [("spam", 0.5, 1, 0, 0, 0, None, False, False, False), ("spam", 0.9, 0, 0, 1, 0, 3, False, False, False), ("ham", 0.95, 0, 0, 0, 0, -5, False, False, False), ("ham", 0.5, 2, 0, 0, 0, 0, False, False, True), ("ham", 0.5, 0, 1, 0, 0, 0, False, True, True), (None, None, 0, 0, 0, 0, 0, True, True, False), ("ham", 0.5, 0, 0, 0, 1, 0, None, None, None)],
    lambda: {
        k: (lambda k=k: (lambda s: F.array_join(s[k], ",") if k == "tests" else F.round(s[k], 6) if k == "score" else s[k])(verdict.score_details({n: c(n) for n in ("phishing", "executables", "macros", "viruses")}, c("category"), c("p"), F.struct(c("auth_score").alias("score"), F.when(c("auth_score") == 3, F.array(F.lit("DKIM_FAIL(3)"))).alias("tests")), c("denied"), c("truth"), c("allowed"))))
        for k in ("score", "is_spam", "tests")
    },
    [(1, 5.0, True, "BAYES_SPAM(0.0),PHISHING_DETECTED(5.0)"), (2, 12.0, True, "BAYES_SPAM(4.0),MACRO_DETECTED(5.0),DKIM_FAIL(3)"), (3, -5.75, False, "BAYES_HAM(-0.7)"), (4, 7.0, False, "PHISHING_DETECTED(10.0),ALLOWLISTED(-3.0)"), (5, 5.0, True, "EXECUTABLE_ATTACHMENT(10.0),TRUTH_SOURCE(-5.0)"), (6, 5.0, True, "DENYLISTED(10.0),TRUTH_SOURCE(-5.0)"), (7, 100.0, True, "VIRUS_DETECTED(100.0)")],
    {"score": "DOUBLE"},
)
_FLAGS = ("classification", "phishing", "executables", "macros", "arbitrary", "viruses", "patterns", "homograph", "toxicity", "nsfw", "denylisted")
cases(
    "verdict_reasons", "message", "on_flags string, truth boolean, allowed boolean",
    [(" ".join(_FLAGS), False, False), ("phishing", True, False), ("macros toxicity", False, True), ("", True, True), ("", False, True), ("", None, None), ("classification nsfw denylisted", False, False)],
    lambda: {"message": lambda: verdict.message({k: F.array_contains(F.split("on_flags", " "), k) for k in _FLAGS}, c("truth"), c("allowed"))},
    [(1, "Spam (spam classification, phishing detected, executable content, macro detected, arbitrary patterns, virus detected, suspicious patterns, IDN homograph attack, toxic content, NSFW content, and denylisted sender)"), (2, "Spam (phishing detected)"), (3, "Spam (macro detected and toxic content)"), (4, "Ham (truth source)"), (5, "Ham (allowlisted)"), (6, "Ham"), (7, "Spam (spam classification, NSFW content, and denylisted sender)")],
)
cases(
    "rewritten", "raw", "raw string, tag string",
    [("Subject: a\nTo: b\n\nbody\n\nmore", "[SPAM]"), ("To: b\r\nSubject: [SPAM] a\r\n\r\nbody", "[SPAM]"), ("no blank line", "[SPAM]"), ("SUBJECT: $1 x\nSubject: y\n\nz", "[S]"), ("To: b\n\nSubject: in body", "[SPAM]"), ("Subject: a\n\nb", None)],
    lambda: {"raw": lambda: verdict.rewrite(c("raw"), F.lit("X-Spam-Flag: YES\nX-Spam-Score: 6.0"), c("tag"))},
    [(1, "Subject: [SPAM] a\nTo: b\nX-Spam-Flag: YES\nX-Spam-Score: 6.0\n\nbody\n\nmore"), (2, "To: b\r\nSubject: [SPAM] a\r\nX-Spam-Flag: YES\r\nX-Spam-Score: 6.0\r\n\r\nbody"), (3, "no blank line\r\nX-Spam-Flag: YES\r\nX-Spam-Score: 6.0"), (4, "SUBJECT: [S] $1 x\nSubject: y\nX-Spam-Flag: YES\nX-Spam-Score: 6.0\n\nz"), (5, "To: b\nX-Spam-Flag: YES\nX-Spam-Score: 6.0\n\nSubject: in body"), (6, "Subject: a\nX-Spam-Flag: YES\nX-Spam-Score: 6.0\n\nb")],
)
cases(
    "spam_headers", "status flag tests", "score double, spam boolean",
    [(6.0, True), (-1.5, False)], lambda: {"status": lambda: verdict.headers(c("score"), c("spam"), F.array(F.lit("A(1)"), F.lit("B(5)")), version="1.0")["X-Spam-Status"], "flag": lambda: verdict.headers(c("score"), c("spam"), F.array(F.lit("A(1)")))["X-Spam-Flag"], "tests": lambda: verdict.headers(c("score"), c("spam"), F.array(F.lit("A(1)"), F.lit("B(5)")))["X-Spam-Tests"]},
    [(1, "Yes, score=6.0 required=5.0 tests=A(1),B(5) version=1.0", "YES", "A(1), B(5)"), (2, "No, score=-1.5 required=5.0 tests=A(1),B(5) version=1.0", "NO", "A(1), B(5)")],
)
cases(
    "reports", "short complete code", "spam boolean, score double, tests array<string>, phishing int, category string, dkim string, rep string, err string",
    [(True, 10.0, ["PHISHING_DETECTED(10.0)"], 2, "spam", "fail", "DENYLISTED (x.example)", None), (False, 0.0, [], 0, "ham", None, None, None), (False, 0.0, [], 0, None, None, None, "unreadable")],
    lambda: {"short": lambda: verdict.report(c("spam"), c("score"), c("tests")), "complete": lambda: verdict.report(c("spam"), c("score"), c("tests"), 5.0, {"phishing": c("phishing"), "category": c("category"), "dkim": c("dkim"), "reputation": c("rep")}), "code": lambda: verdict.exit_code(c("spam"), c("err"))},
    [
        (1, "SPAM DETECTED (score: 10.0, threshold: 5.0)\nTests: PHISHING_DETECTED(10.0)", "SPAM DETECTED (score: 10.0, threshold: 5.0)\nTests: PHISHING_DETECTED(10.0)\n\nDetails:\n  Classification: spam\n  Phishing: 2 issue(s) detected\n\n  Authentication:\n    DKIM: fail\n\n  Reputation:\n    Status: DENYLISTED (x.example)", 1),
        (2, "Clean (score: 0.0, threshold: 5.0)", "Clean (score: 0.0, threshold: 5.0)\n\nDetails:\n  Classification: ham", 0), (3, "Clean (score: 0.0, threshold: 5.0)", "Clean (score: 0.0, threshold: 5.0)\n\nDetails:", 2),
    ],
)

_MIXED = "From: Amy <a@b.example>\nTo: c@d.example\nSubject: =?utf-8?q?caf=C3=A9?=\nMessage-ID: <1@b.example>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain; charset=utf-8\n\nhello\n--q\nContent-Type: text/html\n\n<p>hi</p>\n--q\nContent-Disposition: attachment; filename=h.exe\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nTVqQ\n--q--\n"
cases(
    "mime_parse", "subject body page sender message_ref files heads", "raw string", [(_MIXED,), ("Subject: plain\n\njust text",), ("",), (None,)],
    lambda: {"subject": lambda: c("subject"), "body": lambda: F.trim(F.regexp_replace("text", r"\s+\z", "")), "page": lambda: F.regexp_replace("html", r"\s+\z", ""), "sender": lambda: c("from_address"), "message_ref": lambda: c("message_id"), "files": lambda: F.array_join(F.transform("attachments", lambda a: F.concat(a["filename"], F.lit(":"), F.hex(a["content"]))), ","), "heads": lambda: F.size("header_lines")},
    [(1, "café", "hello", "<p>hi</p>", "Amy <a@b.example>", "<1@b.example>", "h.exe:4D5A90", 6), (2, "plain", "just text", None, None, None, "", 1), (3, None, "", None, None, None, "", 0), (4, None, "", None, None, None, "", 0)],
    table=lambda df: mime.parse_mail(df.withColumn("no", F.col("case_no").cast("string")), "no", "raw").withColumn("case_no", F.col("source").cast("int")),
)


def _report(fields: str, text_part: str = "An abuse report.", top: str = "multipart/report; report-type=feedback-report; boundary=\"b1\"") -> str:
    return f"From: <r@x.example>\r\nMIME-Version: 1.0\r\nContent-Type: {top}\r\n\r\n--b1\r\nContent-Type: text/plain\r\n\r\n{text_part}\r\n\r\n--b1\r\nContent-Type: message/feedback-report\r\n\r\n{fields}\r\n--b1\r\nContent-Type: message/rfc822\r\n\r\nFrom: <spam@y.example>\r\nSubject: Earn\r\n money\r\n\r\nSpam text\r\n\r\n--b1--\r\n"


_FULL = "Feedback-Type: abuse\r\nUser-Agent: Gen/1.0\r\nVersion: 1\r\nOriginal-Mail-From: <spam@y.example>\r\nOriginal-Rcpt-To: <u1@z.example>\r\nOriginal-Rcpt-To: u2@z.example\r\nArrival-Date: Thu, 8 Mar 2005 14:00:00 EDT\r\nReporting-MTA: DNS; mail.z.example\r\nSource-IP: 192.0.2.2\r\nReported-Domain: y.example\r\nReported-Uri: http://y.example/a\r\nReported-Uri: mailto:u@y.example\r\nIncidents: 7 times\r\nOriginal-Envelope-Id: e-1\r\nAuthentication-Results: mx;\r\n spf=fail"
_ARF = ("feedback_type", "original_feedback_type", "version", "user_agent", "source_ip", "original_mail_from", "original_envelope_id", "incidents", "human_readable")
cases(
    "arf_parse", "error feedback_type original_feedback_type version user_agent source_ip original_mail_from original_envelope_id incidents human_readable arrival rcpt mta domains uris results original_subject original", "raw string",
    [(_report(_FULL),), (_report("Feedback-Type: Custom-Kind\r\nUser-Agent: G\r\nArrival-Date: 8 Mar 2005 14:00:00 +0100\r\nSource-IP: 2001:db8::1"),), (_report("User-Agent: G"),), (_report("Feedback-Type: fraud"),), ("Subject: x\r\n\r\nno report",), (_report(_FULL, top="multipart/mixed; boundary=\"b1\""),), (None,)],
    lambda: {
        "error": lambda: c("error"), **{k: (lambda k=k: c(f"arf.{k}")) for k in _ARF}, "arrival": lambda: F.date_format("arf.arrival_date", "yyyy-MM-dd'T'HH:mm:ss"), "rcpt": lambda: F.array_join("arf.original_rcpt_to", ","), "mta": lambda: F.concat("arf.reporting_mta.type", F.lit("/"), "arf.reporting_mta.name"),
        "domains": lambda: F.array_join("arf.reported_domain", ","), "uris": lambda: F.array_join("arf.reported_uri", ","), "results": lambda: F.array_join("arf.authentication_results", ","), "original_subject": lambda: c("arf.original_headers")["subject"], "original": lambda: F.trim(F.regexp_replace("arf.original_message", r"\s+\z", "")),
    },
    [
        (1, None, "abuse", "abuse", "1", "Gen/1.0", "192.0.2.2", "spam@y.example", "e-1", 7, "An abuse report.", "2005-03-08T18:00:00", "u1@z.example,u2@z.example", "dns/mail.z.example", "y.example", "http://y.example/a,mailto:u@y.example", "mx; spf=fail", "Earn money", "From: <spam@y.example>\nSubject: Earn money\n\nSpam text"),
        (2, None, "other", "custom-kind", "1", "G", "2001:db8::1", None, None, 1, "An abuse report.", "2005-03-08T13:00:00", "", None, "", "", "", "Earn money", "From: <spam@y.example>\nSubject: Earn money\n\nSpam text"),
        (3, "no feedback type", *[None] * 17), (4, "no user agent", *[None] * 17), (5, "not a feedback report", *[None] * 17), (6, "not a feedback report", *[None] * 17), (7, "not a feedback report", *[None] * 17),
    ],
    {"incidents": "INTEGER"}, table=arf.parse,
)
cases(
    "auth_words", "dkim spf dmarc arc bimi dkim_comment bimi_result", "h string",
    [("mx.example; dkim=pass header.d=x; spf=Fail smtp.mailfrom=y; dmarc=none; arc=pass; bimi=skipped",), ("mx; spf=softfail",), (None,)],
    lambda: {**{k: (lambda k=k: auth.from_header(c("h"))[k]) for k in ("dkim", "spf", "dmarc", "arc", "bimi")}, "dkim_comment": lambda: auth.normalised(auth.from_header(c("h")))["dkim"]["comment"], "bimi_result": lambda: auth.normalised(auth.from_header(c("h")))["bimi"]["result"]},
    [(1, "pass", "fail", "none", "pass", "skipped", None, "skipped"), (2, None, "softfail", None, None, None, "No DKIM signature found", "none"), (3, None, None, None, None, None, "No DKIM signature found", "none")],
)

cases(
    "language_guards", "english_anyway plausible", "t string, l string",
    [("ab", "de"), ("123 !@# 456", "de"), ("Привет мир", "ru"), ("hola", "es"), ("bonjour", "fr"), ("hi yo", "en"), ("日本", "ja"), (None, "en"), ("a_b", "de")],
    lambda: {"english_anyway": lambda: text.language_guard(c("t")), "plausible": lambda: text.plausible_short(c("t"), c("l"))}, [(1, True, False), (2, True, True), (3, True, True), (4, False, False), (5, False, True), (6, False, True), (7, True, True), (8, True, True), (9, False, False)],
)
cases(
    "replaced_words", "basic own longer", "t string",
    [("u r late w/ B4 4 2",), ("Currency",), ("   ",), (None,)],
    lambda: {"basic": lambda: text.replace_words(c("t"), text.replacements(None)), "own": lambda: text.preprocess(c("t"), text.replacements({"late": "$1 tardy"})), "longer": lambda: F.length(text.replace_words(c("t"), text.seeded_replacements())) - F.length(c("t"))},
    [(1, "you are late with Bfoare foare to", "u r $1 tardy w/ B4 4 2", 0), (2, "Cyoyouareareeandcy", "Currency", 10), (3, "   ", "", 0), (4, None, "", None)],
)
cases(
    "preprocessed", "tagged", "t string",
    [("on 01/02/2024 call 555-123-4567",), ("4111 1111 1111 1111",), ("a@b.example at 10.0.0.1 or 2001:db8:0:0:0:0:0:1",), ("see HTTPS://x.example/a #ff00aa 3.14",), ("00:1A:2b:3c:4d:5e",)],
    lambda: {"tagged": lambda: F.regexp_replace(F.trim(text.preprocess(c("t"))), " +", " ")},
    [(1, "on DATE_PATTERN call PHONE_NUMBER"), (2, "CREDIT_CARD"), (3, "EMAIL_ADDRESS at IP_ADDRESS or IP_ADDRESS"), (4, "see URL_LINK HEX_COLOR FLOATING_POINT"), (5, "MAC_ADDRESS")],
)
cases(
    "tokens_by_language", "tokens", "t string, l string",
    [("The ＱＵＩＣＫ fox isn't here, don't run", "en"), ("Der schnelle Fuchs und die Straße", "de"), ("这 是 测试 the", "zh"), ("Привет и мир", "ru"), ("le chat est là the", "fr"), ("", "en")],
    lambda: {"tokens": lambda: F.array_join(text.locale_tokens(c("t"), c("l")), " ")}, [(1, "quick fox run"), (2, "schnelle fuchs stra e"), (3, "这 是 测试"), (4, "привет мир"), (5, "chat là"), (6, "")],
)
cases(
    "stemmed", "stem", "w string",
    [("caresses",), ("relational",), ("hopping",), ("filing",), ("generalizations",), ("sky",), ("happy",), ("agreed",), ("conflated",), ("é",)],
    lambda: {"stem": lambda: c("stem")}, [(1, "caress"), (2, "relat"), (3, "hop"), (4, "file"), (5, "gener"), (6, "sky"), (7, "happi"), (8, "agre"), (9, "conflat"), (10, "é")],
    table=lambda df: df.join(stem.stems(df.select(F.col("w").alias("token"))), F.col("w") == F.col("token")),
)
cases(
    "stemmed_by_language", "stem", "w string, l string",
    [("aufeinander", "de"), ("kategorischer", "de"), ("katers", "de"), ("kaufmännischen", "de"), ("bedürfnissen", "de"), ("häuser", "de"), ("freundlichkeit", "de"), ("bewegungen", "de"), ("chicharrones", "es"), ("torneado", "es"), ("trabajando", "es"), ("rápidamente", "es"), ("universidades", "es"), ("hablaríamos", "es"), ("continuellement", "fr"), ("majestueusement", "fr"), ("maintenant", "fr"), ("nationalité", "fr"), ("chevaux", "fr"), ("finissons", "fr"), ("abbandonata", "it"), ("pronunciamento", "it"), ("propagazione", "it"), ("felicemente", "it"), ("nazioni", "it"), ("bobagem", "pt"), ("quilométricas", "pt"), ("nacionalidade", "pt"), ("rapidamente", "pt"), ("questões", "pt"), ("важнейшие", "ru"), ("вагоны", "ru"), ("падают", "ru"), ("надежность", "ru"), ("бегавшая", "ru"), ("книгами", "ru"), ("words", "xx")],
    lambda: {"stem": lambda: c("stem")},
    [(1, "aufeinand"), (2, "kategor"), (3, "kat"), (4, "kaufmann"), (5, "bedurfnis"), (6, "haus"), (7, "freundlich"), (8, "beweg"), (9, "chicharron"), (10, "torn"), (11, "trabaj"), (12, "rapid"), (13, "univers"), (14, "habl"), (15, "continuel"), (16, "majestu"), (17, "mainten"), (18, "national"), (19, "cheval"), (20, "fin"), (21, "abbandon"), (22, "pronunc"), (23, "propag"), (24, "felic"), (25, "nazion"), (26, "bobag"), (27, "quilométr"), (28, "nacional"), (29, "rapid"), (30, "questõ"), (31, "важн"), (32, "вагон"), (33, "пада"), (34, "надежн"), (35, "бега"), (36, "книг"), (37, "words")],
    table=lambda df: df.join(stem.stems(df.select(F.col("w").alias("token"), F.col("l").alias("lang"))), (F.col("w") == F.col("token")) & (F.col("l") == F.col("lang"))),
)

_DKIM = "dkim array<struct<domain:string,result:string>>"


def _extracted(only_aligned: bool) -> Column:
    s = sessions.for_attributes(c("f"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<key:string,line:string>>"), c("host"))
    return reputation.extract(s, c("r"), c("dkim"), c("spf"), only_aligned)


cases(
    "extracted_attributes", "aligned every signing signed", f"f string, r string, host string, {_DKIM}, spf map<string,string>",
    [
        ("A@Mail.Shop.co.uk", "help@other.example", "mx.shop.co.uk", [{"domain": "shop.co.uk", "result": "pass"}, {"domain": "bad.example", "result": "fail"}], None),
        ("a@x.example", "SRS0=h=t=y.example=bo@fwd.example", None, None, {"y.example": "pass", "x.example": "fail"}), ("a@x.example", None, None, [], {"x.example": "pass"}), (None, None, None, None, None),
    ],
    lambda: {
        "aligned": lambda: F.array_join(_extracted(True)["attributes"], ","), "every": lambda: F.array_join(_extracted(False)["attributes"], ","),
        "signing": lambda: F.array_join(_extracted(True)["signing_domains"], ","), "signed": lambda: _extracted(True)["aligned_signature"],
    },
    [
        (1, "mx.shop.co.uk,shop.co.uk,a@mail.shop.co.uk,mail.shop.co.uk", "mx.shop.co.uk,shop.co.uk,a@mail.shop.co.uk,mail.shop.co.uk,help@other.example,other.example", "shop.co.uk", True),
        (2, "bo@y.example,y.example", "a@x.example,x.example,bo@y.example,y.example", "", False), (3, "a@x.example,x.example", "a@x.example,x.example", "", False), (4, "", "", "", False),
    ],
)
cases(
    "auth_of_mail", "score header spf_result spf_comment dkim_alone", "dkim string, spf string, dmarc string, arc string, d string",
    [("pass", "softfail", "fail", None, "x.example"), (None, None, None, None, None), (" PASS ", "", "none", "pass", None)],
    lambda: {
        "score": lambda: auth.of_mail({k: c(k) for k in ("dkim", "spf", "dmarc", "arc")}, "mx", c("d"))["score"], "header": lambda: F.replace(auth.of_mail({k: c(k) for k in ("dkim", "spf", "dmarc", "arc")}, "mx", c("d"))["header"], F.lit(";\n\t"), F.lit("; ")),
        "spf_result": lambda: auth.only({"spf": c("spf")}, "spf", c("d"))["result"], "spf_comment": lambda: auth.only({"spf": c("spf")}, "spf")["comment"], "dkim_alone": lambda: auth.only({"dkim": c("dkim")}, "dkim")["result"],
    },
    [(1, 3, "mx; dkim=pass; spf=softfail smtp.mailfrom=x.example; dmarc=fail", "softfail", None, "pass"), (2, None, None, "none", "SPF check not performed", "none"), (3, -3, "mx; dkim= PASS ; spf=; dmarc=none; arc=pass", "none", "SPF check not performed", "pass")],
    {"score": "INTEGER"},
)
