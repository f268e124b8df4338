"""Queries of the whole scan and of its parts over the mail tables, with SQL that is written from the described behaviour, reason by reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsieve.functions import text, urls
from postsieve.lookups import ATTRIBUTE_SUFFIXES, BLOCKED_PHRASES, BODY_FAMILIES, BRANDS, CONFUSABLE, CONTEXT_PATTERNS, DATES, GTUBE, IDN_WHITELIST, KEYWORDS, MACRO_TEXT, RULE_SUFFIXES, SENDER_PATTERNS, SHORTENERS, SPOOFED_HOSTS, SPOOFED_NAMES, SUBJECT_FAMILIES, SUSPICIOUS_TLDS, SYSADMIN_SUBJECTS
from postsieve.operators import bayes, detect, reputation, rules
from postsieve.operators.detect import HTML_TAGS, PATHS
from postsieve.plans.queries import LABEL, LOW, SUBJ, TOKENS, any_of, q, query
from postsieve.plans.scan import Config, findings, first_of, judge, scan
from postsieve.session import spread, table
from postsieve.streaming import scan as streaming

AS_OF = "2024-06-01 00:00:00"
CONFIG = Config(as_of=AS_OF)


def mail_view(spark, d):
    m = table(spark, d, "enron_dataset")
    head = F.concat(F.lit("<"), F.col("id").cast("string"), F.lit("@"), F.col("mailbox"), F.lit(">"))
    return spread(m.select(F.col("id").alias("message_id"), "subject", F.col("message").alias("text"), head.alias("message_id_header"), F.col("loaded_at").alias("date"), "label", "loaded_at"))


def tables(spark, d):
    """What the scan knows of each message besides its content, and a classifier trained on the labelled mails."""
    labelled = mail_view(spark, d).where("label is not null").select(F.when(F.col("label") == 1, "spam").otherwise("ham").alias("category"), text.simple_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    rep = table(spark, d, "reputation")
    return {
        "session": first_of(table(spark, d, "session_info"), "received_at"), "auth": first_of(table(spark, d, "auth_result"), "checked_at"), "known": rep,
        "blocked": rep.where("is_denylisted").select(F.col("reputation_value").alias("host")), "model": bayes.train(labelled, limit=bayes.VOCABULARY),
    }


# --- SQL --------------------------------------------------------------------------------------------------------------

VIEW = "SELECT id AS message_id, subject, message AS text, '<' || id || '@' || mailbox || '>' AS mid, loaded_at AS date FROM enron_dataset"
SES = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY received_at NULLS FIRST) AS k FROM session_info) WHERE k = 1"
AUT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY checked_at NULLS FIRST) AS k FROM auth_result) WHERE k = 1"
LINKS = r"list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^\s<>""'']+'), lambda u: regexp_replace(u, '[).,;!?]+$', ''))".replace('""', '"')
HOST = r"lower(regexp_extract(u, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def root(host: str, suffixes: list[str]) -> str:
    last = lambda n: f"array_to_string(list_slice(string_split({host}, '.'), -{n}, -1), '.')"
    return f"CASE WHEN {last(2)} IN ({', '.join(map(q, suffixes))}) THEN {last(3)} ELSE {last(2)} END"


def listed(cases: list[tuple[str, int, str]]) -> tuple[str, str]:
    """Sum of points and list of reasons of (condition, points, reason as SQL)."""
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in cases), "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {r} END" for c, _, r in cases) + "], lambda x: x IS NOT NULL)"


LETTERS, CAPITALS = "len(regexp_extract_all(coalesce(subject, ''), '[A-Za-z]'))", "len(regexp_extract_all(coalesce(subject, ''), '[A-Z]'))"
SUBJECT_SQL = [
    *((f"regexp_matches({SUBJ}, {q(p)})", 1, f"'SUBJECT_SPAM_PATTERN: ' || regexp_extract({SUBJ}, {q(p)})") for p in SUBJECT_FAMILIES),
    (f"{LETTERS} > 10 AND {CAPITALS}::DOUBLE / {LETTERS} > 0.7", 2, "'SUBJECT_ALL_CAPS'"),
    ("len(regexp_extract_all(coalesce(subject, ''), '[!?$]')) >= 3", 1, "'SUBJECT_EXCESSIVE_PUNCTUATION'"),
    (f"regexp_matches({SUBJ}, '^(?:re|fw|fwd):') AND length(coalesce(subject, '')) < 20", 1, "'SUBJECT_FAKE_REPLY'"),
]
BODY_SQL = [*((f"regexp_matches({LOW}, {q(p)})", 1, f"'BODY_SPAM_PATTERN: ' || substring(regexp_extract({LOW}, {q(p)}), 1, 50)") for p in BODY_FAMILIES)]
KEYWORD_SQL = [(f"contains({LOW}, {q(k)})", w, q(f"SPAM_KEYWORD: {k}")) for k, w in KEYWORDS.items()]
SHORT_SQL = [(f"regexp_matches({LOW}, {q(SHORTENERS)})", 2, "'URL_SHORTENER'")]
SENDER_SQL = [
    ("f = ''", 2, "'MISSING_FROM'"),
    ("f <> '' AND (" + " OR ".join(f"regexp_matches(f, {q(p)})" for p in SENDER_PATTERNS) + ")", 2, "'SUSPICIOUS_SENDER_PATTERN'"),
    (f"f <> '' AND regexp_extract(f, '@[^.]+\\.([a-z]+)$', 1) IN ({', '.join(map(q, SUSPICIOUS_TLDS))})", 2, "'SUSPICIOUS_TLD: ' || regexp_extract(envelope_from, '@[^.]+\\.([A-Za-z]+)$', 1)"),
    (f"f <> '' AND regexp_matches(f, {q(SPOOFED_NAMES)}) AND NOT regexp_matches(f, {q(SPOOFED_HOSTS)})", 3, "'DISPLAY_NAME_SPOOFING'"),
]
HEADER_SQL = [
    ("coalesce(mid, '') = ''", 1, "'MISSING_MESSAGE_ID'"), (f"date > TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR", 2, "'FUTURE_DATE'"),
    (f"epoch(TIMESTAMP '{AS_OF}') - floor(epoch(date)) > 365 * 86400", 1, "'VERY_OLD_DATE'"), ("date IS NULL", 1, "'MISSING_DATE'"),
]
PORT = r"regexp_extract(u, '(?i)^https?://(?:[^/?#@]*@)?[^/?#:]+:(\d+)', 1)"
BAD = r"(NOT regexp_matches(u, '(?i)^https?://(?:[^/?#@\\]*@)?(?:\[[0-9a-f:.]+\]|[^\s/?#@:\[\]<>^|%\\]+)(?::\d{0,5})?(?:[/?#\\]|$)') OR coalesce(TRY_CAST(nullif(" + PORT + r", '') AS INTEGER) > 65535, false))"
TLD = f"list_extract(string_split({HOST}, '.'), -1)"
LINK_SQL = [
    (f"regexp_matches({HOST}, '^(?:\\d+\\.){{3}}\\d+$')", "'IP_ADDRESS_URL'"), (f"{TLD} IN ({', '.join(map(q, SUSPICIOUS_TLDS))})", f"'SUSPICIOUS_URL_TLD: ' || {TLD}"),
    (f"{PORT} NOT IN ('', '80', '443')", "'URL_WITH_PORT'"), ("length(u) > 200", "'VERY_LONG_URL'"), (f"len(string_split({HOST}, '.')) - 2 > 3", "'EXCESSIVE_SUBDOMAINS'"),
    (r"regexp_matches(u, '(?i)%[\da-f]{2}.*%[\da-f]{2}')", "'URL_OBFUSCATION'"),
]
LINK_LIST = r"list_distinct(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^\s<>" + '"' + r"'']+'), lambda u: CASE WHEN " + BAD + " THEN ['INVALID_URL'] ELSE list_filter([" + ", ".join(f"CASE WHEN {c} THEN {r} END" for c, r in LINK_SQL) + "], lambda x: x IS NOT NULL) END)))"

PATH_LIST = " || ".join(f"regexp_extract_all(coalesce(text, '') || ' ', {q(p)})" for p in PATHS)
VALID = f"NOT (regexp_matches(p, '^/[A-Za-z0-9]+$') AND lower(substring(p, 2)) IN ({', '.join(map(q, HTML_TAGS))})) AND length(p) >= 4 AND NOT regexp_matches(p, '^//[A-Za-z0-9.-]+$') AND (contains(p, '.') OR contains(p, '/'))"
PATHS_SQL = f"list_filter({PATH_LIST}, lambda p: {VALID})"
DATES_SQL = " + ".join(f"CASE WHEN len(regexp_extract_all({LOW}, {q(p)})) > 5 THEN 1 ELSE 0 END" for p in DATES)

PLAIN_HOST = "regexp_replace(translate(host, " + q("".join(CONFUSABLE)) + ", " + q("".join(CONFUSABLE.values())) + "), '\\.(?:com|org|net|edu|gov)$', '')"
SIMILAR = "greatest(" + ", ".join(f"CAST(greatest(length(plain), {len(b)}) - levenshtein(plain, {q(b)}) AS DOUBLE) / greatest(length(plain), {len(b)})" for b in BRANDS) + ")"
D = lambda x: f"CAST({x} AS DOUBLE)"
CONTEXT_SQL = D(0) + "".join(f" + CASE WHEN regexp_matches({LOW}, {q(p)}) THEN {D(0.1)} ELSE {D(0)} END" for p in CONTEXT_PATTERNS)
SCRIPT = "((regexp_matches(host, '[A-Za-z]'))::INT + regexp_matches(host, '[\\x{0400}-\\x{04FF}]')::INT + regexp_matches(host, '[\\x{0370}-\\x{03FF}]')::INT + regexp_matches(host, '[\\x{4E00}-\\x{9FFF}]')::INT + regexp_matches(host, '[\\x{0590}-\\x{05FF}]')::INT + regexp_matches(host, '[\\x{0600}-\\x{06FF}]')::INT)"
MIXED = "regexp_matches(host, '[A-Za-z]') AND regexp_matches(host, '[\\x{0370}-\\x{04FF}]')"
ODD = "least(" + D(f"length(host) - length(translate(host, {q(''.join(CONFUSABLE))}, ''))") + " / length(host) * 0.8::DOUBLE, 0.6::DOUBLE)"
RISK = (
    f"CASE WHEN host IN ({', '.join(map(q, IDN_WHITELIST))}) THEN {D(0)} ELSE {D(0)} + CASE WHEN contains(host, 'xn--') OR regexp_matches(host, '[^\\x00-\\x7F]') THEN {D(0.3)} ELSE {D(0)} END + {ODD} "
    f"+ CASE WHEN {SIMILAR} > 0.8 THEN {SIMILAR} * {D(0.7)} ELSE {D(0)} END + CASE WHEN {SCRIPT} < 2 THEN {D(0)} WHEN {MIXED} THEN {D(0.4)} ELSE {D(0.2)} END "
    f"+ (CASE WHEN fragment THEN {D(0.3)} ELSE {D(0)} END + context) + CASE WHEN contains(host, 'xn--') THEN {ODD} * {D(0.8)} ELSE {D(0)} END END"
)
HOSTS = f"SELECT DISTINCT message_id, u, text, {HOST} AS host, contains(u, '#') AS fragment FROM (SELECT DISTINCT message_id, text, unnest({LINKS}) AS u FROM ({VIEW}))"
RISKS = f"SELECT message_id, u, host, {RISK} AS risk FROM (SELECT *, {PLAIN_HOST} AS plain, {CONTEXT_SQL} AS context FROM ({HOSTS}) WHERE host <> '')"

COUNTS = f"SELECT category, token, count(*) * CASE WHEN category = 'ham' THEN 2 ELSE 1 END AS n FROM (SELECT {LABEL} AS category, unnest({TOKENS}) AS token FROM (SELECT message AS text, label FROM enron_dataset) WHERE label IS NOT NULL) GROUP BY category, token"
CLASSES = (
    f"WITH every AS ({COUNTS}), top AS (SELECT token FROM every GROUP BY token ORDER BY sum(n) DESC, token LIMIT 20000), c AS (SELECT every.* FROM every SEMI JOIN top USING (token)), "
    f"p AS (SELECT {LABEL} AS category, count(*) AS docs FROM enron_dataset WHERE label IS NOT NULL GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v FROM c), t AS (SELECT category, sum(n) AS total FROM c GROUP BY category), "
    "b AS (SELECT p.category, ln(p.docs / (SELECT sum(docs) FROM p)) AS prior, CAST(t.total + v.v AS DOUBLE) AS below FROM p JOIN t USING (category), v), "
    f"d AS (SELECT DISTINCT message_id AS id, text FROM ({VIEW})), tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '') || ' '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2 AND length(t) < 20)) AS token FROM d) WHERE token IN (SELECT token FROM c) GROUP BY id, token), "
    "s AS (SELECT tf.id, b.category, sum(tf.tf * ln((coalesce(c.n, 0) + 1) / b.below)) AS s FROM tf CROSS JOIN b LEFT JOIN c ON c.token = tf.token AND c.category = b.category GROUP BY tf.id, b.category), "
    "x AS (SELECT d.id, b.category, b.prior + coalesce(s.s, 0) AS score FROM (SELECT DISTINCT id FROM d) d CROSS JOIN b LEFT JOIN s ON s.id = d.id AND s.category = b.category) "
    "SELECT id, arg_max(category, score + CASE WHEN category = 'ham' THEN 1e-9 ELSE 0 END) AS category FROM x GROUP BY id"
)

FROM_HOST = "CASE WHEN contains(f, '@') THEN substring(f, position('@' IN f) + 1) ELSE '' END"
RCPT_ROOT = root("CASE WHEN contains(lower(r), '@') THEN substring(lower(r), position('@' IN r) + 1) ELSE '' END", RULE_SUFFIXES)
PROVEN = f"coalesce(spf, '') = 'pass' OR coalesce(list_contains(signing_domains, fh) OR list_contains(signing_domains, fr), false) OR coalesce(is_allowlisted, false) OR coalesce({root('client_hostname', RULE_SUFFIXES)} = fr, false)"
SPOOF = f"fr <> '' AND coalesce(len(list_filter(rcpt_to, lambda r: {RCPT_ROOT} = fr)) > 0, false) AND NOT ({PROVEN}) AND NOT regexp_matches({SUBJ}, {q(SYSADMIN_SUBJECTS)})"
VENDOR = [
    ("f = 'invoice@authorize.net' AND coalesce(root_client_hostname, '') = 'visa.com'", 15, "AUTHORIZE_VISA_PHISHING", "phishing"),
    ("contains(f, 'amazon.co.jp') AND NOT starts_with(coalesce(root_client_hostname, ''), 'amazon.')", 12, "AMAZON_JP_IMPERSONATION", "impersonation"),
    ("contains(coalesce(subject, ''), 'pCloud') AND fr <> 'pcloud.com' AND contains(f, 'pcloud')", 12, "PCLOUD_IMPERSONATION", "impersonation"),
    ("f = 'postmaster@163.com' AND contains(coalesce(subject, ''), '系统退信')", 10, "163_BOUNCE_SPAM", "bounce_spam"),
    ("f = 'dse_na4@docusign.net' AND (ends_with(coalesce(spf_domain, ''), '.onmicrosoft.com') OR spf_domain = 'onmicrosoft.com')", 12, "DOCUSIGN_MS_SCAM", "phishing"),
]
first_case = lambda values: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in values) + " END"
VENDOR_REASON, VENDOR_KIND = first_case([(c, q(r)) for c, _, r, _ in VENDOR]), first_case([(c, q(k)) for c, _, _, k in VENDOR])
VENDOR_POINTS = "coalesce(" + first_case([(c, p) for c, p, _, _ in VENDOR]) + ", 0)"


def _rules_sql() -> str:
    sums, lists = zip(*(listed(x) for x in (SUBJECT_SQL, BODY_SQL, KEYWORD_SQL, SHORT_SQL, SENDER_SQL, HEADER_SQL)))
    phrase = f"regexp_matches({SUBJ}, {q(BLOCKED_PHRASES)})"
    score = f"CASE WHEN {phrase} THEN 10 ELSE 0 END + {VENDOR_POINTS} + CASE WHEN {SPOOF} THEN 12 ELSE 0 END + " + " + ".join(sums) + f" + len({LINK_LIST})"
    reasons = f"list_filter([CASE WHEN {phrase} THEN 'BLOCKED_PHRASE_IN_SUBJECT' END, {VENDOR_REASON}, CASE WHEN {SPOOF} THEN 'SPOOFING_ATTACK' END], lambda x: x IS NOT NULL) || " + " || ".join(lists) + f" || {LINK_LIST}"
    kind = f"coalesce(CASE WHEN {SPOOF} THEN 'spoofing' END, {VENDOR_KIND}, CASE WHEN {phrase} THEN 'spam' END, 'pattern')"
    base = f"SELECT m.*, s.* EXCLUDE (message_id), a.dkim, a.spf, a.dmarc, a.arc, lower(coalesce(s.envelope_from, '')) AS f FROM ({VIEW}) m LEFT JOIN ({SES}) s USING (message_id) LEFT JOIN ({AUT}) a USING (message_id)"
    hosts = f"SELECT *, {FROM_HOST} AS fh FROM ({base})"
    roots = f"SELECT *, {root('fh', RULE_SUFFIXES)} AS fr FROM ({hosts})"
    return f"SELECT *, CASE WHEN f = '' THEN 0 ELSE {score} END AS rule_score, CASE WHEN f = '' THEN [] ELSE {reasons} END AS reason_list, {kind} AS kind FROM ({roots})"


RULES = _rules_sql()


@query(f"SELECT message_id, CAST(rule_score AS INTEGER) AS rule_score, array_to_string(list_sort(reason_list), '; ') AS reasons, CASE WHEN rule_score >= 5 THEN kind END AS subtype FROM ({RULES})")
def rule_total(spark, d):
    """All groups of rules, with the session and authentication of each mail."""
    t = {k: v for k, v in tables(spark, d).items() if k in ("session", "auth")}
    out = judge(findings(mail_view(spark, d), CONFIG, **t), CONFIG)
    return out.select("message_id", "rule_score", F.array_join(F.array_sort("reasons"), "; ").alias("reasons"), "subtype")


SRS = "CASE WHEN regexp_matches(f, '^<?srs1=[^=]+=[^=]+==[^=]+=[^=]+=([^=]+)=([^@]+)@') THEN regexp_extract(f, '^<?srs1=[^=]+=[^=]+==[^=]+=[^=]+=([^=]+)=([^@]+)@', 2) || '@' || regexp_extract(f, '^<?srs1=[^=]+=[^=]+==[^=]+=[^=]+=([^=]+)=([^@]+)@', 1) WHEN regexp_matches(f, '^<?srs0=[^=]+=[^=]+=([^=]+)=([^@]+)@') THEN regexp_extract(f, '^<?srs0=[^=]+=[^=]+=([^=]+)=([^@]+)@', 2) || '@' || regexp_extract(f, '^<?srs0=[^=]+=[^=]+=([^=]+)=([^@]+)@', 1) ELSE f END"
WHO = f"SELECT *, lower({SRS}) AS who FROM (SELECT s.*, a.spf, lower(s.envelope_from) AS f FROM ({SES}) s LEFT JOIN ({AUT}) a USING (message_id))"
WHO3 = f"SELECT *, {root('wh', ATTRIBUTE_SUFFIXES)} AS wr FROM (SELECT *, CASE WHEN contains(who, '@') THEN substring(who, position('@' IN who) + 1) ELSE who END AS wh FROM ({WHO}))"
ALIGNED = "coalesce(list_contains(signing_domains, wh) OR list_contains(signing_domains, wr), false) OR coalesce(lower(spf_domain) IN (wh, wr) AND spf = 'pass', false)"
ATTRS = f"[client_hostname, root_client_hostname, remote_address] || CASE WHEN coalesce(who, '') <> '' AND ({ALIGNED}) THEN [who, wh, wr] ELSE [] END"
CLEAN = lambda x: f"list_distinct(list_filter(list_transform({x}, lambda v: lower(trim(v))), lambda v: v IS NOT NULL AND v <> ''))"
VALUES = f"SELECT message_id, unnest({CLEAN(ATTRS + chr(32) + '|| [f, nullif(split_part(f, chr(64), 2), chr(39))]')}) AS value FROM ({WHO3})".replace("chr(39)", "''").replace("chr(64)", "'@'")
LISTS = f"SELECT v.message_id, bool_or(coalesce(is_truth_source, false)) AS truth, bool_or(coalesce(is_allowlisted, false)) AS allowed, bool_or(coalesce(is_denylisted, false)) AS denied FROM ({VALUES}) v LEFT JOIN reputation r ON r.reputation_value = v.value GROUP BY v.message_id"


def _flags_sql() -> str:
    per = f"SELECT message_id, count_if(risk > 0.3) AS risky, max(risk) AS top FROM ({RISKS}) GROUP BY message_id"
    hits = f"SELECT message_id, count(DISTINCT host) AS hits FROM ({HOSTS}) WHERE host IN (SELECT reputation_value FROM reputation WHERE is_denylisted) GROUP BY message_id"
    macros = " + ".join(f"({any_of(LOW, ps)})::INT" for ps in MACRO_TEXT.values())
    gtube = f"CASE WHEN contains(coalesce(text, ''), {q(GTUBE)}) THEN 1 ELSE 0 END"
    return (
        f"SELECT r.message_id, r.rule_score, c.category, coalesce(h.risky, 0) + coalesce(b.hits, 0) AS phishing, {macros} AS macros, CASE WHEN rule_score >= 5 THEN 1 ELSE 0 END + {gtube} AS arbitrary, "
        f"{DATES_SQL} + len({PATHS_SQL}) AS patterns, coalesce(h.top, 0) > CAST(0.3 AS DOUBLE) AS homograph, coalesce(l.denied, false) AS denied, coalesce(l.truth, false) AS truth, coalesce(l.allowed, false) AS allowed, r.dkim, r.spf, r.dmarc, r.arc "
        f"FROM ({RULES}) r LEFT JOIN ({CLASSES}) c ON c.id = r.message_id LEFT JOIN ({per}) h ON h.message_id = r.message_id LEFT JOIN ({hits}) b ON b.message_id = r.message_id LEFT JOIN ({LISTS}) l ON l.message_id = r.message_id"
    )


SAID = (
    "list_filter([CASE WHEN category = 'spam' THEN 'spam classification' END, CASE WHEN phishing > 0 THEN 'phishing detected' END, CASE WHEN macros > 0 THEN 'macro detected' END, "
    "CASE WHEN arbitrary > 0 THEN 'arbitrary patterns' END, CASE WHEN patterns > 0 THEN 'suspicious patterns' END, CASE WHEN homograph THEN 'IDN homograph attack' END, CASE WHEN denied THEN 'denylisted sender' END], lambda x: x IS NOT NULL)"
)
MESSAGE = (
    "CASE len(said) WHEN 0 THEN CASE WHEN truth THEN 'Ham (truth source)' WHEN allowed THEN 'Ham (allowlisted)' ELSE 'Ham' END WHEN 1 THEN 'Spam (' || said[1] || ')' "
    "WHEN 2 THEN 'Spam (' || said[1] || ' and ' || said[2] || ')' ELSE 'Spam (' || array_to_string(said[1:len(said) - 1], ', ') || ', and ' || said[len(said)] || ')' END"
)
WORD = lambda k: f"lower(trim(coalesce({k}, '')))"
AUTH_SQL = [
    (f"{WORD('dkim')} = 'pass'", -2, "'DKIM_PASS(-2)'"), (f"{WORD('dkim')} = 'fail'", 3, "'DKIM_FAIL(3)'"), (f"{WORD('spf')} = 'pass'", -1, "'SPF_PASS(-1)'"), (f"{WORD('spf')} = 'fail'", 2, "'SPF_FAIL(2)'"),
    (f"{WORD('spf')} = 'softfail'", 1, "'SPF_SOFTFAIL(1)'"), (f"{WORD('dmarc')} = 'pass'", -2, "'DMARC_PASS(-2)'"), (f"{WORD('dmarc')} = 'fail'", 4, "'DMARC_FAIL(4)'"), (f"{WORD('arc')} = 'pass'", -1, "'ARC_PASS(-1)'"), (f"{WORD('arc')} = 'fail'", 1, "'ARC_FAIL(1)'"),
]
AUTH_SUM, AUTH_TESTS = listed(AUTH_SQL)
SCORE = f"CAST(phishing * 5 + macros * 5 + {AUTH_SUM} + CASE WHEN denied THEN 10 ELSE 0 END + CASE WHEN truth THEN -5 WHEN allowed THEN -3 ELSE 0 END AS DOUBLE)"
TESTS_SQL = (
    "array_to_string(list_filter([CASE WHEN category = 'spam' THEN 'BAYES_SPAM(0.0)' END, CASE WHEN phishing > 0 THEN 'PHISHING_DETECTED(' || phishing * 5 || '.0)' END, CASE WHEN macros > 0 THEN 'MACRO_DETECTED(' || macros * 5 || '.0)' END], lambda x: x IS NOT NULL) || "
    f"{AUTH_TESTS} || list_filter([CASE WHEN denied THEN 'DENYLISTED(10.0)' END, CASE WHEN truth THEN 'TRUTH_SOURCE(-5.0)' WHEN allowed THEN 'ALLOWLISTED(-3.0)' END], lambda x: x IS NOT NULL), ',')"
)
SCANNED = f"SELECT *, {SAID} AS said, {SCORE} AS points FROM ({_flags_sql()})"
VERDICTS = (
    f"SELECT message_id, len(said) > 0 AS is_spam, {MESSAGE} AS message, CAST(rule_score AS INTEGER) AS rule_score, category, points AS score, "
    f"CASE WHEN denied THEN true WHEN truth OR allowed THEN false ELSE points >= 5 END AS score_spam, {TESTS_SQL} AS tests FROM ({SCANNED})"
)


def _scan(spark, d):
    return scan(mail_view(spark, d), config=CONFIG, **tables(spark, d))


@query(VERDICTS)
def scan_verdicts(spark, d):
    return _scan(spark, d).select("message_id", "is_spam", "message", "rule_score", "category", "score", "score_spam", F.array_join("tests", ",").alias("tests"))


@query(f"SELECT count(*) AS scans, count_if(is_spam)::BIGINT AS spam, round(avg(rule_score), 6) AS mean_score, max(message_id) AS last_id FROM ({VERDICTS})")
def scan_metrics(spark, d):
    return streaming.scan_metrics(_scan(spark, d)).select("scans", "spam", F.round("mean_score", 6).alias("mean_score"), "last_id")


@query(f"SELECT message_id, host, round(risk, 6) AS risk, CASE WHEN risk > 0.6 THEN 'phishing' WHEN risk > 0.3 THEN 'suspicious' END AS type FROM (SELECT message_id, host, max(risk) AS risk FROM ({RISKS}) GROUP BY ALL)")
def phishing_findings(spark, d):
    return detect.host_risk(mail_view(spark, d)).select("message_id", "host", F.round("risk", 6).alias("risk"), "type")


@query(f"SELECT message_id, array_to_string({PATHS_SQL}, chr(10)) AS paths FROM ({VIEW})")
def file_paths(spark, d):
    return mail_view(spark, d).select("message_id", F.array_join(detect.file_paths(F.concat(F.coalesce("text", F.lit("")), F.lit(" "))), "\n").alias("paths"))


@query(f"SELECT message_id, CAST(len({LINK_LIST}) AS INTEGER) AS score, array_to_string(list_sort({LINK_LIST}), ',') AS reasons FROM ({VIEW})")
def rule_links(spark, d):
    r = rules.link_rules(F.col("text"))
    return mail_view(spark, d).select("message_id", r["score"].alias("score"), F.array_join(F.array_sort(r["reasons"]), ",").alias("reasons"))


@query(f"SELECT message_id, CAST(CASE WHEN {SPOOF} THEN 12 ELSE 0 END AS INTEGER) AS score FROM ({RULES})")
def rule_spoof(spark, d):
    t = tables(spark, d)
    s = mail_view(spark, d).select("message_id", "subject").join(t["session"], "message_id", "left").join(t["auth"].select("message_id", "spf"), "message_id", "left")
    host = urls.host_of_address(F.lower("envelope_from"))
    signed = F.exists("signing_domains", lambda x: (x == host) | (x == urls.root_domain_rules(host)))
    none = F.lit(None).cast("string")
    r = rules.spoofing_rules(F.col("envelope_from"), F.col("rcpt_to"), F.col("spf"), signed, F.col("is_allowlisted"), none, F.col("subject"), none, urls.root_domain_rules(F.col("client_hostname")) == urls.root_domain_rules(host))
    return s.select("message_id", r["score"].alias("score"))


EVERY = f"[client_hostname, root_client_hostname, remote_address] || CASE WHEN coalesce(who, '') <> '' THEN [who, wh, wr] ELSE [] END"


@query(f"SELECT message_id, array_to_string(list_sort({CLEAN(EVERY)}), ',') AS attrs, array_to_string(list_sort({CLEAN(ATTRS)}), ',') AS aligned FROM ({WHO3}) WHERE message_id IS NOT NULL")
def attributes_aligned(spark, d):
    t = tables(spark, d)
    s = t["session"].where("message_id is not null").join(t["auth"].select("message_id", "spf"), "message_id", "left")
    none = F.lit(None).cast("string")
    c = [F.col(x) for x in ("client_hostname", "root_client_hostname", "remote_address", "envelope_from")]
    spf = F.when(F.col("spf_domain").isNotNull(), F.create_map(F.lower("spf_domain"), F.col("spf")))
    one, two = reputation.attributes(*c, none, c[3]), reputation.aligned_attributes(*c, none, c[3], F.col("signing_domains"), spf)
    return s.select("message_id", F.array_join(F.array_sort(one), ",").alias("attrs"), F.array_join(F.array_sort(two), ",").alias("aligned"))


@query(f"SELECT message_id, truth AS is_truth_source, allowed AS is_allowlisted, denied AS is_denylisted FROM ({LISTS}) WHERE message_id IS NOT NULL")
def reputation_values(spark, d):
    """Reputation over all values that a scan looks up, aligned ones and envelope."""
    t = tables(spark, d)
    s = t["session"].where("message_id is not null").join(t["auth"].select("message_id", "spf"), "message_id", "left")
    none = F.lit(None).cast("string")
    c = [F.col(x) for x in ("client_hostname", "root_client_hostname", "remote_address", "envelope_from")]
    spf = F.when(F.col("spf_domain").isNotNull(), F.create_map(F.lower("spf_domain"), F.col("spf")))
    v = reputation.checked_values(reputation.aligned_attributes(*c, none, c[3], F.col("signing_domains"), spf), F.col("envelope_from"), none)
    return reputation.look_up(s.select("message_id", v.alias("attrs")), t["known"]).select("message_id", "is_truth_source", "is_allowlisted", "is_denylisted")
