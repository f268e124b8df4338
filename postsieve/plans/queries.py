"""Queries of the core library, by name: callables (spark, sf_dir) -> DataFrame, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions import idn, stem, text, urls
from postsieve.lookups import (
    ARCHIVE, ATTRIBUTE_SUFFIXES, AUTH_WEIGHTS, BODY_FAMILIES, BRANDS, CONFUSABLE, CONTEXT_PATTERNS, DATES, EXECUTABLE, GTUBE, KEYWORDS, LANGUAGE_CODES, LEGACY_OFFICE,
    MACRO_OFFICE, MACRO_SCRIPT, MACRO_TEXT, PRIVATE_SUFFIXES, RULE_SUFFIXES, SENDER_PATTERNS, SHORTENERS, SPOOFED_HOSTS, SPOOFED_NAMES, STOP_WORDS, SUBJECT_FAMILIES, SUSPICIOUS_TLDS,
)
from postsieve.operators import arf, auth, bayes, datasets, detect, reputation, rules, timestamps, toxicity, trigrams, verdict
from postsieve.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under the function's name, with the SQL for the same result where SQL can express it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(table(spark, d, "enron_dataset"), table(spark, d, "arf_result"), table(spark, d, "zone_hint"))


# --- the engine's own operators over the mail tables -------------------------------------------------------------------


def mail(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "enron_dataset").select(F.col("id").alias("message_id"), "subject", F.col("message").alias("text"), "label", "lang", "loaded_at"))


def q(text: str) -> str:
    """A string literal of the checking SQL."""
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, {q('|'.join(f'(?:{p})' for p in patterns))})"


MAIL = "SELECT id AS message_id, subject, message AS text, label, lang FROM enron_dataset"
LOW = "lower(coalesce(text, ''))"
SUBJ = "lower(coalesce(subject, ''))"
TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2 AND length(t) < 20)"
GENERAL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zà-öø-ýа-я0-9-]+'), lambda t: length(t) >= 1 AND length(t) <= 50)"


@query(f"SELECT message_id, array_to_string({TOKENS}, ' ') AS tokens, CAST(len({TOKENS}) AS INTEGER) AS n FROM ({MAIL})")
def tok_simple(spark, d):
    t = text.simple_tokens(F.coalesce("text", F.lit("")))
    return mail(spark, d).select("message_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query(f"SELECT message_id, array_to_string({GENERAL}, ' ') AS tokens, CAST(len({GENERAL}) AS INTEGER) AS n FROM ({MAIL})")
def tok_generic(spark, d):
    t = text.tokens(F.coalesce("text", F.lit("")))
    return mail(spark, d).select("message_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query(f"SELECT substring(sha256(t), 1, 16) AS token_hash, count(*) AS n FROM (SELECT unnest({TOKENS}) AS t FROM ({MAIL})) GROUP BY 1")
def tok_hash16(spark, d):
    t = text.hash_tokens(text.simple_tokens(F.coalesce("text", F.lit(""))))
    return mail(spark, d).select(F.explode(t).alias("token_hash")).groupBy("token_hash").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT message_id, array_to_string(list_filter({TOKENS}, lambda t: t NOT IN ({', '.join(map(q, STOP_WORDS))})), ' ') AS kept FROM ({MAIL})")
def stop_filter(spark, d):
    return mail(spark, d).select("message_id", F.array_join(text.drop_stop_words(text.simple_tokens(F.coalesce("text", F.lit("")))), " ").alias("kept"))


def _tagged() -> str:
    e = "coalesce(text, '')"
    for tag, p in text.TAGS:
        e = f"regexp_replace({e}, {q(p)}, ' {tag} ', 'g')"
    return e


@query(f"SELECT message_id, {_tagged()} AS tagged FROM ({MAIL})")
def pii_tags(spark, d):
    return mail(spark, d).select("message_id", text.tag_patterns(F.coalesce("text", F.lit(""))).alias("tagged"))


@query("SELECT message_id, translate(subject, " + q("".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　") + ", " + q("".join(chr(c) for c in range(0x21, 0x7F)) + " ") + f") AS half FROM ({MAIL})")
def halfwidth(spark, d):
    return mail(spark, d).select("message_id", text.half_width(F.col("subject")).alias("half"))


def _contracted() -> str:
    e = "replace(lower(text), '’', '''')"
    for a, b in text.CONTRACTIONS:
        e = f"replace({e}, {q(a)}, {q(b)})"
    return e


@query(f"SELECT message_id, {_contracted()} AS expanded, regexp_replace(text, '<[^>]*>', '', 'g') AS stripped FROM ({MAIL})")
def contractions_and_tags(spark, d):
    return mail(spark, d).select("message_id", text.expand_contractions(F.col("text")).alias("expanded"), text.strip_tags(F.col("text")).alias("stripped"))


@query(
    "SELECT lang, CASE WHEN split_part(lower(lang), '-', 1) IN ('nb', 'nn') THEN 'no' ELSE split_part(lower(lang), '-', 1) END AS locale, "
    "CASE WHEN length(lang) = 2 THEN lower(lang) " + " ".join(f"WHEN lower(lang) = {q(k)} THEN {q(v)}" for k, v in LANGUAGE_CODES.items()) + f" ELSE 'en' END AS code, count(*) AS n FROM ({MAIL}) GROUP BY 1, 2, 3"
)
def locale_codes(spark, d):
    m = mail(spark, d).select("lang", text.locale(F.col("lang")).alias("locale"), text.language_code(F.col("lang")).alias("code"))
    return m.groupBy("lang", "locale", "code").agg(F.count(F.lit(1)).alias("n"))


URLS = "list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^\\s<>\"'']+'), lambda u: regexp_replace(u, '[).,;!?]+$', ''))"


@query(f"SELECT DISTINCT message_id, unnest({URLS}) AS url FROM ({MAIL})")
def url_extract(spark, d):
    return mail(spark, d).select("message_id", F.explode(urls.raw_urls(F.col("text"))).alias("url")).distinct()


@query(f"SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM (SELECT DISTINCT message_id, unnest({URLS}) AS url FROM ({MAIL}))) GROUP BY host")
def url_hosts(spark, d):
    u = mail(spark, d).select("message_id", F.explode(urls.raw_urls(F.col("text"))).alias("url")).distinct()
    return u.select(urls.host_of(urls.normalise_url(F.col("url"))).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def _root(host: str, suffixes: list[str]) -> str:
    last = lambda n: f"array_to_string(list_slice(string_split(lower({host}), '.'), -{n}, -1), '.')"
    return f"CASE WHEN {last(2)} IN ({', '.join(map(q, suffixes))}) AND lower({host}) <> {last(2)} THEN {last(3)} ELSE {last(2)} END"


@query(f"SELECT client_hostname, {_root('client_hostname', RULE_SUFFIXES)} AS by_rules, {_root('client_hostname', ATTRIBUTE_SUFFIXES)} AS by_attributes, count(*) AS n FROM session_info WHERE client_hostname IS NOT NULL GROUP BY 1, 2, 3")
def root_domains(spark, d):
    s = table(spark, d, "session_info").where("client_hostname is not null")
    h = F.col("client_hostname")
    return s.select(h, urls.root_domain_rules(h).alias("by_rules"), urls.root_domain_attributes(h).alias("by_attributes")).groupBy("client_hostname", "by_rules", "by_attributes").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT report_id, CASE WHEN regexp_matches(originalmailfrom, '(?i)^<?srs0=[^=]+=[^=]+=([^=]+)=([^@]+)@.*$') THEN regexp_extract(originalmailfrom, '(?i)^<?srs0=[^=]+=[^=]+=([^=]+)=([^@]+)@.*$', 2) || '@' || regexp_extract(originalmailfrom, '(?i)^<?srs0=[^=]+=[^=]+=([^=]+)=([^@]+)@.*$', 1) "
    "ELSE originalmailfrom END AS address, lower(CASE WHEN contains(originalmailfrom, '@') THEN substring(originalmailfrom, position('@' IN originalmailfrom) + 1) ELSE '' END) AS host FROM arf_result WHERE originalmailfrom IS NOT NULL"
)
def srs_decode(spark, d):
    a = F.col("originalmailfrom")
    return table(spark, d, "arf_result").where("originalmailfrom is not null").select("report_id", urls.undo_srs(a).alias("address"), urls.host_of_address(a).alias("host"))


PLAIN = "regexp_replace(translate(lower(host), " + q("".join(CONFUSABLE)) + ", " + q("".join(CONFUSABLE.values())) + "), '\\.(?:com|org|net|edu|gov)$', '')"
SIM = "greatest(" + ", ".join(f"CAST(greatest(length(p), {len(b)}) - levenshtein(p, {q(b)}) AS DOUBLE) / greatest(length(p), {len(b)})" for b in BRANDS) + ")"


@query(f"SELECT host, round({SIM}, 9) AS brand_similarity, CAST(CASE WHEN {SIM} > 0.8 THEN 1 ELSE 0 END AS INTEGER) AS over FROM (SELECT host, {PLAIN} AS p FROM (SELECT DISTINCT root_client_hostname AS host FROM session_info WHERE root_client_hostname IS NOT NULL))")
def idn_brand(spark, d):
    h = table(spark, d, "session_info").where("root_client_hostname is not null").select(F.col("root_client_hostname").alias("host")).distinct()
    s = idn.brand_similarity(F.col("host"))
    return h.select("host", F.round(s, 9).alias("brand_similarity"), (s > 0.8).cast("int").alias("over"))


CONTEXT = "CAST(0 AS DOUBLE) " + " ".join(f"+ CASE WHEN regexp_matches({LOW}, {q(p)}) THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for p in CONTEXT_PATTERNS)


@query(f"SELECT message_id, round({CONTEXT}, 6) AS context, ({CONTEXT}) > CAST(0.3 AS DOUBLE) AS flagged FROM ({MAIL})")
def idn_context(spark, d):
    c = idn.context_score(F.col("text"), F.lit(False))
    return mail(spark, d).select("message_id", F.round(c, 6).alias("context"), (c > 0.3).alias("flagged"))


@query("SELECT message_id, " + ", ".join(f"{any_of(LOW, ps)} AS {kind}" for kind, ps in MACRO_TEXT.items()) + f" FROM ({MAIL})")
def macro_text(spark, d):
    kinds = detect.macro_text(F.col("text"))
    return mail(spark, d).select("message_id", *(F.array_contains(kinds, k).alias(k) for k in MACRO_TEXT))


@query("SELECT message_id, " + ", ".join(f"CAST(len(regexp_extract_all({LOW}, {q(p)})) AS INTEGER) AS d{i}" for i, p in enumerate(DATES)) + f" FROM ({MAIL})")
def date_counts(spark, d):
    return mail(spark, d).select("message_id", *(c.cast("int").alias(f"d{i}") for i, c in enumerate(detect.date_counts(F.col("text")))))


@query(f"SELECT message_id, contains(coalesce(text, ''), {q(GTUBE)}) AS gtube FROM ({MAIL})")
def gtube(spark, d):
    return mail(spark, d).select("message_id", detect.gtube(F.coalesce("text", F.lit(""))).alias("gtube"))


SUFFIXES = "exe docm xls vbs pdf zip iso jar png js docx xlsm"
EXT = f"list_extract(string_split('{SUFFIXES}', ' '), CAST(id % 12 AS INTEGER) + 1)"


@query(
    f"SELECT id AS message_id, {EXT} AS ext, {EXT} IN ({', '.join(map(q, EXECUTABLE))}) AS executable, {EXT} IN ({', '.join(map(q, ARCHIVE))}) AS archive, "
    f"CASE WHEN {EXT} IN ({', '.join(map(q, MACRO_SCRIPT))}) THEN 'script' WHEN {EXT} IN ({', '.join(map(q, MACRO_OFFICE))}) THEN 'office_document' WHEN {EXT} IN ({', '.join(map(q, LEGACY_OFFICE))}) THEN 'legacy_office' END AS macro FROM enron_dataset"
)
def attachment_names(spark, d):
    name = F.concat(F.lit("file"), F.col("message_id").cast("string"), F.lit("."), F.element_at(F.split(F.lit(SUFFIXES), " "), (F.col("message_id") % 12).cast("int") + 1))
    m = mail(spark, d).select("message_id", name.alias("name"))
    n = F.col("name")
    return m.select("message_id", detect.extension(n).alias("ext"), detect.executable_by_name(n).alias("executable"), detect.archive_by_name(n).alias("archive"), detect.macro_by_name(n).alias("macro"))


def _sum(cases: list[tuple[str, int]]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in cases) + " AS INTEGER)"


LETTERS = "len(regexp_extract_all(coalesce(subject, ''), '[A-Za-z]'))"
SUBJECT_CASES = [
    *((f"regexp_matches({SUBJ}, {q(p)})", 1) for p in SUBJECT_FAMILIES),
    (f"{LETTERS} > 10 AND len(regexp_extract_all(coalesce(subject, ''), '[A-Z]'))::DOUBLE / {LETTERS} > 0.7", 2),
    ("len(regexp_extract_all(coalesce(subject, ''), '[!?$]')) >= 3", 1),
    (f"regexp_matches({SUBJ}, '^(?:re|fw|fwd):') AND length(coalesce(subject, '')) < 20", 1),
]
BODY_CASES = [*((f"regexp_matches({LOW}, {q(p)})", 1) for p in BODY_FAMILIES), (f"regexp_matches({LOW}, {q(SHORTENERS)})", 2)]


@query(f"SELECT message_id, {_sum(SUBJECT_CASES)} AS score FROM ({MAIL})")
def rule_subject(spark, d):
    return mail(spark, d).select("message_id", rules.subject_rules(F.col("subject"))["score"].alias("score"))


@query(f"SELECT message_id, {_sum(BODY_CASES)} AS score FROM ({MAIL})")
def rule_body(spark, d):
    return mail(spark, d).select("message_id", rules.body_rules(F.col("text"), F.lit(None).cast("string"))["score"].alias("score"))


@query(f"SELECT message_id, {_sum([(f'contains({LOW}, {q(k)})', w) for k, w in KEYWORDS.items()])} AS score FROM ({MAIL})")
def rule_keywords(spark, d):
    return mail(spark, d).select("message_id", rules.keyword_rules(F.col("text"))["score"].alias("score"))


FROM = "lower(coalesce(originalmailfrom, ''))"
SENDER = [
    (f"{FROM} = ''", 2),
    (f"{FROM} <> '' AND (" + " OR ".join(f"regexp_matches({FROM}, {q(p)})" for p in SENDER_PATTERNS) + ")", 2),
    (f"{FROM} <> '' AND regexp_extract({FROM}, '@[^.]+\\.([a-z]+)$', 1) IN ({', '.join(map(q, SUSPICIOUS_TLDS))})", 2),
    (f"{FROM} <> '' AND regexp_matches({FROM}, {q(SPOOFED_NAMES)}) AND NOT regexp_matches({FROM}, {q(SPOOFED_HOSTS)})", 3),
]


@query(f"SELECT report_id, {_sum(SENDER)} AS score FROM arf_result")
def rule_sender(spark, d):
    return table(spark, d, "arf_result").select("report_id", rules.sender_rules(F.col("originalmailfrom"), F.lit(None).cast("string"))["score"].alias("score"))


def _norm(c: str) -> str:
    return f"coalesce(nullif(lower(trim({c})), ''), 'none')"


AUTH_CASES = [x for k, (good, bad) in AUTH_WEIGHTS.items() for x in ((f"{_norm(k)} = 'pass'", good), (f"{_norm(k)} = 'fail'", bad))] + [(f"{_norm('spf')} = 'softfail'", 1)]


@query(f"SELECT message_id, {_sum(AUTH_CASES)} AS score, concat_ws(';', 'mx', 'dkim=' || dkim, 'spf=' || spf, 'dmarc=' || dmarc, 'arc=' || arc) AS header FROM auth_result")
def auth_score(spark, d):
    c = [F.col(k) for k in ("dkim", "spf", "dmarc", "arc")]
    h = auth.header("mx", c[0], c[1], F.lit(None).cast("string"), c[2], c[3])
    return table(spark, d, "auth_result").select("message_id", auth.score(*c)["score"].alias("score"), F.replace(h, F.lit(";\n\t"), F.lit(";")).alias("header"))


@query(
    "WITH v AS (SELECT DISTINCT message_id, unnest([client_hostname, root_client_hostname, remote_address, envelope_from, split_part(envelope_from, '@', 2)]) AS value FROM session_info), "
    "f AS (SELECT message_id, lower(trim(value)) AS value FROM v WHERE value IS NOT NULL AND trim(value) <> '') "
    "SELECT message_id, bool_or(coalesce(is_truth_source, false)) AS is_truth_source, bool_or(coalesce(is_allowlisted, false)) AS is_allowlisted, bool_or(coalesce(is_denylisted, false)) AS is_denylisted "
    "FROM f LEFT JOIN reputation r ON r.reputation_value = f.value GROUP BY message_id"
)
def reputation_agg(spark, d):
    s = table(spark, d, "session_info")
    values = F.array(F.col("client_hostname"), F.col("root_client_hostname"), F.col("remote_address"), F.col("envelope_from"), F.when(F.col("envelope_from").contains("@"), F.split_part("envelope_from", F.lit("@"), F.lit(2))))
    attrs = F.array_distinct(F.filter(F.transform(F.array_compact(values), lambda v: F.lower(F.trim(v))), lambda v: v != ""))
    found = reputation.look_up(s.select("message_id", attrs.alias("attrs")), table(spark, d, "reputation"))
    return found.select("message_id", "is_truth_source", "is_allowlisted", "is_denylisted")


@query(
    "SELECT report_id, CASE WHEN trim(coalesce(feedbacktype, '')) = '' THEN 'no feedback type' WHEN trim(coalesce(useragent, '')) = '' THEN 'no user agent' END AS error, "
    "CASE WHEN ok THEN CASE WHEN lower(trim(feedbacktype)) IN ('abuse', 'fraud', 'virus', 'other', 'not-spam', 'auth-failure', 'dmarc') THEN lower(trim(feedbacktype)) ELSE 'other' END END AS feedback_type, CASE WHEN ok THEN sourceip END AS source_ip, "
    "CASE WHEN ok AND trim(coalesce(originalmailfrom, '')) <> '' THEN CASE WHEN regexp_matches(originalmailfrom, '<[^>]+>') THEN regexp_extract(originalmailfrom, '<([^>]+)>', 1) WHEN regexp_matches(originalmailfrom, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+') THEN regexp_extract(originalmailfrom, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+') ELSE trim(originalmailfrom) END END AS mail_from, "
    "CASE WHEN ok THEN array_to_string(originalrcptto, ',') END AS rcpt, CASE WHEN ok THEN coalesce(incidents, 1) END AS incidents, CASE WHEN ok AND reportingmta.name IS NOT NULL THEN lower(reportingmta.type) || '/' || reportingmta.name END AS mta, "
    "CASE WHEN ok THEN array_to_string(reporteddomain, ',') END AS domains, CASE WHEN ok THEN originalenvelopeid END AS envelope, CASE WHEN ok THEN coalesce(is_allowlisted, false) END AS allowed "
    "FROM (SELECT *, trim(coalesce(feedbacktype, '')) <> '' AND trim(coalesce(useragent, '')) <> '' AS ok FROM arf_result) LEFT JOIN reputation ON reputation_value = sourceip"
)
def arf_roundtrip(spark, d):
    """Reports written with the mail that each is about, parsed again, and their source address looked up."""
    mails = table(spark, d, "enron_dataset").groupBy(F.col("id").alias("message_id")).agg(F.min(F.struct("loaded_at", "subject", "message")).alias("m"))
    r = table(spark, d, "arf_result").join(mails, "message_id", "left")
    original = F.concat(F.lit("Subject: "), F.coalesce(F.regexp_replace("m.subject", r"[\r\n]+", " "), F.lit("")), F.lit("\n\n"), F.coalesce("m.message", F.lit("")))
    mta = F.concat("reportingmta.type", F.lit("; "), "reportingmta.name")
    raw = arf.create(F.col("report_id"), F.col("feedbacktype"), F.col("useragent"), F.col("sourceip"), F.col("originalmailfrom"), F.col("originalrcptto"), F.lit(None).cast("string"), F.coalesce("humanreadable", F.lit("")), original, mta, F.col("reporteddomain"), F.col("incidents"), F.col("originalenvelopeid"))
    p = arf.with_reputation(arf.parse(r.select("report_id", raw.alias("raw"))), table(spark, d, "reputation"))
    ok = F.col("error").isNull()
    return p.select(
        "report_id", "error", F.col("arf.feedback_type").alias("feedback_type"), F.col("arf.source_ip").alias("source_ip"), F.col("arf.original_mail_from").alias("mail_from"), F.array_join("arf.original_rcpt_to", ",").alias("rcpt"), F.col("arf.incidents").alias("incidents"),
        F.concat("arf.reporting_mta.type", F.lit("/"), "arf.reporting_mta.name").alias("mta"), F.array_join("arf.reported_domain", ",").alias("domains"), F.col("arf.original_envelope_id").alias("envelope"), F.when(ok, F.col("is_allowlisted")).alias("allowed"),
    )


FOLD = "(CAST('0x' || substring(sha256(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 5)"
LABEL = "CASE WHEN label = 1 THEN 'spam' ELSE 'ham' END"
COUNTS = f"SELECT category, token, CAST(count(*) * CASE WHEN category = 'ham' THEN 2 ELSE 1 END AS BIGINT) AS n FROM (SELECT {LABEL} AS category, unnest({TOKENS}) AS token FROM ({MAIL}) WHERE label IS NOT NULL) GROUP BY category, token"


def _labelled(spark, d):
    return mail(spark, d).where("label is not null").select(F.col("message_id").alias("id"), F.when(F.col("label") == 1, "spam").otherwise("ham").alias("category"), text.simple_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(COUNTS)
def nb_train(spark, d):
    return bayes.train(_labelled(spark, d)).counts.select("category", "token", F.col("n").cast("long").alias("n"))


@query(f"SELECT token, CAST(sum(n) AS BIGINT) AS n FROM ({COUNTS}) GROUP BY token ORDER BY sum(n) DESC, token LIMIT 500")
def nb_vocab_topk(spark, d):
    return bayes.vocabulary(bayes.train(_labelled(spark, d)).counts, 500)


def _bayes_sql(train: str, test: str, last: str) -> str:
    """Log posteriors x(id, category, score) of the rows `test` under a model of the rows `train`, and a query over them."""
    counts = COUNTS.replace(f"FROM ({MAIL}) WHERE label", f"FROM ({train}) WHERE label")
    return (
        f"WITH c AS ({counts}), p AS (SELECT {LABEL} AS category, count(*) AS docs FROM ({train}) WHERE label IS NOT NULL GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v FROM c), "
        "t AS (SELECT category, sum(n) AS total FROM c GROUP BY category), b AS (SELECT p.category, ln(p.docs / (SELECT sum(docs) FROM p)) AS prior, CAST(t.total + v.v AS DOUBLE) AS below FROM p JOIN t USING (category), v), "
        f"d AS (SELECT DISTINCT message_id AS id FROM ({test}) WHERE label IS NOT NULL), tf AS (SELECT id, token, count(*) AS tf FROM (SELECT message_id AS id, unnest({TOKENS}) AS token FROM ({test}) WHERE label IS NOT NULL) WHERE token IN (SELECT token FROM c) GROUP BY id, token), "
        "s AS (SELECT tf.id, b.category, sum(tf.tf * ln((coalesce(c.n, 0) + 1) / b.below)) AS s FROM tf CROSS JOIN b LEFT JOIN c ON c.token = tf.token AND c.category = b.category GROUP BY tf.id, b.category), "
        f"x AS (SELECT d.id, b.category, b.prior + coalesce(s.s, 0) AS score FROM d CROSS JOIN b LEFT JOIN s ON s.id = d.id AND s.category = b.category) {last}"
    )


BEST = "SELECT id, arg_max(category, score + CASE WHEN category = 'ham' THEN 1e-9 ELSE 0 END) AS category FROM x GROUP BY id"
SPLIT = "SELECT id AS message_id, id, message AS text, label FROM enron_dataset WHERE {} {} 0"


@query(_bayes_sql(MAIL, MAIL, BEST))
def nb_classify(spark, d):
    docs = _labelled(spark, d)
    return bayes.classify(docs.select("id", "tokens"), bayes.train(docs))


@query(f"SELECT count(*) AS rows, CAST(count_if(label = 0) AS BIGINT) AS ham, CAST(count_if(label = 1) AS BIGINT) AS spam, round(least(count_if(label = 0), count_if(label = 1)) / greatest(count_if(label = 0), count_if(label = 1))::DOUBLE, 6) AS balance FROM ({MAIL})")
def dataset_validate(spark, d):
    return datasets.balance(mail(spark, d), "label").select("rows", "ham", "spam", F.round("balance", 6).alias("balance"))


@query("SELECT sha256(message) AS hash, count(*) AS n FROM enron_dataset WHERE message IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dataset_duplicates(spark, d):
    return datasets.duplicates(table(spark, d, "enron_dataset"), "message")


@query("SELECT id, label, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id, loaded_at) AS k, count(*) OVER (PARTITION BY label) AS n FROM enron_dataset)")
def holdout_split(spark, d):
    return datasets.holdout(table(spark, d, "enron_dataset").select("id", "label", "loaded_at"), "label", ["id", "loaded_at"]).select("id", "label", "part")


@query(f"SELECT message_id, CAST(len({TOKENS}) AS INTEGER) AS tokens, CAST(len(regexp_extract_all(coalesce(text, ''), 'https?://')) AS INTEGER) AS urls, length(coalesce(subject, '')) AS subject_length, regexp_matches(coalesce(text, ''), '[0-9]') AS has_digits FROM ({MAIL})")
def feature_vector(spark, d):
    m = mail(spark, d).select("message_id", text.features(F.coalesce("subject", F.lit("")), F.coalesce("text", F.lit("")), F.lit(0)).alias("f"))
    return m.select("message_id", "f.tokens", F.col("f.urls").cast("int").alias("urls"), F.col("f.subject_length").cast("long").alias("subject_length"), "f.has_digits")


@query()
def stem_by_language(spark, d):
    """Stems of all tokens of all mails, by the declared language of the mail."""
    tokens = mail(spark, d).select(text.locale(F.col("lang")).alias("lang"), F.explode(text.tokens(F.coalesce("text", F.lit("")))).alias("token")).where("lang is not null")
    counted = tokens.groupBy("token", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(stem.stems(counted), ["token", "lang"]).groupBy("lang", "stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))


@query()
def stem_en(spark, d):
    tokens = mail(spark, d).select(F.explode(text.simple_tokens(F.coalesce("text", F.lit("")))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(stem.stems(counted), "token").groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))


PLAIN_TEXT = "regexp_replace(regexp_replace(lower(coalesce(text, '')), '[0-9\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E\\s]+', ' ', 'g'), '^ | $', '', 'g')"
TRIGRAMS = f"list_distinct(list_transform(range(1, greatest(length({PLAIN_TEXT}) - 1, 1)), lambda i: substring({PLAIN_TEXT}, i, 3)))"


DETECTED = (
    f"WITH t AS (SELECT lower(lang) AS lang, unnest({TRIGRAMS}) AS trigram FROM ({MAIL}) WHERE lower(lang) IN ('en', 'de', 'fr', 'es', 'it', 'nl', 'pt', 'ru')), "
    "p AS (SELECT lang, trigram FROM (SELECT lang, trigram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, trigram) AS k FROM t GROUP BY lang, trigram) WHERE k <= 200), "
    f"e AS (SELECT message_id AS id, unnest({TRIGRAMS}) AS trigram FROM (SELECT DISTINCT message_id, text FROM ({MAIL}))), "
    "s AS (SELECT id, lang, count(*) AS shared FROM e JOIN p USING (trigram) GROUP BY id, lang), "
    "r AS (SELECT id, lang, shared, row_number() OVER (PARTITION BY id ORDER BY shared DESC, lang DESC) AS k FROM s) SELECT id, lang, shared FROM r WHERE k = 1"
)
PROFILED = ("en", "de", "fr", "es", "it", "nl", "pt", "ru")


def _profile(spark, d):
    m = mail(spark, d).select(F.col("message_id").alias("id"), "text", F.lower("lang").alias("lang"))
    return m, trigrams.profiles(m.where(F.col("lang").isin(*PROFILED)))


@query(DETECTED)
def lang_detect(spark, d):
    m, profile = _profile(spark, d)
    return trigrams.detect(m.select("id", "text"), profile).distinct()


@query(f"SELECT 'profile' AS method, count_if(a.lang = b.lang)::BIGINT AS correct, count(*) AS n, round(count_if(a.lang = b.lang) / count(*), 6) AS accuracy FROM (SELECT DISTINCT id, lower(lang) AS lang FROM enron_dataset WHERE lower(lang) IN ('en', 'de', 'fr', 'es', 'it', 'nl', 'pt', 'ru')) b LEFT JOIN ({DETECTED}) a USING (id)")
def lang_compare(spark, d):
    """How often the detected language is the declared one."""
    m, profile = _profile(spark, d)
    lists = trigrams.as_lists(profile)
    seen = m.where(F.col("lang").isin(*PROFILED)).select("id", "lang", trigrams.best(F.col("text"), lists)["lang"].alias("profile")).distinct()
    return datasets.compare(seen, "lang", "profile").select("method", "correct", "n", F.round("accuracy", 6).alias("accuracy"))


PLAIN_LANG = "regexp_matches(trim(t), '^[^A-Za-z_]*$')"


@query(
    f"SELECT m.id, CASE WHEN length(coalesce(t, '')) < 3 OR {PLAIN_LANG} THEN 'en' WHEN length(t) < 50 AND NOT (regexp_matches(t, '[^\\x00-\\x{{24F}}\\x{{1E00}}-\\x{{1EFF}}]') OR length(t) >= 7 OR coalesce(a.lang, 'en') = 'en') THEN 'en' "
    f"WHEN coalesce(a.lang, 'en') IN ('en', 'de', 'fr') THEN coalesce(a.lang, 'en') ELSE 'en' END AS lang FROM (SELECT DISTINCT id, message AS t FROM enron_dataset) m LEFT JOIN ({DETECTED}) a USING (id)"
)
def lang_hybrid(spark, d):
    """Guards, short texts and a list of supported languages around the profiles."""
    m, profile = _profile(spark, d)
    return m.select("id", trigrams.hybrid(F.col("text"), trigrams.as_lists(profile), ["en", "de", "fr"]).alias("lang")).distinct()


FLAGS = f"SELECT message_id, {any_of(LOW, sum(MACRO_TEXT.values(), []))} AS macros, {_sum(SUBJECT_CASES)} + {_sum(BODY_CASES)} >= 2 AS arbitrary FROM ({MAIL})"


@query(f"SELECT message_id, macros OR arbitrary AS is_spam, CASE WHEN macros AND arbitrary THEN 'Spam (macro detected and arbitrary patterns)' WHEN macros THEN 'Spam (macro detected)' WHEN arbitrary THEN 'Spam (arbitrary patterns)' ELSE 'Ham' END AS message FROM ({FLAGS})")
def verdict_message(spark, d):
    m = mail(spark, d)
    some = rules.subject_rules(F.col("subject"))["score"] + rules.body_rules(F.col("text"), F.lit(None).cast("string"))["score"]
    f = m.select("message_id", (F.size(detect.macro_text(F.col("text"))) > 0).alias("macros"), (some >= 2).alias("arbitrary"))
    flags = {"macros": F.col("macros"), "arbitrary": F.col("arbitrary")}
    return f.select("message_id", verdict.is_spam(flags).alias("is_spam"), verdict.message(flags, F.lit(False), F.lit(False)).alias("message"))


@query(
    f"SELECT message_id, CAST({_sum(AUTH_CASES)} AS DOUBLE) AS score, CASE WHEN {_sum(AUTH_CASES)} >= 5 THEN 'YES' ELSE 'NO' END AS flag FROM auth_result"
)
def weighted_score(spark, d):
    a = table(spark, d, "auth_result")
    off = F.lit(False)
    s = verdict.weighted_score({"phishing": F.lit(0)}, F.lit(0.5), auth.score(*(F.col(k) for k in ("dkim", "spf", "dmarc", "arc")))["score"], off, off, off)
    h = verdict.headers(F.col("score"), F.col("score") >= 5, F.array(F.lit("T")))
    return a.select("message_id", s.alias("score")).select("message_id", "score", F.try_element_at(h, F.lit("X-Spam-Flag")).alias("flag"))


@query(
    "SELECT message_id, 'Subject: ' || regexp_extract(s, '^[ \t]*') || CASE WHEN starts_with(ltrim(s, ' ' || chr(9)), '[SPAM]') THEN '' ELSE '[SPAM] ' END || regexp_replace(s, '^[ \t]*', '') || chr(10) || 'X-Spam-Flag: YES' || chr(10) || chr(10) || coalesce(text, '') AS raw "
    "FROM (SELECT message_id, text, regexp_replace(coalesce(subject, ''), '[\\r\\n]+[ \t]*', chr(10) || ' ', 'g') AS s FROM (" + MAIL + "))"
)
def rewrite_message(spark, d):
    """Every mail as a raw message, its subject folded where it has line breaks, with a header line and a tag."""
    folded = F.regexp_replace(F.coalesce("subject", F.lit("")), r"[\r\n]+[ \t]*", "\n ")
    m = mail(spark, d).select("message_id", F.concat(F.lit("Subject: "), folded, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("raw"))
    return m.select("message_id", verdict.rewrite(F.col("raw"), F.lit("X-Spam-Flag: YES"), F.lit("[SPAM]")).alias("raw"))


@query()
def toxicity_lr(spark, d):
    """Trained on the spam label, which stands in for one of toxicity."""
    m = mail(spark, d).select(F.col("message_id").alias("id"), detect.toxicity_input(F.col("subject"), F.col("text"), F.lit(None).cast("string")).alias("text"), F.col("label").cast("double").alias("label"))
    return toxicity.score(toxicity.train(m), m.select("id", "text")).select("id", F.round("toxicity", 4).alias("toxicity"), "toxic")


@query("SELECT source, id, 'merged_' || (row_number() OVER (ORDER BY source, id, t) - 1) AS merged_id FROM (SELECT 'mail' AS source, id, loaded_at AS t FROM enron_dataset UNION ALL SELECT 'reports', report_id, loaded_at FROM arf_result)")
def dataset_merge(spark, d):
    parts = {"mail": table(spark, d, "enron_dataset").select("id", F.col("loaded_at").alias("at")), "reports": table(spark, d, "arf_result").select(F.col("report_id").alias("id"), F.col("loaded_at").alias("at"))}
    return datasets.merge(parts, ["id", "at"]).select("source", "id", "merged_id")


@query("SELECT id, row_number() OVER (ORDER BY sha256(id || '|' || 'seed-1'), id, loaded_at) AS k FROM enron_dataset")
def dataset_shuffle(spark, d):
    m = table(spark, d, "enron_dataset").select("id", "loaded_at").withColumn("h", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit("seed-1")), 256))
    return datasets.numbered(m, [], ["h", "id", "loaded_at"]).select("id", "k")



@query(f"SELECT id, CAST({FOLD} AS INTEGER) AS fold FROM enron_dataset")
def dataset_folds(spark, d):
    return datasets.folds(table(spark, d, "enron_dataset").select("id"), "id", 5)


@query(f"SELECT CAST(least((SELECT count(DISTINCT t) FROM (SELECT unnest({TOKENS}) AS t FROM ({MAIL}) WHERE label IS NOT NULL)), floor((SELECT count(*) FROM ({MAIL}) WHERE label IS NOT NULL) * 0.1)) AS BIGINT) AS vocabulary")
def dynamic_vocabulary(spark, d):
    return bayes.dynamic_limit(_labelled(spark, d)).select(F.col("vocabulary").cast("long").alias("vocabulary"))


@query(
    _bayes_sql(SPLIT.format(FOLD, "<>"), SPLIT.format(FOLD, "="), f"SELECT l.label, y.category, count(*) AS n FROM ({BEST}) y JOIN (SELECT DISTINCT id, {LABEL} AS label FROM enron_dataset WHERE label IS NOT NULL) l USING (id) GROUP BY 1, 2")
)
def nb_accuracy(spark, d):
    """Trained on four fifths of the mails, by the hash of their ids, and judged on the rest."""
    docs = datasets.folds(_labelled(spark, d), "id", 5)
    held = docs.where("fold = 0")
    return bayes.accuracy(bayes.classify(held.select("id", "tokens"), bayes.train(docs.where("fold <> 0"))), held.select("id", F.col("category").alias("label")).distinct())


@query(_bayes_sql(MAIL, MAIL, "SELECT id, category, round(exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY id), 6) AS probability FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM x)"))
def nb_probabilities(spark, d):
    docs = _labelled(spark, d)
    return bayes.probabilities(docs.select("id", "tokens"), bayes.train(docs)).select("id", "category", F.round("probability", 6).alias("probability"))


@query(COUNTS)
def nb_incremental(spark, d):
    """A model of some of the mails, continued with the others, is the model of all."""
    docs = datasets.folds(_labelled(spark, d), "id", 5)
    m = bayes.merge(bayes.train(docs.where("fold < 2")), bayes.train(docs.where("fold >= 2")))
    return m.counts.select("category", "token", F.col("n").cast("long").alias("n"))


ANON = "regexp_replace(regexp_replace(regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b', '[EMAIL]', 'g'), '\\b\\d{3}-\\d{3}-\\d{4}\\b', '[PHONE]', 'g'), '\\b\\d{4}[ -]?\\d{4}[ -]?\\d{4}[ -]?\\d{4}\\b', '[CARD]', 'g')"


@query(f"SELECT message_id, {ANON} AS masked FROM ({MAIL})")
def anonymise(spark, d):
    return mail(spark, d).select("message_id", text.anonymise(F.col("text")).alias("masked"))


_REST = "regexp_replace(regexp_replace(u, '(?i)^https?://', ''), '#.*$', '')"
NORMAL_URL = (
    f"lower(regexp_extract(u, '(?i)^(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract({_REST}, '^([^/?]*)', 1)), ':(?:80|443)$', '') || regexp_replace(regexp_extract({_REST}, '^[^/?]*([^?]*)', 1), '/$', '') || "
    f"coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract({_REST}, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), ''), '')"
)


@query(f"SELECT message_id, unnest(list_distinct(list_transform({URLS}, lambda u: {NORMAL_URL}))) AS url FROM ({MAIL})")
def url_normalise(spark, d):
    return mail(spark, d).select("message_id", F.explode(urls.urls(F.col("text"))).alias("url"))


TWO = "array_to_string(list_slice(string_split(h, '.'), -2, -1), '.')"


@query(
    f"SELECT h AS client_hostname, CASE WHEN NOT ip AND n > k THEN array_to_string(list_slice(string_split(h, '.'), -(k + 1), -1), '.') END AS domain, CASE WHEN NOT ip AND n > k THEN list_extract(string_split(h, '.'), -(k + 1)) END AS sld, "
    f"CASE WHEN NOT ip THEN array_to_string(list_slice(string_split(h, '.'), -k, -1), '.') END AS suffix, CASE WHEN NOT ip AND n > k THEN array_to_string(list_slice(string_split(h, '.'), 1, n - k - 1), '.') END AS subdomain, ip AS is_ip "
    f"FROM (SELECT h, len(string_split(h, '.')) AS n, CASE WHEN {TWO} IN ({', '.join(map(q, ATTRIBUTE_SUFFIXES + PRIVATE_SUFFIXES))}) THEN 2 ELSE 1 END AS k, regexp_matches(h, '^(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') OR regexp_matches(h, '^\\[?[0-9a-f:]*:[0-9a-f:.]*\\]?$') AS ip FROM (SELECT DISTINCT lower(client_hostname) AS h FROM session_info WHERE client_hostname IS NOT NULL))"
)
def public_suffixes(spark, d):
    h = table(spark, d, "session_info").where("client_hostname is not null").select(F.lower("client_hostname").alias("client_hostname")).distinct()
    s = urls.public_suffix(F.col("client_hostname"))
    return h.select("client_hostname", s["domain"].alias("domain"), s["sld"].alias("sld"), s["suffix"].alias("suffix"), s["subdomain"].alias("subdomain"), s["is_ip"].alias("is_ip"))


@query(
    f"SELECT message_id, host FROM (SELECT DISTINCT message_id, lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM (SELECT message_id, unnest({URLS}) AS url FROM ({MAIL}))) WHERE host IN (SELECT reputation_value FROM reputation)"
)
def blocked_hosts(spark, d):
    blocked = table(spark, d, "reputation").select(F.col("reputation_value").alias("host"))
    return detect.blocked_hosts(mail(spark, d), blocked).select("message_id", "host")
