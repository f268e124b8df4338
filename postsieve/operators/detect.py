"""Detectors: each says of a mail, or of an attachment, whether and why it is suspicious."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions import idn, urls
from postsieve.functions.patterns import any_of, count, java, let
from postsieve.lookups import ARCHIVE, DATES, EXECUTABLE, GTUBE, IDN_WHITELIST, LEGACY_OFFICE, MACRO_OFFICE, MACRO_SCRIPT, MACRO_TEXT, MAGIC

#: Names of HTML elements, whose closing tags look like paths.
HTML_TAGS = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup data datalist dd del details dfn dialog "
    "div dl dt em embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta "
    "meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video wbr"
).split()
#: What counts as a path; the class leaves out the letter s and takes in blanks.
PATHS = [r"(?i)[a-z]:\\\\[^\\s<>:\"|?*]+", r"/[^\\s<>:\"|?*]+", r"~/[^\\s<>:\"|?*]+"]


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9_]+)\z", 1))


def executable_by_name(filename: Column) -> Column:
    return extension(filename).isin(*EXECUTABLE)


def archive_by_name(filename: Column) -> Column:
    return extension(filename).isin(*ARCHIVE)


def executable_by_content(content: Column) -> Column:
    """Extension of the kind of executable that the first bytes tell, null if none. Archives and scripts are none."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for magic, kind in MAGIC.items():
        hit = head.startswith(magic)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def macro_by_name(filename: Column) -> Column:
    e = extension(filename)
    return F.when(e.isin(*MACRO_SCRIPT), "script").when(e.isin(*MACRO_OFFICE), "office_document").when(e.isin(*LEGACY_OFFICE), "legacy_office")


def pdf_script(filename: Column, content: Column) -> Column:
    text = F.decode(content, "ISO-8859-1")
    return (extension(filename) == "pdf") & F.coalesce(text.contains("/JavaScript") | text.contains("/JS"), F.lit(False))


def macro_text(text: Column) -> Column:
    """Kinds of macro code in a text, in fixed order."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_compact(F.array(*(F.when(any_of(low, ps), kind) for kind, ps in MACRO_TEXT.items()))))


def date_counts(text: Column) -> list[Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return [count(low, p) for p in DATES]


def date_findings(text: Column) -> Column:
    """array<int>: how often each date pattern that occurs more than five times does."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(F.array(*(count(low, p) for p in DATES)), lambda n: n > 5))


def date_spam(text: Column) -> Column:
    return F.size(date_findings(text)) > 0


def file_paths(text: Column) -> Column:
    """What looks like a file path, closing tags, short pieces and bare domains left out."""
    t = F.coalesce(text, F.lit(""))
    found = F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(p), 0) for p in PATHS)))
    tag = lambda p: F.lower(F.regexp_extract(p, r"^/([A-Za-z0-9]+)\z", 1)).isin(*HTML_TAGS)
    return F.filter(found, lambda p: ~tag(p) & (F.length(p) >= 4) & ~p.rlike(r"^//[A-Za-z0-9.-]+\z") & (p.contains(".") | p.contains("/")))


def gtube(text: Column) -> Column:
    return F.coalesce(text.contains(GTUBE), F.lit(False))


def virus(content: Column) -> Column:
    """The literal anti-virus test string; other signatures are joined on sha2(content, 256) by virus_hits."""
    return F.coalesce(F.decode(content, "ISO-8859-1").contains("EICAR-STANDARD-ANTIVIRUS-TEST-FILE"), F.lit(False))


def virus_hits(attachments: DataFrame, signatures: DataFrame) -> DataFrame:
    """attachments(message_id, filename, content) against signatures(sha256, name)."""
    return attachments.withColumn("sha256", F.sha2("content", 256)).join(signatures, "sha256").select("message_id", "filename", "name")


def toxicity_input(subject: Column, text: Column, html: Column, limit: int | None = None) -> Column:
    """Text a toxicity model reads: parts that aren't blank, whole or the first `limit` characters (5000 in the reference); null below 10."""
    part = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    joined = F.concat_ws(" ", part(subject), part(text), part(F.regexp_replace(html, "<[^>]*>", "")))
    joined = joined if limit is None else F.substring(joined, 1, limit)
    return F.when(F.length(joined) >= 10, joined)


def url_hosts(text: Column) -> Column:
    """array<struct<host, fragment>> of a text's distinct URLs; fragment: whether the URL has one, so that what is shown differs from what is linked."""
    each = F.transform(urls.raw_urls(text), lambda u: F.struct(urls.host_of(u).alias("host"), u.contains("#").alias("fragment")))
    return F.filter(each, lambda x: x["host"] != "")


def host_findings(text: Column, content: Column | None = None) -> Column:
    """array<struct<host, risk, type>> of the hosts of a text's URLs: type is phishing above 0.6, suspicious above 0.3, else null.

    content: what the context is read from, the text by default. Its share is computed once a mail, and only where there are URLs.
    """

    def over(hosts: Column) -> Column:
        context = F.when(F.size(hosts) > 0, idn.text_score(text if content is None else content))

        def one(x: Column, add: Column) -> Column:
            host = idn.host_score(x["host"])
            shown = F.when(x["fragment"], F.lit(0.3)).otherwise(F.lit(0.0))
            score = F.when(x["host"].isin(*IDN_WHITELIST), F.lit(0.0)).otherwise(host["before"] + (shown + add) + host["after"])
            return let(score, lambda r: F.struct(x["host"].alias("host"), r.alias("risk"), F.when(r > 0.6, "phishing").when(r > 0.3, "suspicious").alias("type")))

        return let(context, lambda add: F.transform(hosts, lambda x: one(x, add)))

    return let(url_hosts(text), over)


def host_risk(mail: DataFrame) -> DataFrame:
    """mail(message_id, text) -> one row per message and host of its URLs: host, risk, type (phishing, suspicious or null), without a join.

    A host of several URLs has the greatest of their risks.
    """
    found = mail.select("message_id", F.explode(host_findings(F.col("text"))).alias("x")).groupBy("message_id", "x.host").agg(F.max("x.risk").alias("risk"))
    return found.withColumn("type", F.when(F.col("risk") > 0.6, "phishing").when(F.col("risk") > 0.3, "suspicious"))


def attachment_findings(attachments: Column) -> Column:
    """struct of counts over array<struct<filename, content_type, content>>: executables (by name and by content), archives, macros, scripts in PDF
    files, and viruses (the test string)."""
    files = F.coalesce(attachments, F.array().cast("array<struct<filename:string,content_type:string,content:binary>>"))
    count_if = lambda f: F.size(F.filter(files, lambda a: F.coalesce(f(a), F.lit(False))))
    by_content = lambda a: executable_by_content(a["content"]).isin(*EXECUTABLE)
    return F.struct(
        (count_if(lambda a: executable_by_name(a["filename"])) + count_if(by_content)).alias("executables"), count_if(lambda a: archive_by_name(a["filename"])).alias("archives"),
        (count_if(lambda a: macro_by_name(a["filename"]).isNotNull()) + count_if(lambda a: pdf_script(a["filename"], a["content"]))).alias("macros"), count_if(lambda a: virus(a["content"])).alias("viruses"),
    )


def blocked_hosts(mail: DataFrame, blocked: DataFrame) -> DataFrame:
    """Hosts of a mail's URLs that are on a block list."""
    hosts = mail.select("message_id", F.explode(urls.raw_urls(F.col("text"))).alias("url")).select("message_id", urls.host_of(F.col("url")).alias("host")).distinct()
    return hosts.join(blocked, "host", "left_semi")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "java")]
