"""Verdicts, weighted scores, headers, rewritten messages and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.patterns import let

#: What a message says of each detector, in the order in which it names them.
REASONS = {
    "classification": "spam classification", "phishing": "phishing detected", "executables": "executable content", "macros": "macro detected",
    "arbitrary": "arbitrary patterns", "viruses": "virus detected", "patterns": "suspicious patterns", "homograph": "IDN homograph attack",
    "toxicity": "toxic content", "nsfw": "NSFW content", "denylisted": "denylisted sender",
}
#: What a finding of each detector weighs in the weighted score, and the test it is named by.
WEIGHTS = {"phishing": 5, "executables": 10, "macros": 5, "viruses": 100, "nsfw": 3, "toxicity": 3}
TESTS = {"phishing": "PHISHING_DETECTED", "executables": "EXECUTABLE_ATTACHMENT", "macros": "MACRO_DETECTED", "viruses": "VIRUS_DETECTED", "nsfw": "NSFW_CONTENT", "toxicity": "TOXIC_CONTENT"}


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_spam(flags: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, (_yes(f) for f in flags.values()))


def message(flags: dict[str, Column], truth: Column, allowlisted: Column) -> Column:
    """"Spam (a, b, and c)" in fixed order, or "Ham" with what vouches for it."""

    def over(reasons: Column) -> Column:
        n = F.size(reasons)
        listed = F.when(n == 1, F.get(reasons, F.lit(0))).when(n == 2, F.array_join(reasons, " and ")).otherwise(
            F.concat(F.array_join(F.slice(reasons, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(reasons, -1))
        )
        ham = F.when(_yes(truth), "Ham (truth source)").when(_yes(allowlisted), "Ham (allowlisted)").otherwise("Ham")
        return F.when(n == 0, ham).otherwise(F.concat(F.lit("Spam ("), listed, F.lit(")")))

    return let(F.array_compact(F.array(*(F.when(_yes(flags[k]), v) for k, v in REASONS.items() if k in flags))), over)


def _tenths(x: Column) -> Column:
    return F.format_string("%.1f", x.cast("double"))


def score_details(counts: dict[str, Column], category: Column, probability: Column, auth: Column | None, denied: Column, truth: Column, allowed: Column, threshold: float = 5.0) -> Column:
    """struct<score, is_spam, tests>. counts: findings by detector. auth: struct<score, tests> or None. The classifier counts by its probability above
    one half; a denied sender is spam; one that is vouched for isn't, unless there is a virus or an executable."""
    bayes = F.when(category == "spam", 5.0 * F.greatest(F.lit(0.0), (probability - 0.5) * 2)).when((category == "ham") & (probability > 0.8), -(probability - 0.8) * 5)
    n = {k: F.coalesce(c, F.lit(0)) for k, c in counts.items() if k in WEIGHTS}
    points = [F.coalesce(bayes, F.lit(0.0)), *(c * WEIGHTS[k] for k, c in n.items())]
    named = [F.when(bayes.isNotNull(), F.concat(F.when(category == "spam", "BAYES_SPAM(").otherwise("BAYES_HAM("), _tenths(bayes), F.lit(")")))]
    named += [F.when(n[k] > 0, F.concat(F.lit(TESTS[k] + "("), _tenths(n[k] * WEIGHTS[k]), F.lit(")"))) for k in WEIGHTS if k in n]
    last = [F.when(_yes(denied), "DENYLISTED(10.0)"), F.when(_yes(truth), "TRUTH_SOURCE(-5.0)").when(_yes(allowed), "ALLOWLISTED(-3.0)")]
    if auth is not None:
        points.append(F.coalesce(auth["score"], F.lit(0)))
    points += [F.when(_yes(denied), 10).otherwise(0), F.when(_yes(truth), -5).when(_yes(allowed), -3).otherwise(0)]
    middle = F.coalesce(auth["tests"], F.array().cast("array<string>")) if auth is not None else F.array().cast("array<string>")
    tests = F.concat(F.array_compact(F.array(*named)), middle, F.array_compact(F.array(*last)))
    harm = reduce(lambda a, b: a | b, (n[k] > 0 for k in ("viruses", "executables") if k in n), F.lit(False))

    def over(score: Column) -> Column:
        spam = F.when(_yes(denied), True).when((_yes(truth) | _yes(allowed)) & ~harm, False).otherwise(score >= threshold)
        return F.struct(score.alias("score"), spam.alias("is_spam"), tests.alias("tests"))

    return let(reduce(lambda a, b: a + b, points), over)


def weighted_score(counts: dict[str, Column], spam_probability: Column, auth: Column, denied: Column, truth: Column, allowed: Column) -> Column:
    """The score alone; auth: its number. spam_probability is that of the class spam."""
    none = F.array().cast("array<string>")
    return score_details(counts, F.lit("spam"), F.coalesce(spam_probability, F.lit(0.5)), F.struct(auth.alias("score"), none.alias("tests")), denied, truth, allowed)["score"]


def headers(score: Column, spam: Column, tests: Column, threshold: float = 5.0, version: str | None = None) -> Column:
    """map of the four headers."""
    yes = F.when(spam, "Yes").otherwise("No")
    text = _tenths(score)
    end = "" if version is None else f" version={version}"
    return F.create_map(
        F.lit("X-Spam-Status"), F.concat(yes, F.lit(", score="), text, F.lit(f" required={threshold:.1f} tests="), F.array_join(tests, ","), F.lit(end)),
        F.lit("X-Spam-Score"), text, F.lit("X-Spam-Flag"), F.upper(yes), F.lit("X-Spam-Tests"), F.array_join(tests, ", "),
    )


def rewrite(raw: Column, lines: Column, tag: Column) -> Column:
    """The raw message with header lines (parted by \\n) before its first blank line, in its own line ends, and the subject tagged (tag null: not)
    unless it begins with the tag. A message without a blank line gets the lines at its end and no tag."""

    def over(x: Column) -> Column:
        at, eol = x["at"], x["eol"]
        head = F.substring(raw, F.lit(1), at - 1)
        with_lines = F.concat(head, eol, F.replace(lines, F.lit("\n"), eol))
        subject = F.regexp_extract(with_lines, r"(?im)^(subject:[ \t]*)(.*?)\r?$", 2)
        there = with_lines.rlike(r"(?im)^subject:")
        literal = F.replace(F.replace(tag, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        # only the first subject line is tagged: the pattern takes in all that follows it
        tagged = F.regexp_replace(with_lines, F.lit(r"(?ism)\A(.*?)^(subject:[ \t]*)(.*)\z"), F.concat(F.lit("$1$2"), literal, F.lit(" $3")))
        new = F.when(there & tag.isNotNull() & ~F.coalesce(subject.startswith(tag), F.lit(True)), tagged).otherwise(with_lines)
        return F.when(at == 0, F.concat(raw, F.lit("\r\n"), F.replace(lines, F.lit("\n"), F.lit("\r\n")))).otherwise(F.concat(new, F.substring(raw, at, F.length(raw))))

    blank = F.regexp_extract(raw, r"\r?\n\r?\n", 0)
    at = F.when(blank == "", F.lit(0)).otherwise(F.instr(raw, blank))
    return let(F.struct(at.alias("at"), F.when(blank.startswith("\r\n"), "\r\n").otherwise("\n").alias("eol")), over)


def report(is_spam_: Column, score: Column, tests: Column, threshold: float = 5.0, details: dict[str, Column] | None = None) -> Column:
    """A report for people. details: counts of findings by detector, and the words category, dkim, spf, dmarc, arc, reputation; lines whose value is
    null or 0 are left out."""
    first = F.concat(F.when(is_spam_, "SPAM DETECTED (score: ").otherwise("Clean (score: "), _tenths(score), F.lit(f", threshold: {threshold:.1f})"))
    lines = [first, F.when(F.size(tests) > 0, F.concat(F.lit("Tests: "), F.array_join(tests, ", ")))]
    if details is not None:
        counted = {"phishing": "Phishing: %d issue(s) detected", "executables": "Executables: %d dangerous file(s) detected", "viruses": "Viruses: %d virus(es) detected", "macros": "Macros: %d macro(s) detected", "toxicity": "Toxicity: %d toxic content detected", "nsfw": "NSFW: %d NSFW content detected"}
        lines.append(F.lit("\nDetails:"))
        if "category" in details:
            lines.append(F.concat(F.lit("  Classification: "), details["category"]))
        lines += [F.when(details[k] > 0, F.format_string("  " + t, details[k])) for k, t in counted.items() if k in details]
        proofs = [F.concat(F.lit(f"    {k.upper()}: "), details[k]) for k in ("dkim", "spf", "dmarc", "arc") if k in details]
        if proofs:
            lines += [F.when(F.coalesce(*(details[k] for k in ("dkim", "spf", "dmarc", "arc") if k in details)).isNotNull(), "\n  Authentication:"), *proofs]
        if "reputation" in details:
            lines.append(F.concat(F.lit("\n  Reputation:\n    Status: "), details["reputation"]))
    return F.concat_ws("\n", *lines)


def exit_code(is_spam_: Column, error: Column) -> Column:
    """What a command-line run would return: 2 for an error, 1 for spam, else 0."""
    return F.when(error.isNotNull(), 2).when(is_spam_, 1).otherwise(0)
