"""Normalising and tokenising text: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.patterns import java, let
from postsieve.lookups import BASIC_REPLACEMENTS, LANGUAGE_CODES, REPLACEMENT_WORDS, STOP_LISTS, STOP_WORDS

#: Pattern tags in the order they apply; patterns are ASCII.
TAGS = [
    ("DATE_PATTERN", r"\b(?:\d{1,2}[/-]){2}\d{2,4}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[ -]?){3}\d{4}\b"),
    ("PHONE_NUMBER", r"\b\d{3}[-.]\d{3}[-.]\d{4}\b"),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}\b"),
    ("URL_LINK", r"(?i)https?://[^\s<>\"']+"),
    ("BITCOIN_ADDRESS", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"),
    ("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"),
    ("HEX_COLOR", r"#[0-9A-Fa-f]{6}\b"),
    ("FLOATING_POINT", r"\b\d+\.\d+\b"),
]
#: English contractions and what they stand for, in order.
CONTRACTIONS = [("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'m", " am"), ("it's", "it is"), ("let's", "let us")]


def tag_patterns(text: Column, floats: bool = True) -> Column:
    """Replace dates, cards, phones, addresses, links and the like by their tags, each in blanks."""
    return reduce(lambda c, t: F.regexp_replace(c, java(t[1]), f" {t[0]} "), TAGS if floats else TAGS[:-1], text)


def replace_words(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered, case-insensitive replacement of substrings, taken literally."""
    quote = lambda w: "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in w)
    return reduce(lambda c, p: F.regexp_replace(c, "(?i)" + quote(p[0]), p[1].replace("\\", "\\\\").replace("$", r"\$")), pairs, text)


def seeded_replacements(seed: str = "postsieve") -> list[tuple[str, str]]:
    """The default dictionary: each word with ten letters after it that depend on the seed alone."""
    letters = lambda w: "".join(chr(97 + b % 26) for b in hashlib.sha256(f"{seed}|{w}".encode()).digest()[:10])
    return [(w, w + letters(w)) for w in REPLACEMENT_WORDS]


def replacements(given: dict[str, str] | list[tuple[str, str]] | None) -> list[tuple[str, str]]:
    """Pairs of a given dictionary or list; the basic ones for None or for what is neither."""
    if isinstance(given, dict):
        return list(given.items())
    return list(given) if isinstance(given, list) and given else list(BASIC_REPLACEMENTS)


def preprocess(text: Column, pairs: list[tuple[str, str]] = (), tags: bool = True) -> Column:
    """Replacements, then tags; blank text gives the empty string."""
    out = replace_words(text, list(pairs))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").otherwise(tag_patterns(out) if tags else out)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def half_width(text: Column) -> Column:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def expand_contractions(text: Column) -> Column:
    """Lower-case text with contractions written out; typographic apostrophes count."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), CONTRACTIONS, F.replace(F.lower(text), F.lit("’"), F.lit("'")))


def simple_tokens(text: Column) -> Column:
    """Training tokens: lower case, other than a-z, 0-9 and blanks cleared, words of 3 to 19 characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: (F.length(t) > 2) & (F.length(t) < 20))


def tokens(text: Column) -> Column:
    """General tokens: split at what is no letter, digit or hyphen; lower case; 1 to 50 characters."""
    return F.filter(F.split(F.lower(text), r"[^a-zà-öø-ýа-я0-9-]+"), lambda t: (F.length(t) >= 1) & (F.length(t) <= 50))


def blank_tokens(text: Column) -> Column:
    """Tokens of languages that are split at blanks only."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def drop_stop_words(toks: Column, words: list[str] = tuple(STOP_WORDS)) -> Column:
    """Keeps order and repetitions."""
    return F.filter(toks, lambda t: ~t.isin(*words))


@lru_cache
def stop_words(locale_: str) -> tuple[str, ...]:
    """Stop words of a language, those of English with them: Spark's lists; for a language without one the English list alone."""
    from pyspark.ml.feature import StopWordsRemover

    own = StopWordsRemover.loadDefaultStopWords(STOP_LISTS[locale_]) if locale_ in STOP_LISTS else []
    return tuple(sorted({*own, *StopWordsRemover.loadDefaultStopWords("english"), *STOP_WORDS}))


def without_stop_words(toks: Column, locale_: Column, languages: list[str] = tuple(STOP_LISTS)) -> Column:
    """Tokens without the stop words of their text's language; other languages take the English list. Keeps order and repetitions."""
    keep = lambda words: F.filter(toks, lambda t: ~t.isin(*words))
    return reduce(lambda e, k: e.when(locale_ == k, keep(stop_words(k))), [k for k in languages if k != "en"], F.when(locale_ == "en", keep(stop_words("en")))).otherwise(keep(stop_words("en")))


def locale_tokens(text: Column, locale_: Column) -> Column:
    """Tokens of a text in a language: full width made half, contractions written out, Chinese and Japanese split at blanks only, others at what is
    no letter, digit or hyphen; lower case, 1 to 50 characters, without stop words."""
    ready = expand_contractions(half_width(text))
    short = lambda t: F.filter(F.transform(t, lambda x: F.lower(F.trim(x))), lambda x: (F.length(x) >= 1) & (F.length(x) <= 50))
    split = let(ready, lambda r: F.when(locale_.isin("ja", "zh"), short(blank_tokens(r))).otherwise(tokens(r)))
    return let(split, lambda t: without_stop_words(t, locale_))


def hash_tokens(toks: Column, digits: int = 16) -> Column:
    return F.transform(toks, lambda t: F.substring(F.sha2(t, 256), 1, digits))


def mail_text(text: Column, html: Column, subject: Column) -> Column:
    """What a mail is classified by: text, HTML without tags and subject, blank parts kept as blanks."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws(" ", part(text), strip_tags(part(html)), part(subject))


def locale(code: Column) -> Column:
    """Lower case, cut at the first hyphen; both Norwegian forms are no."""
    base = F.split_part(F.lower(code), F.lit("-"), F.lit(1))
    return F.when(base.isin("nb", "nn"), "no").otherwise(base)


def language_code(code: Column) -> Column:
    """Two letters for a language code of two or three; en for an unknown one."""
    low = F.lower(code)
    three = F.create_map(*(F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv))
    return F.when(F.length(low) == 2, low).otherwise(F.coalesce(F.try_element_at(three, low), F.lit("en")))


def language_guard(text: Column) -> Column:
    """Whether a text is so short or so free of ASCII letters that it counts as English without looking."""
    return F.coalesce(F.length(text) < 3, F.lit(True)) | text.rlike(r"^[\s\x00-\x40\x5B-\x5E\x60\x7B-\x{10FFFF}]*\z")


def plausible_short(text: Column, lang: Column) -> Column:
    """Whether a short text may be trusted to a detector: one in Latin letters needs seven characters, unless it is English."""
    return text.rlike(r"[^\x00-\x{24F}\x{1E00}-\x{1EFF}]") | (F.length(text) >= 7) | (lang == "en")


def features(subject: Column, text: Column, attachments: Column) -> Column:
    """Numbers a classifier may use besides tokens."""
    return F.struct(
        F.size(simple_tokens(text)).alias("tokens"), F.regexp_count(text, F.lit(r"https?://")).alias("urls"), (attachments > 0).alias("has_attachments"),
        F.length(subject).alias("subject_length"), text.rlike("[0-9]").alias("has_digits"),
    )


def anonymise(text: Column) -> Column:
    """Addresses, phone numbers and card numbers masked as in prepared training sets."""
    out = F.regexp_replace(text, java(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"), "[EMAIL]")
    out = F.regexp_replace(out, java(r"\b\d{3}-\d{3}-\d{4}\b"), "[PHONE]")
    return F.regexp_replace(out, java(r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"), "[CARD]")
