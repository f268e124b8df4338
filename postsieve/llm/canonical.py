"""Text that looks the same but is made of other characters, brought to one form.

The characters on which normalisation has any effect are found by its quick check (a character that is not stable under
NFKC, or that combines with the one before). A text is searched for those only; each unstable segment is normalised
together with the character before it, which it may combine with, and spliced back into the unchanged rest. Spaces become plain,
invisible characters go (not those inside an emoji), and a word that borrows look-alike letters of another script is put
back into the script of its neighbours.

Defined results: null and empty text come back unchanged and unflagged. Typographic quotes, dashes, ellipses, ordinal,
degree and trade-mark signs, fractions and spacing accents stay. A text that is canonical already comes back as the same
object, and canonicalising twice changes nothing. Repeated rows give equal results.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm import encoding
from postsieve.llm.arrow import map_rows, only_non_ascii

#: Signs that NFKC would take apart but that are text as it should be.
KEEP = "…‥ºª™℠№´¨¸¯˜˘˙˚˛˝½¼¾⅓⅔⅛⅜⅝⅞‑‗µ"
#: Look-alike letters, Cyrillic and Greek for Latin.
TO_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "τ": "t", "ε": "e", "η": "n", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
_TO_CYRILLIC = {v: k for k, v in TO_LATIN.items() if "а" <= k <= "я" or "А" <= k <= "Я"} | {"ë": "ё"}
_LATIN_SET, _CYR_SET = str.maketrans(TO_LATIN), str.maketrans(_TO_CYRILLIC)

_INVISIBLE = "\xad͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
_SPACES = "\xa0  -   　"
_PICT = "\xa9\xae‼⁉←-⇿⌀-➿⤀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
_ONE = f"[{_PICT}](?:️|[\U0001f3fb-\U0001f3ff])?[\U000e0020-\U000e007f]*"
_EMOJI = re.compile(f"[#*0-9]️?⃣|{_ONE}(?:‍{_ONE})*")


def _ranges(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(re.escape(chr(points[i])) + (f"-{re.escape(chr(points[j]))}" if j > i else ""))
        i = j + 1
    return "".join(out)


def _unstable_points() -> list[int]:
    """Code points that the quick check doesn't pass: NFKC changes them, or they may combine with what precedes them."""
    keep = {ord(c) for c in KEEP}
    skip = re.compile(f"[{_INVISIBLE}{_SPACES}]")
    stable = unicodedata.is_normalized
    return [
        n for n in range(0xA0, sys.maxunicode + 1)
        if not 0xD800 <= n <= 0xDFFF and n not in keep and not (0xAC00 <= n <= 0xD7A3)
        and (not stable("NFKC", c := chr(n)) or unicodedata.combining(c)) and not skip.match(chr(n))
    ]


_PATTERNS: dict[str, re.Pattern] = {}


def _patterns() -> dict[str, re.Pattern]:
    if not _PATTERNS:
        unstable = _ranges(_unstable_points())
        _PATTERNS["segment"] = re.compile(f"[^\\s{unstable}]?[{unstable}]+")
        _PATTERNS["any"] = re.compile(f"[{unstable}{_INVISIBLE}{_SPACES}]")
        _PATTERNS["drop"] = re.compile(f"[{_INVISIBLE}]+")
        _PATTERNS["space"] = re.compile(f"[{_SPACES}]")
        _PATTERNS["foreign"] = re.compile("[Ͱ-ԯ]")
        _PATTERNS["word"] = re.compile(r"[^\W\d_]+")
    return _PATTERNS


def _script(word: str) -> str:
    """Scripts of a word's letters: of L (Latin), C (Cyrillic), G (Greek)."""
    return "".join(sorted({"C" if "Ѐ" <= c <= "ԯ" else "G" if "Ͱ" <= c <= "Ͽ" else "L" for c in word}))


def _looks_latin(w: str) -> bool:
    return all(c in TO_LATIN or not "Ͱ" <= c <= "ԯ" for c in w)


#: Cyrillic letters of other languages than Russian.
_NOT_RUSSIAN = frozenset("іїєґўјљњћђџѓќѕІЇЄҐЎЈЉЊЋЂЏЃЌЅ")
#: Those of them that pass for no Latin letter.
_LIKE_NOTHING = frozenset("єґўљњћђџѓќЄҐЎЉЊЋЂЏЃЌ")


def _in_running_text(text: str, s: int, e: int) -> bool:
    """Whether a word stands between words, with plain blanks on either side."""
    return s > 1 and e + 1 < len(text) and text[s - 1] == text[e] == " " and text[s - 2].isalpha() and text[e + 1].isalpha()


def _letters(text: str) -> str:
    """Words with look-alike letters of another script, put right by the word's other letters or by its neighbours."""
    p = _patterns()
    words = list(p["word"].finditer(text))
    kinds = [_script(m.group()) for m in words]
    firm = [k == "C" and not _looks_latin(m.group()) for k, m in zip(kinds, words)]  # surely Cyrillic
    greek = [k == "G" and not _looks_latin(m.group()) for k, m in zip(kinds, words)]  # surely Greek
    # letters that Russian lacks are sound in a text whose other words have some, as in Ukrainian or Serbian
    theirs = {m.group() for m, ok in zip(words, firm) if ok and not _NOT_RUSSIAN.isdisjoint(m.group())}
    other = len(theirs) > 1 or any(not _LIKE_NOTHING.isdisjoint(w) for w in theirs)
    out, at = [], 0
    for i, (m, k) in enumerate(zip(words, kinds)):
        w, new = m.group(), None
        if k in ("CL", "GL", "CGL", "CG"):
            if _looks_latin(w):
                cyr = sum("Ѐ" <= c <= "ԯ" for c in w)
                new = w.translate(_LATIN_SET)
                if cyr > len(w) - cyr and all(c in _TO_CYRILLIC or "Ѐ" <= c <= "ԯ" for c in w) and any(firm[max(0, i - 2) : i + 3]):
                    new = w.translate(_CYR_SET)
            elif "C" in k and all(c in _TO_CYRILLIC or "Ѐ" <= c <= "ԯ" for c in w):
                new = w.translate(_CYR_SET)
        elif k in ("C", "G") and _looks_latin(w):
            if k == "G":
                running = len(w) > 1 or _in_running_text(text, m.start(), m.end())  # else a sign of a formula
                if running and not any(greek[max(0, i - 4) : i + 5]):
                    new = w.translate(_LATIN_SET)
            elif (not other and any(c in "іјѕһԁԛԝѵӏІЈЅҮ" for c in w)) or not any(firm[max(0, i - 4) : i + 5]):
                new = w.translate(_LATIN_SET)
        elif k == "L" and w.islower() and len(w) == 1 and 0 < i < len(words) - 1 and firm[i - 1] and firm[i + 1] and all(c in _TO_CYRILLIC for c in w):
            new = w.translate(_CYR_SET)
        if new is not None and new != w:
            out += [text[at : m.start()], new]
            at = m.end()
    if not out:
        return text
    out.append(text[at:])
    return "".join(out)


def _stretch(s: str) -> str:
    p = _patterns()
    s = p["drop"].sub("", s)
    s = p["space"].sub(" ", s)
    return p["segment"].sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)


def canonical(text: str | None) -> str | None:
    """The one form of the text; equal-looking texts have equal forms."""
    if not text or text.isascii():
        return text
    p = _patterns()
    if p["any"].search(text):
        out, at = [], 0
        for m in _EMOJI.finditer(text):
            if m.end() - m.start() > 1:
                out += [_stretch(text[at : m.start()]), m.group()]
                at = m.end()
        out.append(_stretch(text[at:]))
        new = "".join(out)
        text = text if new == text else new
    return _letters(text) if p["foreign"].search(text) else text


def unify_text(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, field, text, found): one row per field with characters beyond ASCII; found where the text was not in the one form.

    Fields read in the wrong encoding are left as they are: they are a matter of postsieve.llm.encoding.
    """

    def fields(k, *texts):
        for name, t in zip(columns, texts):
            if t is not None:
                new = canonical(t)
                changed = new != t and not encoding.repair(t)[1]
                yield k, name, new if changed else t, changed

    some = df.where(" or ".join(f"octet_length({c}) > length({c})" for c in columns))
    return map_rows(some.select(F.col(key).cast("long"), *(only_non_ascii(c) for c in columns)), fields, f"{key} long, field string, text string, found boolean", start=_patterns)


def found(mail: DataFrame) -> DataFrame:
    """(id, field) of the fields that are made of other characters than they look."""
    return unify_text(mail, "id", ("subject", "message")).where("found and id is not null").select("id", "field").distinct()
