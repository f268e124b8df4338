"""Text that was decoded with the wrong character encoding: detection and round-trip repair.

For each candidate pair (encoding it was read in, encoding it was written in) the suspicious part of a text is encoded
back to bytes and strictly decoded as it was meant; the result is accepted when a garbling cost drops. Layers are
peeled until nothing changes. Costs know the letters of Western languages and of Russian; text in any other script is accepted where whole runs
of characters decode strictly and come out in one script. Texts written in UTF-8 are repaired byte sequence by byte sequence, so that one garbled sequence in an
otherwise good text is found; texts in single-byte encodings word by word, by evidence over the whole field.

Defined results: null and empty text, and text of ASCII only, come back unchanged and unflagged. A replacement
character U+FFFD flags a field although nothing can be restored. Repeated rows give equal results.
"""

from __future__ import annotations

import codecs
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.arrow import map_rows, non_ascii, only_non_ascii

#: Encodings in which bytes of UTF-8 text may have been read. "western" stands for cp1252 and ISO 8859-1 alike.
READ_AS = ("western", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "koi8_r", "iso8859_15")
#: (read as, written in) of single-byte encodings.
PAIRS = (
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "iso8859_5"), ("iso8859_5", "cp1251"),
    ("western", "mac_roman"), ("mac_roman", "western"), ("western", "cp1251"), ("western", "koi8_r"), ("western", "cp866"), ("mac_roman", "cp1251"), ("mac_roman", "koi8_r"), ("cp850", "cp1251"), ("cp437", "cp1251"),
    ("cp850", "western"), ("cp437", "western"), ("western", "cp850"), ("cp1250", "western"), ("cp1251", "western"),
)
#: A field is repaired from a single-byte pair when its words get cheaper by this much in all.
PAIR_DROP = 2.0
SEQUENCE_DROP = 0.35

#: Share in percent of each letter in Russian text.
RUSSIAN = {"о": 10.97, "е": 8.45, "а": 8.01, "и": 7.35, "н": 6.70, "т": 6.26, "с": 5.47, "р": 4.73, "в": 4.54, "л": 4.40, "к": 3.49, "м": 3.21, "д": 2.98, "п": 2.81, "у": 2.62, "я": 2.01, "ы": 1.90, "ь": 1.74, "г": 1.70, "з": 1.65, "б": 1.59, "ч": 1.44, "й": 1.21, "х": 0.97, "ж": 0.94, "ш": 0.73, "ю": 0.64, "ц": 0.48, "щ": 0.36, "э": 0.32, "ф": 0.26, "ъ": 0.04, "ё": 0.3}

_LOWER = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüßœ")
_UPPER = {c.upper() for c in _LOWER if c != "ß"}
_SIGNS = dict.fromkeys("’‘“”„‚–—…€£°¿¡«»‹›", 0.4) | dict.fromkeys("§ªº™®·•№", 1.0) | dict.fromkeys("©²³½¼¾\xa0\xad´", 1.5)
#: Letters of other scripts that pass for Latin ones; they are disguise, not garbling.
_ALIKE = set("аеорсухіјѕһԁԛԝАВЕЅІЈКМНОРСТУХҮαοερνικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
_WORD = re.compile(r"\S*[^\s\x00-\x7f]\S*")
_RUN = re.compile(r"[^\x00-\x7f]+")
_SEQ = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _char_cost(c: str) -> float:
    n = ord(c)
    if n < 0x80:
        return 0.0
    if c in _LOWER:
        return 0.5
    if c in _UPPER:
        return 0.6
    if c in _SIGNS:
        return _SIGNS[c]
    if c in "ýÝ":
        return 1.2
    if c.lower() in RUSSIAN:
        return min(1.3, max(0.0, 0.35 * math.log(8 / RUSSIAN[c.lower()]))) + (0.1 if c.isupper() else 0.0)
    if n < 0xA0 or n == 0xFFFD:
        return 4.0
    if 0x2000 <= n <= 0x206F or 0xFE00 <= n <= 0xFE0F or n == 0xFEFF or 0x300 <= n <= 0x36F:
        return 0.4  # invisible and combining characters are no garbling of their own
    if n >= 0x1F000 or 0x1D400 <= n <= 0x1D7FF or 0xFF01 <= n <= 0xFF5E or 0x3000 == n or 0x2600 <= n <= 0x27BF:
        return 0.2  # emoji, styled and full-width forms
    if 0x370 <= n <= 0x3FF:
        return 0.6 if c in _ALIKE else 2.0
    if 0x400 <= n <= 0x52F:
        return 0.6 if c in _ALIKE else 3.0
    if 0x100 <= n <= 0x24F:
        return 2.0
    return 3.0


class _Costs(dict):
    def __missing__(self, c: str) -> float:
        self[c] = v = _char_cost(c)
        return v


_COST = _Costs()


def cost(word: str) -> float:
    """Garbling cost of a word: rare characters, capitals inside lower case, scripts that don't go together."""
    total, before, latin, other = 0.0, "", False, 0
    for c in word:
        if c.isalpha():
            if c > "\x7f" and before and before.islower() and c.isupper():
                total += 2.5
            latin = latin or c < "ɐ"
            before = c
            if c > "ͯ" and c not in _ALIKE and c < "԰":
                other += 1
        else:
            total += 2.2 if c in "†‡‰" and before else 0.0  # no sound word goes on with these
            before = ""
        total += _COST[c]
    return total + (2.0 if latin and other else 0.0)


def _table(name: str) -> tuple[dict[str, int], str]:
    """character -> byte, and the 256 characters, of a single-byte encoding; undefined bytes are C1 controls, as browsers do."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode("cp1252" if name == "western" else name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {c: b for b, c in enumerate(chars) if b > 127}
    if name == "western":
        back |= {chr(b): b for b in range(128, 160)}
    return back, "".join(chars)


_TABLES = {n: _table(n) for n in {*READ_AS, *(x for p in PAIRS for x in p)}}
_ENCODE = {n: {ord(c): b for c, b in t[0].items()} | {i: i for i in range(128)} for n, t in _TABLES.items()}


#: Characters that stand for the first byte of a UTF-8 sequence, and for one that follows, in each encoding.
_BYTES = {n: (frozenset(c for c, b in t[0].items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in t[0].items() if 0x80 <= b <= 0xBF)) for n, t in _TABLES.items()}


def _new_cost(c: str) -> float:
    """Cost of a decoded character in a text of Western or Russian letters; other scripts are a matter of _whole_runs."""
    n = ord(c)
    if n > 0xFF and c.lower() not in RUSSIAN and c not in _TABLES["western"][0] and _COST[c] > 0.6:
        return 99.0
    return _COST[c] + (1.0 if 0x300 <= n <= 0x36F else 0.0)


def _splice(run: str, name: str) -> tuple[str, float]:
    """The run with every UTF-8 sequence that its bytes hold decoded, if that makes it cheaper; and by how much."""
    back = _TABLES[name][0]
    raw = bytes([back.get(c, 0) for c in run])
    if not _SEQ.search(raw):
        return run, 0.0
    out, at, drop = [], 0, 0.0
    for m in _SEQ.finditer(raw):
        i, j = m.span()
        new = m.group().decode("utf-8")
        gain = sum(_COST[c] for c in run[i:j]) - _new_cost(new)
        if gain > -0.8:
            out += [run[at:i], new]
            at = j
            drop += max(gain, 0.0)
    out.append(run[at:])
    return "".join(out), drop


#: Scripts whose letters a strict decoding of whole runs may give, by their first and last code points.
_SCRIPTS = [(name, lo, hi) for name, *spans in (
    ("Latin", (0xC0, 0x17F), (0x218, 0x21B), (0x1E00, 0x1EFF)), ("Greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)), ("Cyrillic", (0x400, 0x4FF)), ("Hebrew", (0x5D0, 0x5EA)), ("Arabic", (0x620, 0x6D3)),
    ("Indic", (0x900, 0xDFF)), ("Thai", (0xE01, 0xE5B)), ("Georgian", (0x10A0, 0x10FF)), ("East Asian", (0x3001, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFFEE)),
) for lo, hi in spans]
#: Signs that may follow a letter in sound text, so that the two may look like a sequence.
_MAY_FOLLOW = set("“”’‘…–—»«›‹°€•™®©\xa0´§")


def _script_of(c: str) -> str | None:
    n = ord(c)
    return next((name for name, lo, hi in _SCRIPTS if lo <= n <= hi), None)


def _whole_runs(text: str) -> tuple[str, bool]:
    """Runs that decode strictly, as a whole and for one encoding, to letters of one script beyond Western and Russian. A text must hold two sequences of
    them, or one inside a word that no sound text would hold; of the scripts with sequences of three bytes two in a row."""
    places: dict[str, list[int]] = {}
    for m in _RUN.finditer(text):
        if m.end() - m.start() > 1:
            places.setdefault(m.group(), []).append(m.end())
    if not places:
        return text, False
    for name in READ_AS:
        back, lead, more, found, sure = _TABLES[name][0], *_BYTES[name], {}, 0
        for run, ends in places.items():
            if run[0] not in lead or run[1] not in more or _ALIKE.issuperset(run):
                continue
            try:
                new = bytes([back[c] for c in run]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            kinds = {_script_of(c) for c in new}
            if len(kinds) != 1 or None in kinds or any(ord(c) < 0xA0 for c in new) or all(ord(c) < 0x100 or _new_cost(c) < 1.5 for c in new):
                continue
            wide = kinds & {"Indic", "Thai", "Georgian", "East Asian"}
            if wide and len(new) < 2 or run[0] in _MAY_FOLLOW and len(new) < 3:
                continue
            inside = any(e < len(text) and text[e].isalpha() for e in ends) or not any(c in _MAY_FOLLOW for c in run)
            found[run] = new
            sure += 2 if inside or len(new) > 1 + bool(kinds & {"Latin"}) else 1
        if sure > 1:
            return _RUN.sub(lambda m: found.get(m.group(), m.group()), text), True
    return text, False


def _from_utf8(text: str) -> tuple[str, bool]:
    """One layer of UTF-8 read as something else removed, run by run."""
    text, hit = _whole_runs(text)

    def one(m: re.Match) -> str:
        nonlocal hit
        run = m.group()
        if len(run) < 2:
            return run
        best, drop = run, SEQUENCE_DROP
        for name in READ_AS:
            lead, more = _BYTES[name]
            if lead.isdisjoint(run) or more.isdisjoint(run):
                continue
            new, d = _splice(run, name)
            if d > drop:
                best, drop = new, d
        hit = hit or best is not run
        return best

    return _RUN.sub(one, text), hit


#: Letters beyond ASCII of languages that cp1250 is made for.
_CENTRAL = [frozenset(x) for x in ("ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž", "áéíóöőúüű", "ăâîşţșț", "čćđšž")]
#: A letter that is a consonant there, between consonants of one word: an accented vowel that was read wrongly.
_STUCK = re.compile(r"[bcdfghjklmnpqrstvwxz][čćďęňŕřľĺ][bcdfghjklmnpqrstvwxz]", re.I)


def _central(text: str) -> bool:
    """Whether a text's letters are those of one language of central Europe, in places where that language has them."""
    letters = {c for c in text.lower() if c > "\x7f" and c.isalpha()}
    return bool(letters & set("ąćęłńśźżčďěňřšťůžĺľŕőűăşţșțđ")) and any(letters <= x for x in _CENTRAL) and not _STUCK.search(text)


def _from_pair(text: str) -> tuple[str, bool]:
    """Words written in one single-byte encoding and read in another, if the field as a whole speaks for one such pair."""
    words = list(dict.fromkeys(_WORD.findall(text)))
    costs = [cost(w) for w in words]
    if sum(costs) < PAIR_DROP or max(costs) < 1.2:
        return text, False
    best, drop = {}, PAIR_DROP
    sound = _central(text)
    for read, written in PAIRS:
        if read == "cp1250" and sound:
            continue
        enc, chars, total, new = _ENCODE[read], _TABLES[written][1], 0.0, {}
        for w, old in zip(words, costs):
            try:
                fixed = codecs.charmap_decode(codecs.charmap_encode(w, "strict", enc)[0], "strict", chars)[0]
            except UnicodeError:
                continue
            d = old - cost(fixed)
            if d > -0.3:
                new[w] = fixed
                total += d if d > 0.5 and d > 0.2 * sum(c > "\x7f" for c in w) else 0.0
        if total > drop:
            best, drop = new, total
    if not best:
        return text, False
    return _WORD.sub(lambda m: best.get(m.group(), m.group()), text), True


def repair(text: str | None) -> tuple[str | None, bool]:
    """(text as its writer wrote it, as far as it can be recovered; whether any of it had been read in the wrong encoding)."""
    if not text or text.isascii():
        return text, False
    found = "�" in text
    seen = {text}
    while True:
        text, hit = _from_utf8(text)
        if not hit:
            text, hit = _from_pair(text)
        found = found or hit
        if not hit or text in seen:
            break
        seen.add(text)
    return text, found or bool(re.search("[\x80-\x84\x86-\x9f]", text))


def repair_encoding(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, field, text, found): one row per field that holds characters beyond ASCII; the others need no repair."""

    def fields(k, *texts):
        for name, t in zip(columns, texts):
            if t is not None:
                fixed, found = repair(t)
                yield k, name, fixed, found

    some = df.where(" or ".join(f"octet_length({c}) > length({c})" for c in columns))
    return map_rows(some.select(F.col(key).cast("long"), *(only_non_ascii(c) for c in columns)), fields, f"{key} long, field string, text string, found boolean")


def found(mail: DataFrame) -> DataFrame:
    """(id, field) of the fields read in the wrong encoding."""
    return repair_encoding(mail, "id", ("subject", "message")).where("found and id is not null").select("id", "field").distinct()


__all__ = ["cost", "found", "non_ascii", "repair", "repair_encoding"]
