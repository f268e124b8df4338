"""Personal details in free text, found by a skip-chain conditional random field and replaced by typed placeholders.

Candidate spans (addresses of mail, phone numbers, official numbers, street addresses, capitalised words) are the nodes of
a field over each document; a node is on if its span is a personal detail. Node potentials are log-linear: those of names
come from a model over character pieces and neighbouring words, fitted by stochastic gradient descent on a bounded sample
(SAMPLE_ROWS rows, documented below), those of the other kinds from pattern and context. Neighbouring name words share a
chain potential; equal or similar mentions anywhere in the document share a skip potential; both are fitted on the same sample by
pseudo-likelihood. Loopy message passing, run in numpy over all documents of an Arrow batch at once, makes the labels of a document
agree: a number or word that nothing near it tells of is turned by another mention that is sure, and the other way round.

Defined results: null and empty text give no mention and come back as they are. Texts of any length are read whole. Letters
disguised as others (postsieve.llm.canonical) are read, and come out, in their plain form. Repeated rows give equal results; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.arrow import batch_of
from postsieve.llm.canonical import canonical

#: Rows of mail, and as many of reports, from which the name model is fitted; taken by the hash of their id.
SAMPLE_ROWS = 1500
BUCKETS = 1 << 17
#: Potentials between nodes, as log-odds of agreeing, where none were fitted; and the greatest that a fit may give.
CHAIN, SKIP, MOST = 0.9, 1.6, 2.5
#: Potential of a number that has the form of an official or phone number and nothing near it to tell.
DOUBTFUL = -1.2
#: Skip potential of equal numbers and addresses, which are the same thing wherever they stand; labelled ones to fit it on don't exist.
NUMBER = 2.0
ROUNDS = 5
KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

_DOMAIN_TEXT = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,10}"
_DOMAIN = re.compile(_DOMAIN_TEXT)
_HIDDEN = re.compile(
    r"[A-Za-z0-9][\w.+=-]*\s?(?:\((?:at|a|AT)\)|\[(?:at|a|AT|@)\]|\{at\}|<at>|\(@\)|@)\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\(\.\)|\[\.\]|\sdot\s)\s?[A-Za-z0-9-]+)*?\s?(?:\.|\(dot\)|\[dot\]|\(\.\)|\[\.\]|\sdot\s)\s?[A-Za-z]{2,10}\b(?:\s?(?:\(dot\)|\[dot\]|\(\.\)|\[\.\])\s?[A-Za-z0-9-]+\b)*"
    rf"|[A-Za-z0-9][\w.+=-]*\s(?:at|AT)\s[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9-]+)+|[a-z0-9][\w.+=-]*\sat\s(?:[a-z0-9-]+\.)+(?:test|invalid|example|com|org|net|edu|gov|info|biz|[a-z]{{2}})\b"
)
#: A mark set off by a blank, then a word that ends a sentence: "clause (a) above. The", no address.
_NO_HIDDEN = re.compile(r"\s[(\[{<]\S{1,2}[)\]}>]\s?[A-Za-z0-9-]+\.\s")
_HIDE_HINT = re.compile(r"@|\(at\)|\[at\]|\(a\)|\[a\]|\{at\}|<at>| at [\w-]+(?: dot |\.[a-z])| AT [\w-]+ DOT ", re.I)

_NUM = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_PHONE = re.compile(
    r"(?<![\w.-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,8}){1,5}"
    r"|00\d{1,3}[ -]\d{1,4}(?:[ -]?\d{2,8}){1,4}"
    r"|\(\d{3,5}\)[ -]?\d{3,4}[ -]?\d{2,4}"
    r"|(?:1[-. ])?\d{3}[-.]\d{3}[-.]\d{4}"
    r"|\d{3} \d{3} \d{4}|\d{3} \d{3}-\d{4}|\d{6} \d{4}"
    r"|0\d(?:[ .]\d\d){4}|0\d{9,10}"
    r"|0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,4}){0,2}"
    rf"|{_NUM}(?:[ -]{_NUM}){{2,}},? \d{{3}}[ -]?\d{{4}}|{_NUM}(?:[ -]{_NUM}){{6,}}"
    r")(?:,?\s?(?:ext|x|Ext|Durchwahl)\.?\s?\d{1,5})?(?![\w/])"
)
_ID = re.compile(
    r"(?<![\w.-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"
    r"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"
    r"|[012] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?"
    r"|\d{2} \d{3} \d{3} \d{3}|\d{2,3}/\d{3}/\d{5}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}-\d{3}-\d{3} \d{2}"
    r"|[A-Z]{1,2}\d{6,8}|[A-Z]\d{2}[A-Z0-9]{6,7}|\d{2} \d{2} \d{6}|\d{4} \d{6}|\d{9}|\d{11,12}"
    r")(?![\w/]|[.-]\d)"
)
_SURE_ID = re.compile(r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]")
#: Words that announce a person's official number.
_ID_WORDS = re.compile(r"\bSSN\b|social security|tax (?:id|number)|passport|\bID card|identity|identi|national insurance|\bNINO?\b|Ausweis|Steuer|Sozialversicherung|sécurité sociale|passeport|\bNIR\b|\bDNI\b|\bNIE\b|\bNIF\b|\bCPF\b|contribuinte|seguridad social|documento|pasaporte|passaporte|codice fiscale|carta d.identit|\bBSN\b|burgerservice|paspoort|rijbewijs|ИНН|СНИЛС|паспорт", re.I)

#: Words that announce a number of another kind.
_NO_ID = re.compile(r"\b(?:[Oo]rder|[Ii]nvoice|[Tt]icket|[Aa]ccount no|[Ii]tem|[Pp]art no|[Rr]elease|[Tt]racking|Bestellung|Rechnung|Auftrag|commande|facture|pedido|factura|fatura|ordine|fattura|bestelling|factuur|заказа?|счета?)\b|№\s*$")

_CAP = r"[A-ZÀ-Þ][\w’'.-]*"
_TYPES_EN = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Close|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Crescent|Row|Hill|Gardens|Parkway|Pkwy|STREET|ST|AVENUE|AVE|ROAD|RD|LANE|BLVD|DRIVE|DR|COURT|WAY|CLOSE)"
_UNIT = r"(?:,?\s(?:Suite|Ste\.?|Apt\.?|APT|SUITE|Unit|UNIT|Flat|Floor)\s\w+)?"
_ADDRESS = re.compile(
    rf"(?:(?:{_CAP} House|Flat \d+\w?|Unit \d+),\s)?(?<![\w.,-])\d{{1,5}}[a-zA-Z]?\s(?:[NSEW]\.?\s)?(?:{_CAP}\s){{1,3}}{_TYPES_EN}\b\.?{_UNIT}(?:,\s{_CAP}(?:\s[A-Z]{{2}})?(?:\s\d{{5}})?)?"
    r"|(?<![\w])[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|straat|laan|gracht|plein|kade|singel|dijk)\s\d{1,4}\s?[a-z]?\b(?:(?:,| in)\s(?:\d{4,5}\s(?:[A-Z]{2}\s)?)?[A-ZÀ-Þ][\w-]+)?"
    rf"|(?<![\w])(?:Am|An der|Zum|Zur|Im)\s[A-ZÄÖÜ][\wäöüß-]+\s\d{{1,4}}[a-z]?\b(?=[,.]?\s|$)(?:,\s(?:\d{{5}}\s)?[A-ZÀ-Þ][\w-]+)?"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|chemin|boulevard|place|impasse|allée|quai|route|cours)\s(?:(?:du|de la|de|des|d[’'])\s?)?{_CAP}(?:\s{_CAP}){{0,2}}(?:,\s(?:\d{{5}}\s)?[A-ZÀ-Þ][\w-]+)?"
    rf"|(?<![\w])(?:C/|[Cc]alle|[Aa]venida|[Aa]vda\.?|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Rr]ua|[Tt]ravessa|[Pp]raça|[Aa]lameda|[Ll]argo|[Vv]ia|[Vv]iale|[Cc]orso|[Pp]iazza|[Vv]icolo)\s(?:(?:de la|de los|de|del|do|da|dos|di|della)\s)?{_CAP}(?:\s{_CAP}){{0,2}},?\s(?:n\.?[º°]?\s?)?\d{{1,4}}\w?\b(?:,\s(?:\d{{5}}\s)?[A-ZÀ-Þ][\w-]+)?"
    r"|(?:P\.?\s?O\.?\s?Box|Postfach|Apartado|Postbus)\s\d{2,6}"
    r"|(?:ул\.|улица|пр\.|проспект|пер\.|наб\.)\s[\w.\s-]{2,30}?,?\s(?:д\.\s?)?\d{1,4}\w?"
    rf"|{_CAP} House,\s\d{{1,4}}\s{_CAP}(?:\s{_CAP})?(?:,\s{_CAP})?"
)
_WORD = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ](?:[\w’'-]*[^\W_])?")
_AFTER = re.compile(r"([^\w]*)([\w’'-]*)")
#: A long number, perhaps with letters: phone and official numbers are looked for only there.
_LONG = re.compile(r"\d(?:[\d ()./-]{4,}\d|\d{1,2}[A-Z][A-Z0-9]{3,})")
#: What may follow the number of a street address, and how the word before one may end or its street may begin.
_AFTER_NUMBER = re.compile(r"[a-zA-Z]?\s(?:[NSEW]\.?\s)?[A-ZÀ-Þ]|(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|chemin|boulevard|place|impasse|allée|quai|route|cours)\s")
_STREET_ENDS = ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "ufer", "ring", "damm", "straat", "laan", "gracht", "plein", "kade", "singel", "dijk", "Box", "Postfach", "Apartado", "Postbus")
_STREET_STARTS = re.compile(r"(?:\b(?:Am|An der|Zum|Zur|Im|C/|[Cc]alle|[Aa]venida|[Aa]vda\.?|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Rr]ua|[Tt]ravessa|[Pp]raça|[Aa]lameda|[Ll]argo|[Vv]iale?|[Cc]orso|[Pp]iazza|[Vv]icolo)|ул\.|улица|пр\.|проспект|пер\.|наб\.)\s")
_EN_TYPE = re.compile(rf"\s{_TYPES_EN}\b")
_NUMBER = re.compile(r"\d+")
_SPOKEN = tuple(f" {w} " for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "zero"))
_AT_MARKS = (" at ", " AT ", "(at)", "(AT)", "(a)", "[a]", "[at]", "[AT]", "[@]", "(@)", "<at>", "{at}", " @", "@ ")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+=%'-")


def _plain(w: str) -> str:
    w = w.casefold().replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("ß", "ss")
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def _bucket(text: str) -> int:
    h = 2166136261
    for c in text.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h % BUCKETS


def token_pieces(word: str) -> list[int]:
    """Buckets of the character pieces of a word; of a double name those of both halves."""
    out = ["shape=" + ("U" if word.isupper() and len(word) > 1 else "I" if len(word) == 1 else "T")]
    for part in _plain(word).replace("’", "'").split("-"):
        p = f"<{part}>"
        out += ["w=" + part, "p3=" + p[:4], "p4=" + p[:5], "s3=" + p[-4:], "s4=" + p[-5:], "s5=" + p[-6:]]
        out += ["g=" + p[i : i + 4] for i in range(len(p) - 3)]
    return [_bucket(x) for x in out]


class NameModel:
    """Log-linear potentials of name words: of the word itself, of the word before and of the word after."""

    def __init__(self, weights: np.ndarray, context: float = 0.0, chain: float = CHAIN, skip: float = SKIP):
        self.weights, self.chain, self.skip = weights, chain, skip
        #: A word whose own potential is below this stays background: its context (`context` at most), two neighbours and two other mentions can't
        #: add up to as much.
        self.context_most, self.least = context, -context - 2 * chain - 2 * skip
        self._word: dict[str, float] = {}
        self._context: dict[str, float] = {}

    def word(self, w: str) -> float:
        if (v := self._word.get(w)) is None:
            b = token_pieces(w)
            v = float(self.weights[b].sum() / np.sqrt(len(b)) + self.weights[0])
            if len(self._word) < 200_000:
                self._word[w] = v
        return v

    def context(self, key: str) -> float:
        if (v := self._context.get(key)) is None:
            v = float(self.weights[_bucket(key)])
            if len(self._context) < 200_000:
                self._context[key] = v
        return v


def _same(word: str) -> str:
    """What equal mentions of a name have in common: lower case without accents and without an English genitive."""
    w = word.casefold()
    if w.endswith(("'s", "’s")):
        w = w[:-2]
    return w if w.isascii() else _plain(w)


def names_of(text: str) -> list[tuple[int, int, str]]:
    """The capitalised words of a text, as (start, end, word)."""
    return [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]


def _neighbours(text: str, s: int, e: int) -> tuple[str, str]:
    """Context features of the word at s..e: the words beside it, or the signs, or that a line begins or ends."""
    i = s
    while i and not (text[i - 1].isalnum() or text[i - 1] == "\n"):
        i -= 1
    gap = text[i:s]
    if not i or text[i - 1] == "\n":
        p = "^"
    elif not gap.strip(" ,(\"“<[>|"):
        j = i
        while j and (text[j - 1].isalnum() or text[j - 1] in "’'-"):
            j -= 1
        p = text[j:i].casefold()
    else:
        p = gap.strip()[-1:]
    gap, w = _AFTER.match(text, e, e + 40).groups()
    if "\n" in gap or e + len(gap) >= len(text):
        n = "$"
    elif w and not gap.strip(" ,)\"”>[<"):
        n = w.casefold()
    else:
        n = gap.strip()[:1] or "."
    return "p:" + p, "n:" + n


def fit_names(texts: list[str], lexicon: set[str], epochs: int = 3, seed: int = 7) -> NameModel:
    """Fit the name potentials: capitalised words of the lexicon are names, the others aren't; each fit sees BUCKETS weights at most."""
    rows, labels = [], []
    pieces: dict[str, tuple[list[int], bool]] = {}
    bucket: dict[str, int] = {}
    for t in texts:
        for s, e, w in names_of(t):
            if w not in pieces:
                pieces[w] = token_pieces(w), all(part in lexicon for part in _plain(w).split("-"))
            near = []
            for key in _neighbours(t, s, e):
                if key not in bucket:
                    bucket[key] = _bucket(key)
                near.append(bucket[key])
            rows.append((pieces[w][0], near))
            labels.append(pieces[w][1])
    w = np.zeros(BUCKETS)
    if not rows or not any(labels):
        return NameModel(w)
    y = np.array(labels, dtype=float)
    width = max(len(a) for a, _ in rows) + 3
    idx, val = np.zeros((len(rows), width), dtype=np.int64), np.zeros((len(rows), width))
    for k, (a, b) in enumerate(rows):
        n = len(a)
        idx[k, :n], val[k, :n] = a, 1 / np.sqrt(n)
        idx[k, n : n + 2], val[k, n : n + 2] = b, 1.0
        val[k, n + 2] = 1.0  # bucket 0 is the bias
    rng, grad2 = np.random.default_rng(seed), np.full(BUCKETS, 1e-6)
    for _ in range(max(epochs, min(30, 300_000 // len(y)))):  # small samples are gone through more often
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            i, v = idx[part], val[part]
            z = (w[i] * v).sum(1)
            g = ((1 / (1 + np.exp(-z)) - y[part])[:, None] * v + 1e-5 * w[i] * (v != 0)).ravel()
            i = i.ravel()
            np.add.at(grad2, i, g * g)
            np.add.at(w, i, -0.25 * g / np.sqrt(grad2[i]))
    top = [max((w[bucket[k]] for k in bucket if k[0] == side), default=0.0) for side in "pn"]
    return fit_edges(texts, lexicon, NameModel(w, float(sum(top))), epochs=60)


def fit_edges(texts: list[str], lexicon: set[str], model: NameModel, epochs: int) -> NameModel:
    """The model with chain and skip potentials that maximise the pseudo-likelihood of the sample's labels: of each name word given its own
    potential and the labels of its neighbours in the field. The prior keeps them small, as words of the lexicon always agree with themselves."""
    rows, ys = [], []
    for t in texts:
        nodes, edges = nodes_of(t, model)
        y = [1.0 if n[2] == 4 and all(p in lexicon for p in _plain(t[n[0] : n[1]]).split("-")) else -1.0 for n in nodes]
        chain, skip = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i, k, j in edges:
            if j == NUMBER:
                continue
            part = chain if j == model.chain else skip
            share = 1.0 if j in (model.chain, model.skip) else 0.5
            part[i] += share * y[k]
            part[k] += share * y[i]
        rows += [(n[3], c, s) for n, c, s in zip(nodes, chain, skip) if n[2] == 4]
        ys += [v for n, v in zip(nodes, y) if n[2] == 4]
    if not rows:
        return model
    x, y, w = np.array(rows), np.array(ys), np.array([1.0, CHAIN, SKIP])
    for e in range(epochs):  # the own potential enters as it is
        z = x @ w
        g = -(y / (1 + np.exp(np.clip(y * z, -30, 30)))) @ x / len(y)
        g[1:] += 0.02 * w[1:]
        w[1:] = np.clip(w[1:] - 2.0 / (1 + 0.05 * e) * g[1:], 0.05, MOST)
    return NameModel(model.weights, model.context_most, float(w[1]), float(w[2]))


_DIGITS = re.compile(r"\D+")


def nodes_of(text: str, model: NameModel) -> tuple[list[tuple[int, int, int, float, str]], list[tuple[int, int, float]]]:
    """Candidate spans (start, end, kind, potential, key) of a text, and the edges (i, j, potential) between them."""
    nodes: list[tuple[int, int, int, float, str]] = []
    taken: list[tuple[int, int]] = []

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for a, b in taken)

    def add(s: int, e: int, kind: int, u: float, key: str) -> None:
        nodes.append((s, e, kind, u, key))
        taken.append((s, e))

    at = text.find("@")
    while at >= 0:
        i = at
        while i and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            while text[i] in ".'-%":
                i += 1
            if i < at:
                add(i, m.end(), 0, 6.0, text[i : m.end()].casefold())
        at = text.find("@", m.end() if m else at + 1)
    for mark in _AT_MARKS:
        at = text.find(mark)
        while at >= 0:
            i = at - 1 if at and text[at - 1].isspace() else at  # the local part, up to a blank before the mark
            while i and (text[i - 1].isalnum() or text[i - 1] in "_.+=-"):
                i -= 1
            for m in _HIDDEN.finditer(text, i, at + 90):
                if m.start() <= at + 3 and free(m.start(), m.end()) and not _NO_HIDDEN.search(m.group()):
                    add(m.start(), m.end(), 0, 4.0, m.group().casefold())
                break
            at = text.find(mark, at + len(mark))
    done = 0
    for c in _NUMBER.finditer(text):
        i, e = c.span()
        if e - i > 5 or i < done:
            continue
        after = _AFTER_NUMBER.match(text, e)
        if after and after.group()[-1] > " " and not _EN_TYPE.search(text, e, e + 55):
            after = None
        if not after:
            w = text[text.rfind(" ", 0, max(0, i - 1)) + 1 : max(0, i - 1)].rstrip(",")
            if not w.endswith(_STREET_ENDS) and (not w[-1:].isalpha() or not _STREET_STARTS.search(text, max(0, i - 45), i)):
                continue
        for m in _ADDRESS.finditer(text, max(done, i - 45), e + 70):
            if free(m.start(), m.end()):
                add(m.start(), m.end(), 3, 3.0, m.group().casefold())
                done = m.end()
            break
    for c in _LONG.finditer(text):
        lo, hi = max(0, c.start() - 8), c.end() + 14
        for m in _ID.finditer(text, lo, hi):
            if free(m.start(), m.end()):
                s, e = m.span()
                near = bool(_ID_WORDS.search(text, max(0, s - 60), s) or _ID_WORDS.search(text, e, min(len(text), e + 40)))
                u = (3.0 if _SURE_ID.fullmatch(m.group()) else DOUBTFUL) + (3.5 if near else 0.0) - (2.5 if _NO_ID.search(text, max(0, s - 30), s) else 0.0)
                if u > 0:
                    add(s, e, 2, u, _DIGITS.sub("", m.group()))
                else:
                    nodes.append((s, e, 2, u, _DIGITS.sub("", m.group())))
        for m in _PHONE.finditer(text, lo, hi):
            digits = _DIGITS.sub("", m.group())
            if free(m.start(), m.end()) and (7 <= len(digits) <= 20 or m.group()[0].isalpha()):
                add(m.start(), m.end(), 1, 4.0, digits)
    for mark in _SPOKEN:
        i = text.find(mark)
        while i >= 0:
            for m in _PHONE.finditer(text, max(0, text.rfind(" ", 0, i) - 30), i + 80):
                if m.group()[0].isalpha() and free(m.start(), m.end()):
                    add(m.start(), m.end(), 1, 4.0, m.group().casefold())
            i = text.find(mark, i + 1)
    taken.sort()
    edges: list[tuple[int, int, float]] = []
    seen: dict[str, int] = {}
    for k, n in enumerate(nodes):
        if (j := seen.get(n[4])) is not None:
            edges.append((j, k, NUMBER))
        seen[n[4]] = k
    last, at, word, least = -9, 0, model.word, model.least
    for s, e, w in names_of(text):
        u = word(w)
        if u < least:
            continue
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at < len(taken) and taken[at][0] < e:
            continue
        p, n = _neighbours(text, s, e)
        u += model.context(p) + model.context(n)
        if len(w) == 1:
            u -= 2.0
        k = len(nodes)
        key = _same(w)
        nodes.append((s, e, 4, u, key))
        if 0 < s - last <= 2 and text[last:s] in (" ", ", ", "-", ". ", "\n"):
            edges.append((k - 1, k, model.chain))
        last = e
        if (j := seen.get(key)) is not None:
            edges.append((j, k, model.skip))
        elif "-" in key or key[-1:] == "s":  # half of a double name, or a name with the s of a genitive
            for other in (*key.split("-"), key[:-1]):
                if (j := seen.get(other)) is not None and other != key:
                    edges.append((j, k, model.skip / 2))
                    break
        seen[key] = k
    return nodes, edges


def propagate(u: np.ndarray, src: np.ndarray, dst: np.ndarray, j: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log-odds of every node after loopy message passing over undirected edges (src, dst) with agreement potentials j."""
    if not len(src):
        return u
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    t, n = np.tanh(np.concatenate([j, j]) / 2), len(src)
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    msg = np.zeros(2 * n)
    for _ in range(rounds):
        belief = u + np.bincount(b, msg, len(u))
        msg = 2 * np.arctanh(t * np.tanh(np.clip(belief[a] - msg[back], -12, 12) / 2))
    return u + np.bincount(b, msg, len(u))


def label(texts: list[str | None], model: NameModel, field: bool = True) -> list[list[tuple[int, int, str]]]:
    """Mentions (start, end, kind) of each text, by one run of message passing over all of them. field: without it every node goes by its own
    potential alone, to show what the field decides."""
    per, u, src, dst, pot = [], [], [], [], []
    for t in texts:
        nodes, edges = nodes_of(t, model) if t else ([], [])
        base = len(u)
        per.append((nodes, base))
        u += [x[3] for x in nodes]
        for i, k, j in edges:
            src.append(base + i)
            dst.append(base + k)
            pot.append(j)
    own = np.array(u, dtype=float)
    on = (propagate(own, np.array(src, dtype=np.int64), np.array(dst, dtype=np.int64), np.array(pot, dtype=float)) if field else own) > 0
    return [sorted((n[0], n[1], KINDS[n[2]]) for k, n in enumerate(nodes) if on[base + k]) for nodes, base in per]


def replace(text: str, mentions: list[tuple[int, int, str]]) -> str:
    """The text with each mention replaced by the placeholder of its kind; adjoining name words become one."""
    out, at, before = [], 0, ""
    for s, e, kind in mentions:
        if s < at:
            continue
        gap = text[at:s]
        if kind == before == "person_name" and gap in (" ", ", ", "-", ". "):
            at = e
            continue
        out += [gap, PLACEHOLDER[kind]]
        at, before = e, kind
    out.append(text[at:])
    return "".join(out)


_FAMILY = re.compile(r"^([^\W\d_]+(?:-[^\W\d_]+)?)-[^\W\d_]$")
_DISPLAY = (re.compile(r'^"([^\W\d_][\w-]+), ([^\W\d_][\w-]+)" <'), re.compile(r"^([A-ZÀ-Þ][\w-]+) ([A-ZÀ-Þ][\w-]+)(?: <|$)"), re.compile(r"\(([A-ZÀ-Þ][\w-]+) ([A-ZÀ-Þ][\w-]+)\)$"))

#: Names in the headers of earlier mail within a body.
_IN_HEADER = re.compile(r"^[ >|]*(?:From|To|Cc|Von|An|De|À|Para|Da|A|Van|Aan|От|Кому):[ \t]+([A-ZÀ-Þ][\w’-]+)(?: [A-Z]\.)? ([A-ZÀ-Þ][\w’-]+)[ \t]*(?:$|[<\[;])", re.M)


def _sample(df: DataFrame, key: str, rows: int) -> list:
    """At most `rows` rows by the hash of their key; thinned by hash first, so that no task sends more than its share."""
    share = max(1, df.count() // (2 * rows))
    return df.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).orderBy(F.xxhash64(key, F.lit(1)), key).limit(rows).collect()


def fit(mail: DataFrame, reports: DataFrame, rows: int = SAMPLE_ROWS) -> NameModel:
    """The name model from at most `rows` rows of each table: display names of senders, names in headers of earlier mail and owners of mailboxes are the names."""
    some = _sample(mail.where("message is not null and id is not null").select("id", "message", "mailbox"), "id", rows)
    senders = _sample(reports.where("originalmailfrom is not null and report_id is not null").select("report_id", "originalmailfrom"), "report_id", rows)
    names: set[str] = set()
    for r in some:
        if m := _FAMILY.match(r["mailbox"] or ""):
            names |= set(_plain(m.group(1)).split("-"))
        for m in _IN_HEADER.finditer(r["message"]):
            names |= {x for g in m.groups() for x in _plain(g).split("-")}
    for r in senders:
        for p in _DISPLAY:
            if m := p.search(r["originalmailfrom"]):
                names |= {x for g in m.groups() for x in _plain(g).split("-")}
    return fit_names([canonical(r["message"]) for r in some] + [canonical(r["originalmailfrom"]) for r in senders], names)


def find_mentions(df: DataFrame, model: NameModel) -> DataFrame:
    """df(tab, rec_id, text) -> (tab, rec_id, text with placeholders, kinds), one row per row of df whose text isn't null."""
    held = df.sparkSession.sparkContext.broadcast((model.weights, model.context_most, model.chain, model.skip))  # BUCKETS numbers, whatever the data
    schema = "tab string, rec_id long, text string, kinds array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NameModel(*held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                tab, rec, text = (c.to_pylist() for c in b.slice(lo, 1000).columns)
                text = [canonical(t) for t in text]
                rows = [(a, r, replace(t, m) if m else t, sorted({k for _, _, k in m})) for a, r, t, m in zip(tab, rec, text, label(text, own)) if t is not None]
                yield batch_of(rows, schema)

    return df.select("tab", F.col("rec_id").cast("long"), "text").mapInArrow(run, schema)


def found(mail: DataFrame, reports: DataFrame) -> DataFrame:
    """(tab, rec_id, kind) of the records that mention a detail of that kind."""
    model = fit(mail, reports)
    both = mail.select(F.lit("enron_dataset").alias("tab"), F.col("id").alias("rec_id"), F.col("message").alias("text")).unionByName(
        reports.select(F.lit("arf_result").alias("tab"), F.col("report_id").alias("rec_id"), F.col("originalmailfrom").alias("text"))
    )
    return find_mentions(both, model).where("rec_id is not null").select("tab", "rec_id", F.explode("kinds").alias("kind")).distinct()
