"""Stemming of German, Spanish, French, Italian, Portuguese and Russian words by the published Snowball definitions.

Each language is a table of endings, in the groups that its definition treats alike, and a short function over regions of the word: R1 begins
after the first consonant that follows a vowel, R2 is the same within R1, RV depends on the language.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

# Endings of each language, as its definition groups them.
GERMAN = {"1": "em ern er e en es s".split(), "2": "en er est st".split(), "3": "end ung ig ik isch lich heit keit".split()}
SPANISH = {
    "pronoun": "me se sela selo selas selos la le lo las les los nos".split(), "after": "iéndo ándo ár ér ír ando iendo ar er ir".split(),
    "plain": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias".split(), "log": "logía logías".split(), "u": "ución uciones".split(), "ente": "encia encias".split(),
    "idad": "idad idades".split(), "iv": "iva ivo ivas ivos".split(), "y": "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split(), "gu": "en es éis emos".split(),
    "verb": (
        "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
        "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
        "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
    ).split(),
}
PORTUGUESE = {
    "plain": "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split(),
    "log": "logia logias".split(), "u": "uça~o uço~es".split(), "ente": "ência ências".split(), "idad": "idade idades".split(), "iv": "iva ivo ivas ivos".split(), "ira": "ira iras".split(),
    "verb": (
        "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo "
        "ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis "
        "éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
    ).split(),
}
ITALIAN = {
    "pronoun": "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split(),
    "plain": "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split(),
    "ic": "azione azioni atore atori".split(), "log": "logia logie".split(), "u": "uzione uzioni usione usioni".split(), "ente": "enza enze".split(), "ment": "amento amenti imento imenti".split(), "iv": "ivo ivi iva ive".split(),
    "verb": (
        "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva "
        "evamo evano evate evi evo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir Yamo"
    ).split(),
}
FRENCH = {
    "plain": "ance iqUe isme able iste eux ances iqUes ismes ables istes".split(), "ic": "atrice ateur ation atrices ateurs ations".split(), "log": "logie logies".split(), "u": "usion ution usions utions".split(), "ent": "ence ences".split(),
    "ement": "ement ements".split(), "ite": "ité ités".split(), "if": "if ive ifs ives".split(), "eaux": ["eaux"], "aux": ["aux"], "euse": "euse euses".split(), "issement": "issement issements".split(), "amment": ["amment"], "emment": ["emment"], "ment": "ment ments".split(),
    "i": "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split(),
    "er": "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split(), "a": "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split(),
}
RUSSIAN = {
    "gerund1": "в вши вшись".split(), "gerund2": "ив ивши ившись ыв ывши ывшись".split(), "reflexive": "ся сь".split(),
    "adjective": "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split(), "participle1": "ем нн вш ющ щ".split(), "participle2": "ивш ывш ующ".split(),
    "verb1": "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "verb2": "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
    "noun": "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split(),
}


def _after_first(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first consonant that follows a vowel begins, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _rv(word: str, vowels: str) -> int:
    """RV of Spanish, Portuguese and Italian."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


def _longest(word: str, *groups: list[str]) -> tuple[str, int]:
    """The longest ending of the word that is in one of the groups, and the group's number; the empty string and -1 if none is."""
    return max(((s, n) for n, g in enumerate(groups) for s in g if word.endswith(s)), key=lambda x: len(x[0]), default=("", -1))


class _Word:
    """A word with its regions; they are places, so that shortening the word leaves them."""

    def __init__(self, text: str, vowels: str, rv: int, r1_least: int = 0):
        self.text, self.vowels, self.rv = text, vowels, rv
        self.r1 = max(_after_first(text, vowels), r1_least) if r1_least else _after_first(text, vowels)
        self.r2 = _after_first(text, vowels, _after_first(text, vowels))

    def has(self, ending: str, region: int) -> bool:
        return self.text.endswith(ending) and len(self.text) - len(ending) >= region

    def cut(self, ending: str, region: int, new: str = "") -> bool:
        """Replace an ending if it is in a region."""
        if ending and self.has(ending, region):
            self.text = self.text[: len(self.text) - len(ending)] + new
            return True
        return False

    def cut_any(self, endings: str, region: int) -> bool:
        """Delete the longest of some endings that the word has, if it is in a region."""
        return self.cut(_longest(self.text, endings.split())[0], region)


def _between(word: str, letters: str, vowels: str) -> str:
    """Letters between vowels in capitals, so that they don't count as vowels."""
    out = list(word)
    for i in range(1, len(word) - 1):
        if word[i] in letters and out[i - 1] in vowels and word[i + 1] in vowels:
            out[i] = word[i].upper()
    return "".join(out)


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    text = _between(word.replace("ß", "ss"), "uy", vowels)
    w = _Word(text, vowels, 0, 3)
    s, _ = _longest(w.text, GERMAN["1"])
    if s == "s":
        if w.text[-2:-1] in tuple("bdfghklmnrt"):
            w.cut(s, w.r1)
    elif w.cut(s, w.r1) and s in ("e", "en", "es") and w.text.endswith("niss"):
        w.text = w.text[:-1]
    s, _ = _longest(w.text, GERMAN["2"])
    if s == "st":
        if len(w.text) > 5 and w.text[-3] in "bdfghklmnt":
            w.cut(s, w.r1)
    else:
        w.cut(s, w.r1)
    s, _ = _longest(w.text, GERMAN["3"])
    before = w.text[: len(w.text) - len(s)] if s else ""
    if s in ("end", "ung"):
        if w.cut(s, w.r2) and w.has("ig", w.r2) and not w.text.endswith("eig"):
            w.cut("ig", w.r2)
    elif s in ("ig", "ik", "isch"):
        if not before.endswith("e"):
            w.cut(s, w.r2)
    elif s in ("lich", "heit"):
        if w.cut(s, w.r2):
            w.cut_any("er en", w.r1)
    elif s == "keit" and w.cut(s, w.r2):
        w.cut_any("lich ig", w.r2)
    return w.text.lower().translate(str.maketrans("äöü", "aou"))


_PLAIN = str.maketrans("áéíóú", "aeiou")


def _mente(w: _Word, others: str) -> bool:
    """The ending -amente of Spanish, Portuguese and Italian."""
    if not w.cut("amente", w.r1):
        return False
    if w.cut("iv", w.r2):
        w.cut("at", w.r2)
    else:
        w.cut_any(others, w.r2)
    return True


def spanish(word: str) -> str:
    t, vowels = SPANISH, "aeiouáéíóúü"
    w = _Word(word, vowels, _rv(word, vowels))
    p, _ = _longest(w.text, t["pronoun"])
    if p:
        stem = w.text[: len(w.text) - len(p)]
        a, _ = _longest(stem, t["after"])
        if a and len(stem) - len(a) >= w.rv or stem.endswith("uyendo") and len(stem) - 5 >= w.rv:
            w.text = stem[: len(stem) - len(a)] + a.translate(_PLAIN) if a in t["after"][:5] else stem
    s, g = _longest(w.text, t["plain"], t["ic"], t["log"], t["u"], t["ente"], ["amente"], ["mente"], t["idad"], t["iv"])
    done = False
    if g == 0:
        done = w.cut(s, w.r2)
    elif g == 1:
        done = w.cut(s, w.r2)
        if done:
            w.cut("ic", w.r2)
    elif g in (2, 3, 4):
        done = w.cut(s, w.r2, ("log", "u", "ente")[g - 2])
    elif g == 5:
        done = _mente(w, "os ic ad")
    elif g >= 6:
        done = w.cut(s, w.r2)
        if done:
            w.cut_any(("ante able ible", "abil ic iv", "at")[g - 6], w.r2)
    if not done:
        s, _ = _longest(w.text[w.rv :], t["y"])
        if s and w.text[: len(w.text) - len(s)].endswith("u"):
            w.cut(s, w.rv)
        else:
            s, g = _longest(w.text[w.rv :], t["gu"], t["verb"])
            if w.cut(s, w.rv) and g == 0 and w.text.endswith("gu"):
                w.text = w.text[:-1]
    s, g = _longest(w.text, "os a o á í ó".split(), "e é".split())
    if w.cut(s, w.rv) and g == 1 and w.text.endswith("gu") and len(w.text) - 1 >= w.rv:
        w.text = w.text[:-1]
    return w.text.translate(_PLAIN)


def portuguese(word: str) -> str:
    t, vowels = PORTUGUESE, "aeiouáéíóúâêô"
    text = word.replace("ã", "a~").replace("õ", "o~")
    w = _Word(text, vowels, _rv(text, vowels))
    s, g = _longest(w.text, t["plain"], t["log"], t["u"], t["ente"], ["amente"], ["mente"], t["idad"], t["iv"], t["ira"])
    done = False
    if g == 0:
        done = w.cut(s, w.r2)
    elif g in (1, 2, 3):
        done = w.cut(s, w.r2, ("log", "u", "ente")[g - 1])
    elif g == 4:
        done = _mente(w, "os ic ad")
    elif g in (5, 6, 7):
        done = w.cut(s, w.r2)
        if done:
            w.cut_any(("ante avel ível", "abil ic iv", "at")[g - 5], w.r2)
    elif g == 8 and w.text[: len(w.text) - len(s)].endswith("e"):
        done = w.cut(s, w.rv, "ir")
    if not done:
        done = w.cut(_longest(w.text[w.rv :], t["verb"])[0], w.rv)
    if done:
        if w.text.endswith("ci"):
            w.cut("i", w.rv)
    else:
        w.cut(_longest(w.text, "os a i o á í ó".split())[0], w.rv)
    s, _ = _longest(w.text, "e é ê".split())
    if w.cut(s, w.rv):
        if w.text.endswith(("gu", "ci")) and len(w.text) - 1 >= w.rv:
            w.text = w.text[:-1]
    elif w.text.endswith("ç"):
        w.text = w.text[:-1] + "c"
    return w.text.replace("a~", "ã").replace("o~", "õ")


def italian(word: str) -> str:
    t, vowels = ITALIAN, "aeiouàèìòù"
    text = _between(word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU"), "ui", vowels)
    w = _Word(text, vowels, _rv(text, vowels))
    p, _ = _longest(w.text, t["pronoun"])
    if p:
        stem = w.text[: len(w.text) - len(p)]
        a, g = _longest(stem, ["ando", "endo"], ["ar", "er", "ir"])
        if a and len(stem) - len(a) >= w.rv:
            w.text = stem if g == 0 else stem + "e"
    s, g = _longest(w.text, t["plain"], t["ic"], t["log"], t["u"], t["ente"], t["ment"], ["amente"], ["ità"], t["iv"])
    done = False
    if g in (0, 1):
        done = w.cut(s, w.r2)
        if done and g == 1:
            w.cut("ic", w.r2)
    elif g in (2, 3, 4):
        done = w.cut(s, w.r2, ("log", "u", "ente")[g - 2])
    elif g == 5:
        done = w.cut(s, w.rv)
    elif g == 6:
        done = _mente(w, "os ic abil")
    elif g == 7:
        done = w.cut(s, w.r2)
        if done:
            w.cut_any("abil ic iv", w.r2)
    elif g == 8:
        done = w.cut(s, w.r2)
        if done and w.cut("at", w.r2):
            w.cut("ic", w.r2)
    if not done:
        w.cut(_longest(w.text[w.rv :], t["verb"])[0], w.rv)
    if w.cut(_longest(w.text, list("aeioàèìò"))[0], w.rv):
        w.cut("i", w.rv)
    if w.has("ch", w.rv) or w.has("gh", w.rv):
        w.text = w.text[:-1]
    return w.text.lower()


def _french_marks(word: str, vowels: str) -> str:
    out = list(word)
    for i, c in enumerate(word):
        before, after = out[i - 1] if i else "", word[i + 1] if i + 1 < len(word) else ""
        if c == "u" and before == "q" or c in "ui" and before and after and before in vowels and after in vowels or c == "y" and (before and before in vowels or after and after in vowels):
            out[i] = c.upper()
    return "".join(out)


def french(word: str) -> str:
    t, vowels = FRENCH, "aeiouyâàëéêèïîôûù"
    text = _french_marks(word, vowels)
    if text.startswith(("par", "col", "tap")):
        rv = 3
    elif len(text) > 1 and text[0] in vowels and text[1] in vowels:
        rv = min(3, len(text))
    else:
        rv = next((i + 1 for i in range(1, len(text)) if text[i] in vowels), len(text))
    w = _Word(text, vowels, rv)
    names = ("plain", "ic", "log", "u", "ent", "ement", "ite", "if", "eaux", "aux", "euse", "issement", "amment", "emment", "ment")
    s, g = _longest(w.text, *(t[n] for n in names))
    name, start, done, verbs = names[g] if g >= 0 else "", w.text, False, False
    stem = w.text[: len(w.text) - len(s)]
    if name in ("plain", "log", "u", "ent"):
        done = w.cut(s, w.r2, {"plain": "", "log": "log", "u": "u", "ent": "ent"}[name])
    elif name == "ic":
        done = w.cut(s, w.r2)
        if done and w.text.endswith("ic") and not w.cut("ic", w.r2):
            w.text = w.text[:-2] + "iqU"
    elif name == "ement":
        done = w.cut(s, w.rv)
        if done:
            if w.text.endswith("iv"):
                if w.cut("iv", w.r2):
                    w.cut("at", w.r2)
            elif w.text.endswith("eus"):
                _ = w.cut("eus", w.r2) or w.cut("eus", w.r1, "eux")
            elif w.text.endswith(("abl", "iqU")):
                w.cut(w.text[-3:], w.r2)
            elif w.text.endswith(("ièr", "Ièr")):
                w.cut(w.text[-3:], w.rv, "i")
    elif name == "ite":
        done = w.cut(s, w.r2)
        if done:
            if w.text.endswith("abil"):
                _ = w.cut("abil", w.r2) or w.cut("abil", 0, "abl")
            elif w.text.endswith("ic"):
                _ = w.cut("ic", w.r2) or w.cut("ic", 0, "iqU")
            else:
                w.cut("iv", w.r2)
    elif name == "if":
        done = w.cut(s, w.r2)
        if done and w.cut("at", w.r2) and w.text.endswith("ic"):
            _ = w.cut("ic", w.r2) or w.cut("ic", 0, "iqU")
    elif name == "eaux":
        done = w.cut(s, 0, "eau")
    elif name == "aux":
        done = w.cut(s, w.r1, "al")
    elif name == "euse":
        done = w.cut(s, w.r2) or w.cut(s, w.r1, "eux")
    elif name == "issement":
        done = bool(stem) and stem[-1] not in vowels and w.cut(s, w.r1)
    elif name in ("amment", "emment"):
        verbs = done = w.cut(s, w.rv, name[0] + "nt")
    elif name == "ment":
        verbs = done = bool(stem) and stem[-1] in vowels and len(stem) > w.rv and w.cut(s, w.rv)
    if not done or verbs:
        s, _ = _longest(w.text[w.rv :], t["i"])
        at = len(w.text) - len(s)
        if s and at > w.rv and w.text[at - 1] not in vowels and w.cut(s, w.rv):
            done = True
        else:
            s, g = _longest(w.text[w.rv :], ["ions"], t["er"], t["a"])
            if g == 0:
                done = w.cut(s, w.r2) or verbs
            elif g == 1:
                done = w.cut(s, w.rv)
            elif g == 2:
                done = w.cut(s, w.rv)
                if done:
                    w.cut("e", w.rv)
            else:
                done = verbs
    if done and w.text != start:
        if w.text.endswith("Y"):
            w.text = w.text[:-1] + "i"
        elif w.text.endswith("ç"):
            w.text = w.text[:-1] + "c"
    else:
        if len(w.text) > 1 and w.text[-1] == "s" and w.text[-2] not in "aiouès":
            w.text = w.text[:-1]
        s, _ = _longest(w.text[w.rv :], "ion ier ière Ier Ière e".split())
        if s == "ion":
            if w.text[: len(w.text) - 3][-1:] in ("s", "t") and len(w.text) - 4 >= w.rv:
                w.cut(s, w.r2)
        elif s == "e":
            w.cut(s, w.rv)
        elif s:
            w.cut(s, w.rv, "i")
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.text = w.text[:-1]
    i = len(w.text)
    while i and w.text[i - 1] not in vowels:
        i -= 1
    if 0 < i < len(w.text) and w.text[i - 1] in "éè":
        w.text = w.text[: i - 1] + "e" + w.text[i:]
    return w.text.lower()


def russian(word: str) -> str:
    t, vowels = RUSSIAN, "аеиоуыэюя"
    text = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(text) if c in vowels), len(text))
    w = _Word(text, vowels, rv)

    def ending(first: str | None, second: str) -> bool:
        """Delete the longest ending of two groups; one of the first must follow а or я."""
        s, g = _longest(w.text[rv:], t[first] if first else [], t[second])
        if g == 0 and w.text[: len(w.text) - len(s)][max(rv, 0) - len(w.text) + len(s) :][-1:] not in ("а", "я"):
            s = _longest(w.text[rv:], t[second])[0]
        return w.cut(s, rv)

    if not ending("gerund1", "gerund2"):
        w.cut(_longest(w.text[rv:], t["reflexive"])[0], rv)
        if w.cut(_longest(w.text[rv:], t["adjective"])[0], rv):
            ending("participle1", "participle2")
        elif not ending("verb1", "verb2"):
            w.cut(_longest(w.text[rv:], t["noun"])[0], rv)
    w.cut("и", rv)
    w.cut(_longest(w.text, ["ост", "ость"])[0], w.r2)
    if w.cut(_longest(w.text[rv:], ["ейш", "ейше"])[0], rv):
        if w.has("нн", rv):
            w.text = w.text[:-1]
    elif w.has("нн", rv):
        w.text = w.text[:-1]
    else:
        w.cut("ь", rv)
    return w.text


STEMMERS: dict[str, Callable[[str], str]] = {"de": german, "es": spanish, "fr": french, "it": italian, "pt": portuguese, "ru": russian}


@lru_cache(200_000)
def stem(word: str, lang: str) -> str:
    """The stem of a lower-case word; the word itself for other languages."""
    return STEMMERS[lang](word) if lang in STEMMERS and len(word) > 1 else word
