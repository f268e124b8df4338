"""Mail bodies reduced to what their sender newly wrote.

A body is read line by line under rules for eight languages: quote prefixes, attribution lines (also broken over several
lines), headers and separators of earlier and forwarded mail, signature delimiters, closing formulas followed by a name, tag
lines of devices, and legal notices. Prefixed quotations end with their prefix, so replies written between them stay.
Earlier mail that is announced by a header without prefixes runs to the end, or to the end of its enclosing block.

Defined results: null stays null, empty text stays empty, text without any part comes back as it is apart from blank lines at
its ends; a body that is all quotation gives an empty text. Texts of any length are read whole. Repeated rows give
equal results, other columns are ignored.
"""

from __future__ import annotations

import re
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.arrow import map_rows

PARTS = ("quoted", "signature", "disclaimer")

#: Header words of earlier mail in the eight languages.
_FROM = r"(?:From|Von|De|Da|Van|От|Absender|Expéditeur|Mittente|Afzender|Отправитель|Remitente|Remetente)"
_OTHER = r"(?:Sent|To|Cc|Subject|Date|Gesendet|An|Betreff|Datum|Envoyé|À|A|Objet|Enviado(?: el| em)?|Para|Asunto|Assunto|Fecha|Data|Inviato|Oggetto|Verzonden|Aan|Onderwerp|Отправлено|Кому|Тема|Дата|Reply-To|Le)"
_HEAD = re.compile(rf"^\s*[*_]?{_FROM}\s?:[*_]?\s*\S")
_HEAD2 = re.compile(rf"^\s*[*_]?{_OTHER}\s?:[*_]?\s")
_SEPARATOR = re.compile(
    r"^\s*(?:[-_=*]{3,}\s*[^\W\d_][^-_=*\n]{3,60}\s*[-_=*]{3,}|Begin forwarded message:|Anfang der weitergeleiteten (?:Nachricht|E-Mail):|Début du message (?:réexpédié|transféré)\s?:|Inicio del mensaje reenviado:|Inizio messaggio inoltrato:|Begin doorgestuurd bericht:|Início da mensagem (?:reencaminhada|encaminhada):|Начало пересланного сообщения:)\s*$"
)
#: Words of separators that announce earlier mail.
_EARLIER = re.compile(r"original|forward|earlier|previous|weitergeleitet|ursprüngliche|Urspr|transféré|d.origine|reenviado|encaminhad|inoltrat|doorgestuurd|oorspronkelijk|bericht|nachricht|message|mensaje|mensagem|messaggio|сообщение|пересыла|переслан|исходн", re.I)
_PREFIX = re.compile(r"^\s{0,3}(?:>|\|(?!.*\|\s*$))")
_INDENT = re.compile(r"^(?:\s{4,}|\t)")
_RULE = re.compile(r"^\s*[-_=]{20,}\s*$")

_WHEN = r"(?=[^\n]*\d)"
_ATTRIBUTION = re.compile(
    rf"^\s*(?:On\s{_WHEN}.{{3,160}}?\bwrote|Am\s{_WHEN}.{{3,120}}?\bschrieb\b.{{0,120}}?|Le\s{_WHEN}.{{3,160}}?\ba écrit|El\s{_WHEN}.{{3,160}}?\bescribió|Em\s{_WHEN}.{{3,160}}?\bescreveu|(?:Il|In data)\s{_WHEN}.{{3,160}}?\bha scritto|Op\s{_WHEN}.{{3,120}}?\bschreef\b.{{0,120}}?|{_WHEN}.{{3,160}}?\bпишет|{_WHEN}.{{3,160}}?\bнаписал(?:а|\(а\))?|[^\n]{{3,90}}\b(?:wrote|writes|schrieb|a écrit|escribió|escreveu|ha scritto|schreef|пишет|написал[аи]?))\s?:\s*$",
    re.S,
)
_ATTR_END = re.compile(r"(?:wrote|writes|écrit|escribió|escreveu|scritto|пишет|написал\S*)\s?:\s*$|\b(?:schrieb|schreef)\b.*:\s*$|>:\s*$|\":\s*$|[\w-]:\s*$")
_ATTR_VERB = re.compile(r"wrote|writes|schrieb|écrit|escribió|escreveu|scritto|schreef|пишет|написал")

#: Closing formulas, in lower case.
_CLOSING = re.compile(
    r"^\s*(?:(?:with )?(?:kind|best|warm|many|kindest|warmest)?\s*regards|best wishes|best|cheers|sincerely(?: yours)?|yours (?:sincerely|faithfully|truly)|many thanks|thanks(?: again)?|thank you|thx|respectfully|cordially|take care|all the best"
    r"|mit (?:freundlichen|besten|herzlichen|vielen) grü(?:ß|ss)en|(?:viele|beste|herzliche|liebe|schöne|freundliche) grü(?:ß|ss)e|mfg|gru(?:ß|ss)|hochachtungsvoll|(?:vielen |besten )?dank"
    r"|cordialement|bien (?:cordialement|à vous)|(?:meilleures |sincères )?salutations|amicalement|bonne journée|merci(?: beaucoup)?|à bientôt|veuillez agréer.{0,60}"
    r"|(?:un |muchos )?(?:cordial )?saludos?(?: cordiales?)?|atentamente|cordialmente|un abrazo|(?:muchas )?gracias|reciba un cordial saludo"
    r"|cordiali saluti|distinti saluti|(?:tanti |cari |un )?saluti?|a presto|grazie(?: mille)?"
    r"|atenciosamente|(?:com os )?(?:melhores )?cumprimentos|abraços?|(?:muito )?obrigad[oa]|cordialmente"
    r"|met (?:vriendelijke|hartelijke) groet(?:en)?|(?:vriendelijke |hartelijke )?groet(?:en|jes)?|hoogachtend|(?:alvast |hartelijk )?(?:bedankt|dank)"
    r"|с уважением|с наилучшими пожеланиями|всего доброго|спасибо|искренне ваш)\s*[,.!]?\s*$",
    re.I,
)
_DEVICE = re.compile(
    r"^\s*(?:sent (?:from|via|with|by) (?:my|a|an|the)\b.*|get \S+ (?:for|on) (?:your |my )?\S+.*|typed (?:on|with) .*|(?:von meinem .{2,40}|gesendet (?:von|mit|aus|über) .*)|.*von (?:meinem|unterwegs).{0,30}gesendet|envoyé (?:depuis|de|à partir de|avec) (?:mon|ma|un).*|enviado (?:desde|do|pelo|a partir|con) (?:mi|meu|el|o).*|inviato (?:dal|da|con) (?:mio|il|un)?.*|verzonden (?:vanaf|met|via|vanuit) (?:mijn|een).*|отправлено (?:с|из|через) .*)\s*$",
    re.I,
)
_DELIMITER = re.compile(r"^\s*(?:--|—|–|\*{3}|_{5,15}|-{3,12}|={3,12}|~{3,12})\s*$")
_W = r"[^\W\d_a-zà-ÿа-я][\w’'-]*\.?"
_NAME = re.compile(rf"^\s*[\"“]?(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau)\.?\s)?{_W}(?:\s(?:van|von|de|der|du|di|da|el|le)\s|\s|,\s)?(?:{_W})?(?:[\s-]{_W}){{0,2}}[\"”]?\s*(?:\([^)\n]{{2,40}}\))?\s*[,.]?\s*$")
_CARD = re.compile(rf"^\s*{_W}(?:\s{_W}){{1,3}}\s+[|/·•]\s+\S.*$|^\s*{_W}(?:\s{_W}){{0,2}}\s/\s{_W}\s(?:office|Office|Büro|bureau|oficina|ufficio|kantoor|escritório|офис)\s*$")
_CONTACT = re.compile(r"\+?\d[\d ().-]{6,}|@|https?://|www\.|\b(?:Tel|Phone|Fax|Mobile|Cell|Тел)\b|\bext\.|\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)(?:[ -](?:zero|oh|one|two|three|four|five|six|seven|eight|nine)){2}", re.I)
_LABEL = re.compile(r"^\s*(?:From|Von|De|Da|Van|От|Subject|Re|RE|Fwd|AW|WG|PS|P\.S\.)\b")

#: Words that only legal notices about a mail use. Two different ones in a paragraph make a notice.
_LEGAL = [
    re.compile(p, re.I)
    for p in (
        r"confidential|privileged|\bprivate\b|vertraulich|confidentiel|confidencial|riservat|confidenz|vertrouwelijk|конфиденциальн|secreto profesional|secret professionnel|Berufsgeheimnis|segreto|beroepsgeheim|sigilo|тайн",
        r"intended (?:only|solely)|meant solely|(?:named |intended )?(?:addressee|recipient)|für den (?:genannten |bestimmten )?(?:Empfänger|Adressat)|Empfänger bestimmt|destinataire|intention exclusive|uso exclusivo|uso esclusivo|uitsluitend|ausschließlich für|исключительно для|destinatario|destinatári|geadresseerde|bestemd voor|предназначен|адресат|получател",
        r"in error|by mistake|irrtümlich|versehentlich|par erreur|por error|por engano|per errore|abusievelijk|ten onrechte|per vergissing|по ошибке|\bnot (?:the|that) (?:intended|named|addressee|person|recipient)|if you are not|wenn Sie nicht|si vous n.êtes pas|si (?:usted )?no es|se non (?:è|siete)|se não (?:é|for)|(?:als|indien) u niet|если вы не|wrong (?:person|address|hands)",
        r"forbidden|prohibited|unauthori[sz]ed|strictly|untersagt|nicht gestattet|verboten|interdite?|prohibida|proibid|vietat|verboden|niet toegestaan|запрещен|не допускается",
        r"delete|destroy|copies|copying|löschen|vernichten|supprimer|détruire|borrar|elimin|destruir|apag|cancellar|verwijder|удалит|уничтож",
        r"disclos|distribut|dissemination|reliance|Weitergabe|Verbreitung|divulgation|diffusion|difusión|divulgación|divulgaç|diffusione|verspreid|openbaar|распростран|разглаш|копирован|пересыл",
        r"binding|monitor|liab|virus|haft|Erklärungen per E-Mail|binden|responsab|aansprakelijk|ответственност|no responde|mailverkeer|bindend|обязательств|property of|propiedad|Eigentum|propriété|proprietà|eigendom|propriedade|собственност",
        r"\bthis (?:e-?mail|message|transmission|communication)|any information in this|content of this|diese[rs]? (?:E-?Mail|Mail|Nachricht|Mitteilung)|(?:ce|présente?) (?:message|courriel|mail|communication)|cet? (?:e-?mail)|este (?:mensaje|correo|e-?mail)|esta (?:mensagem|comunicaci)|questo (?:messaggio|e-?mail)|questa (?:e-?mail|comunicazione)|dit (?:bericht|e-?mail)|deze (?:e-?mail|boodschap)|это (?:письмо|сообщение)|данное (?:письмо|сообщение)|настоящее|nothing herein|samt (?:ihren |allen )?Anh[äa]ng|et ses (?:pièces|annexes)|ses pièces jointes|y sus (?:adjuntos|anexos)|e seus anexos|i suoi allegati|en de bijlagen",
    )
]


def _stems(pattern: re.Pattern) -> list[str]:
    """A text that the pattern matches holds one of these, in lower case: the longest plain run of each of its alternatives."""
    tree = _parser.parse(pattern.pattern)
    branches = next((x[1][1] for x in tree if x[0] is _parser.BRANCH), [tree]) if len(tree) == 1 else [tree]
    out = []
    for b in branches:
        runs = "".join(chr(v) if op is _parser.LITERAL else "\n" for op, v in b).lower().split("\n")
        out.append(max(runs, key=len))
    return out


_LEGAL_STEMS = [_stems(p) for p in _LEGAL]


def _may_be_legal(text: str) -> bool:
    """Whether stems of three kinds of legal words are there; every text of a legal score of 3 passes."""
    low, found = text.lower(), 0
    for stems in _LEGAL_STEMS:
        for s in stems:
            if s in low:
                found += 1
                break
        if found == 3:
            return True
    return False


def _legal_score(text: str) -> int:
    return sum(bool(p.search(text)) for p in _LEGAL)


def label_lines(text: str) -> list[tuple[str, str]]:
    """(line, part) of every line of a body; part is new, quoted, signature or disclaimer."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    part = ["new"] * len(lines)
    _quoted(lines, part)
    _disclaimers(lines, part)
    _signatures(lines, part)
    return list(zip(lines, part))


def _quoted(lines: list[str], part: list[str]) -> None:
    n = len(lines)
    colon = [x.rstrip().endswith(":") for x in lines]
    i = 0
    while i < n:
        line = lines[i]
        ends = colon[i] or (i + 1 < n and colon[i + 1]) or (i + 2 < n and colon[i + 2])
        c = line.lstrip()[:1]
        if not c:
            i += 1
            continue
        if c in ">|" and _PREFIX.match(line):
            part[i] = "quoted"
            i += 1
            continue
        if c == "<" and line.strip().lower().startswith("<blockquote"):
            while i < n:
                part[i] = "quoted"
                i += 1
                if "</blockquote" in lines[i - 1].lower():
                    break
            continue
        if ":" in line[:20] and _HEAD.match(line) and any(_HEAD2.match(x) for x in lines[i + 1 : i + 4]):
            part[i:] = ["quoted"] * (n - i)
            for k in range(i - 1, -1, -1):  # the rule above the header
                if lines[k].strip() and not (_RULE.match(lines[k]) or _SEPARATOR.match(lines[k])):
                    break
                if lines[k].strip():
                    part[k] = "quoted"
                    break
            return
        if c in "-_=*B" + "ADIН" and _SEPARATOR.match(line) and _EARLIER.search(line):
            rest = [x for x in lines[i + 1 :] if x.strip()]
            if rest and (_PREFIX.match(rest[0]) or _INDENT.match(rest[0])):
                part[i] = "quoted"
                i += 1
                while i < n and (not lines[i].strip() or _PREFIX.match(lines[i]) or _INDENT.match(lines[i])):
                    part[i] = "quoted" if lines[i].strip() else part[i]
                    i += 1
                continue
            part[i:] = ["quoted"] * (n - i)
            return
        for span in (1, 2, 3) if ends else ():
            if i + span > n or (span > 1 and not lines[i + span - 1].strip()):
                break
            last = lines[i + span - 1].rstrip()
            if not last.endswith(":") or not _ATTR_END.search(last):
                continue
            whole = "\n".join(lines[i : i + span])
            if _ATTR_VERB.search(whole) and _ATTRIBUTION.match(whole.replace("\n", " ")):
                part[i : i + span] = ["quoted"] * span
                k = i + span
                while k < n and not lines[k].strip():
                    k += 1
                if k < n and not _PREFIX.match(lines[k]):
                    if _INDENT.match(lines[k]):
                        while k < n and (not lines[k].strip() or _INDENT.match(lines[k])):
                            part[k] = "quoted"
                            k += 1
                    elif not lines[k].lstrip().lower().startswith("<blockquote"):
                        part[k:] = ["quoted"] * (n - k)
                        return
                i = k - 1
                break
        i += 1


def _paragraphs(lines: list[str], part: list[str]) -> list[tuple[int, int]]:
    out, i, n = [], 0, len(lines)
    while i < n:
        if part[i] != "new" or not lines[i].strip():
            i += 1
            continue
        j = i
        while j < n and part[j] == "new" and lines[j].strip():
            j += 1
        out.append((i, j))
        i = j
    return out


_BORDER = re.compile(r"^\s*[*_=#-]{10,}\s*$")


def _disclaimers(lines: list[str], part: list[str]) -> None:
    for i, j in _paragraphs(lines, part):
        whole = " ".join(lines[i:j])
        if not _may_be_legal(whole) or _legal_score(whole) < 3:
            continue
        # a notice may share a paragraph with other text: it begins at a border or where its own words begin
        cuts = [i] + [k for k in range(i + 1, j) if _BORDER.match(lines[k])] + [j]
        for a, b in zip(cuts, cuts[1:]):
            if _legal_score(" ".join(lines[a:b])) < 3:
                continue
            full = [k for k in range(a, b) if _LEGAL[-1].search(" ".join(lines[k : k + 2])) and _legal_score(" ".join(lines[k:b])) >= 3]
            start = next((k for k in full if _LEGAL[-1].search(lines[k])), full[0] if full else a)
            end = b
            while end - 1 > start and _legal_score(lines[end - 1]) == 0 and (_DEVICE.match(lines[end - 1]) or _NAME.match(lines[end - 1])):
                end -= 1
            for k in range(start, end):
                part[k] = "disclaimer"
            if start - 1 >= 0 and _BORDER.match(lines[start - 1]) and part[start - 1] == "new":
                part[start - 1] = "disclaimer"
            if end < len(lines) and _BORDER.match(lines[end]) and part[end] == "new":
                part[end] = "disclaimer"


def _signatures(lines: list[str], part: list[str]) -> None:
    n = len(lines)

    def run(i: int) -> int:
        """End of the block that begins at i: as long as its lines are new and short, however many they are."""
        k = i
        while k < n and part[k] == "new" and lines[k].strip() and len(lines[k].strip()) < 110:
            k += 1
        return max(k, i + 1)

    for i in range(n):
        if part[i] != "new":
            continue
        line = lines[i]
        text = line.strip()
        if not text:
            continue
        if len(text) <= 60 and _DEVICE.match(line):
            part[i] = "signature"
            continue
        if _DELIMITER.match(line):
            k = i + 1
            while k < n and k <= i + 2 and not lines[k].strip() and part[k] == "new":
                k += 1
            if k < n and part[k] == "new" and (_NAME.match(lines[k]) or _CARD.match(lines[k]) or _CONTACT.search(lines[k])) and len(lines[k]) < 90:
                end = run(k)
                part[i:end] = ["signature"] * (end - i)
            continue
        if len(text) <= 70 and _CLOSING.match(line):
            k = i + 1
            while k < n and k <= i + 2 and not lines[k].strip() and part[k] == "new":
                k += 1
            if k < n and part[k] == "new" and len(lines[k].strip()) <= 60 and (_NAME.match(lines[k]) or _CARD.match(lines[k])) and not _LABEL.match(lines[k]) and not _CLOSING.match(lines[k]):
                end = run(k)
                part[i:end] = ["signature"] * (end - i)
            continue
        if len(text) <= 110 and _CARD.match(line):
            end = run(i)
            if _CONTACT.search("\n".join(lines[i:end])) or " / " in text:
                part[i:end] = ["signature"] * (end - i)
            continue
        if len(text) <= 45 and _NAME.match(line) and i and not lines[i - 1].strip() and not _LABEL.match(line):
            end = run(i)
            rest = lines[i + 1 : end]
            if rest and all(len(x) < 75 for x in rest) and _CONTACT.search("\n".join(rest)) and not any(x.rstrip().endswith((".", "?", "!")) and len(x) > 45 for x in rest):
                part[i:end] = ["signature"] * (end - i)


def newly_written(text: str | None) -> str | None:
    """The lines of a body that are its sender's own, without blank lines at the ends."""
    if not text:
        return text
    kept = [line for line, part in label_lines(text) if part == "new"]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def parts_of(text: str | None) -> list[str]:
    if not text:
        return []
    have = {p for line, p in label_lines(text) if line.strip()}
    return [p for p in PARTS if p in have]


def reduce_mail(df: DataFrame, key: str, column: str) -> DataFrame:
    """df(key, column, ...) -> (key, text, parts): the newly written text and which other parts the body had."""

    def one(k, text):
        if text is not None:
            labelled = label_lines(text)
            kept = "\n".join(line for line, part in labelled if part == "new")
            have = {p for line, p in labelled if line.strip()}
            yield k, re.sub(r"\n{3,}", "\n\n", kept).strip("\n"), [p for p in PARTS if p in have]

    return map_rows(df.select(F.col(key).cast("long"), column), one, f"{key} long, text string, parts array<string>")


def found(mail: DataFrame) -> DataFrame:
    """(id, part) of the parts that the bodies have besides newly written text."""
    return reduce_mail(mail, "id", "message").where("id is not null").select("id", F.explode("parts").alias("part")).distinct()
