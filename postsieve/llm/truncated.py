"""Texts that were cut off inside a word or a sentence, and how often each source cuts.

A text is compared in the form of its words: case, punctuation, line breaks, paragraph numbers, page headers and marks behind the end
don't count. Every text is hashed at the fixed lengths BASE, 2 BASE, 4 BASE ... bytes that it has. A text of length m can only be a
strict prefix of a text with the same hash at the greatest fixed length up to m; for each such hash the lengths of the texts
between it and the next fixed length are gathered (fewer than there are bytes between the two, however many texts share it), and
the longer texts with that hash are hashed at just these lengths. Only hashes, lengths and ids are shuffled or joined, no texts.

A text that is a strict prefix and breaks off where its copy goes on in the same word or sentence is cut. Texts without a longer
copy, and those of fewer than BASE bytes, are judged by their ending: a complete text ends a sentence or with a closing line, a name, place, date or redaction mark.

Defined results: null and blank texts are not cut and get no verdict. Equal copies share their verdict. Texts of any length are
compared whole. Repeated rows give a verdict each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.arrow import batch_of
from postsieve.llm.deliveries import SMALL
from postsieve.session import cut_lineage

#: Least fixed length at which texts are hashed, in bytes; the others are its doubles.
BASE = 16

#: A line that repeats court, number and page at the head of a page.
PAGE_HEAD = re.compile(r"^[^\n]{3,90}(?:[—–|,-]|\s)\s*\d+ [A-Z]{2,3} \d+/\d{4}(?:\s*[—–|-]\s*(?:Page|Seite|page|p\.|S\.)\s?\d+)?[ \t]*$", re.M)
_SPACE = re.compile(r"\s+")
#: Marks and stray characters that may stand behind a cut.
_MARKS = re.compile(r"(?:\s|�|\.\.\.|…|\[(?:more|mehr|suite|truncated|gekürzt|cut)\]|\((?:more|truncated|continued|mehr|suite)\)|<<|>>|»»|\x00|\\)+$", re.I)
_REDACTED = re.compile(r"(?:\[(?:…|\.\.\.|redacted|anonymi[sz]ed)\]|[█▇■]+|_{3,}|X\.(?:_+)?|\*{3,})\s*[.)]?\s*$", re.I)
_END = re.compile(r"[.!?:;][\"”’»)\]]*\s*$|[.!?][\"”’»]\s*$")
#: Abbreviations whose full stop ends no sentence.
_ABBREVIATION = re.compile(r"(?:^|[\s(\[])(?:[A-ZÀ-Þ]|vgl|Art|art|Abs|Nr|No|no|Rn|Rz|ff|f|E|S|p|pp|v|vs|al|cf|Cf|Dr|Mr|Mrs|Ms|Prof|St|lit|Ziff|Bd|bzw|usw|ca|Kap|sect|para|ch|consid|c|gez|Mme|M|n|op|cit|i\.e|e\.g|z\.B|d\.h)\.\s*$")
_DAY = re.compile(r"(?:^|\s)(?:[Aa]m|[Vv]om|[Dd]en|[Dd]em|[Bb]is zum|zum|seit dem|der|des)\s\d{1,2}\.\s*$")
_NUMBERING = re.compile(r"^\s*(?:§\s*\d+|\[\d+\]|\(\d+\)|\d+[.)]?|[A-Z][.)]|Rn\.? \d+)\s*")
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)"
_DATE_END = re.compile(rf"(?:\d{{1,2}}\.?(?:er)?\s{_MONTH}\s\d{{4}}|{_MONTH}\s\d{{1,2}},\s\d{{4}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{4}}-\d\d-\d\d)\s*$")
_PLACE = re.compile(r"^\s*(?:Done at|Ausgefertigt|Fait à|Given at|Delivered at|Verkündet|Dated)", re.I)
_W = r"[A-ZÀ-Þ][\w’'à-ÿ]*(?:-[A-ZÀ-Þ][\w’'à-ÿ]*)*"
_SIGNED = re.compile(rf"^\s*(?:gez\.|\(?signed\)?|\(?gezeichnet\)?|Signé\s?:|sig\.|/s/|Le juge|La juge|Der Richter|Die Richterin|Judge|Justice|Richter(?:in)?)\s+{_W}(?:\s[A-Z]\.)?\s{_W}(?:,\s[\w ]+)?\s*$", re.I)
_OFFICE = re.compile(r"(?:Judge|Richter(?:in)?|Registrar|Clerk|greffi(?:er|ère)|Justice|President|Präsident(?:in)?|Président(?:e)?|Gerichtsschreiber(?:in)?|Urkundsbeamter)\s*$")
#: A closing line: a note in brackets, a rule of signs, a page number, or the word that it ends here.
_CLOSER = re.compile(
    r"^\s*(?:\([^()]{2,60}\)|\[[^][]{2,60}\]|[-–—*_=~ ]{3,}|[-–—] ?\d+ ?[-–—]|(?:THE )?END(?: OF (?:THE )?(?:RULING|JUDGE?MENT|DECISION|ORDER|DOCUMENT|TEXT|REPORT))?|ENDE(?: (?:DER|DES) (?:ENTSCHEIDUNG|URTEILS|BESCHLUSSES|DOKUMENTS|TEXTES))?"
    r"|FIN(?: (?:DE LA|DE L[’']|DU) ?(?:DÉCISION|ARRÊT|JUGEMENT|ORDONNANCE|DOCUMENT|TEXTE))?)\s*$",
    re.I,
)

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\xad‐][ \t]*\n\s*(?=[^\W\d_])")
_PARAGRAPH = re.compile(r"^[ \t]*(?:§[ \t]*\d+|\[\d+\]|\(\d+\)|\d+\.(?=[ \t])|\d+\t|Rn\.?[ \t]*\d+)[ \t]*", re.M)
_NO_WORD = re.compile(r"[^\w\s]|_")


def body(text: str) -> tuple[str, list[int]]:
    """The comparable form of a text, its words in lower case with single spaces; and where in it lines of the text begin."""
    text = strip_marks(text)
    if PAGE_HEAD.search(text):
        text = PAGE_HEAD.sub("", text)
    text = _NO_WORD.sub("", _PARAGRAPH.sub("", _HYPHEN.sub("", text))).lower()
    out, starts, at = [], [], 0
    for line in text.split("\n"):
        words = line.split()
        if words:
            starts.append(at)
            out += words
            at += sum(map(len, words)) + len(words)
    return " ".join(out), starts


def strip_marks(text: str) -> str:
    """The text without marks of a cut and stray characters at its end; redaction marks stay."""
    if _REDACTED.search(text[-40:]):
        return text.rstrip()
    return text[: _tail_marks(text)]


def _last_line(text: str) -> tuple[str, str]:
    """The last line that isn't blank, and what stands before it."""
    text = text.rstrip()
    i = text.rfind("\n") + 1
    return text[i:], text[:i]


def ends_inside(text: str | None) -> bool:
    """Whether the text's ending alone says that it broke off inside a word or a sentence."""
    if not text or not text.strip():
        return False
    if _REDACTED.search(text[-40:]):
        return False
    text = strip_marks(text)
    if not text.strip():
        return True
    last, rest = _last_line(text)
    while rest.strip() and PAGE_HEAD.match(last):
        last, rest = _last_line(rest)
    start = last
    if _END.search(last[-40:]):
        return bool(last[-1] == "." and (_ABBREVIATION.search(last) or _DAY.search(last) or not _NUMBERING.sub("", last).strip(" .")) and not _OFFICE.search(last))
    before = _last_line(rest)[0]
    own = not before or bool(_END.search(before)) or bool(_SIGNED.match(before)) or bool(_CLOSER.match(before)) or bool(_REDACTED.search(before))
    if not own or len(start) > 90:
        return True
    if _CLOSER.match(start):
        return False
    if _PLACE.match(start):
        return not _DATE_END.search(start)
    if _NUMBERING.match(start) and not re.match(rf"\s*\d{{1,2}}\.?(?:er)?\s{_MONTH}", start):
        return True
    if _SIGNED.match(start) or _DATE_END.search(start):
        return False
    if _OFFICE.search(start) and (re.match(rf"^\s*(?:{_W}\s){{0,4}}", start) or len(start) < 40):
        return False
    return not (len(start.split()) <= 4 and re.fullmatch(rf"\s*{_W}(?:\s(?:[A-Z]\.\s)?{_W}){{1,3}}\s*", start) and not _NUMBERING.match(start))


def _tail_marks(text: str) -> int:
    """Where the marks and stray characters at the end begin, however long they are."""
    i = len(text)
    while m := _MARKS.search(text, max(0, i - 60), i):
        i = m.start()
    return i


def level_of(size: int) -> int:
    """How many fixed lengths there are up to a size."""
    return (size // BASE).bit_length()


def _hashes(raw: bytes) -> list[int]:
    return [xxhash.xxh3_64_intdigest(raw[: BASE << k]) - (1 << 63) for k in range(level_of(len(raw)))]


_NARROW = "doc_id long, source string, by_end boolean, open boolean, word boolean, size int, whole binary, hashes array<long>"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is compared of every text. open: it doesn't end a sentence. word: it ends with a letter or digit, so perhaps inside a word."""
    for b in batches:
        rows = []
        for i, s, t in zip(*(c.to_pylist() for c in b.columns)):
            if t is not None and t.strip():
                raw, end = body(t)[0].encode(), strip_marks(t).rstrip()
                rows.append((i, s, ends_inside(t), not _END.search(end[-40:]), end[-1:].isalnum(), len(raw), xxhash.xxh3_128_digest(raw), _hashes(raw)))
        yield batch_of(rows, _NARROW)


def _continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How a text goes on behind its first `size` bytes: in the same word, in the same line, or not surely so."""
    for b in batches:
        rows = []
        for t, sizes in zip(*(c.to_pylist() for c in b.columns)):
            text, starts = body(t)
            raw, lines = text.encode(), {len(text[:k].encode()) for k in starts}
            for n in sizes:
                if n < len(raw):
                    word = raw[n] != 32 and n > 0 and raw[n - 1] != 32
                    rows.append((n, xxhash.xxh3_128_digest(raw[:n]), word, not word and n + (raw[n] == 32) not in lines))
        yield batch_of(rows, "size int, whole binary, in_word boolean, in_line boolean")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast in a join if it is small; else both sides are shuffled. df must be cut."""
    return F.broadcast(df) if df.count() <= SMALL else df


def verdicts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, source, prefix, by_end): by which evidence each text is cut, if by any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    narrow = cut_lineage(rows.mapInArrow(_prepare, _NARROW))
    top = F.size("hashes") - 1
    each = narrow.select("doc_id", "size", F.posexplode("hashes").alias("level", "hash"), top.alias("top"), "open")
    # of each hash the sizes of texts that end before the next fixed length, if any text goes on behind them; open texts only, as the others end a sentence
    short = F.when((F.col("level") == F.col("top")) & F.col("open"), F.col("size"))
    asked = each.groupBy("level", "hash").agg(F.collect_set(short).alias("sizes"), F.max("size").alias("most"))
    asked = cut_lineage(asked.where("size(sizes) > 0 and most > array_min(sizes)").select("level", "hash", "sizes"))
    longer = each.join(_few(asked), ["level", "hash"]).select("doc_id", F.filter("sizes", lambda s: s < F.col("size")).alias("sizes")).where("size(sizes) > 0")
    longer = cut_lineage(longer.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("sizes"))).alias("sizes")))
    again = rows.where("doc_id is not null and text is not null").join(_few(longer), "doc_id").select("text", "sizes")
    answers = again.mapInArrow(_continuations, "size int, whole binary, in_word boolean, in_line boolean")
    answers = cut_lineage(answers.groupBy("size", "whole").agg(F.bool_or("in_word").alias("in_word"), F.bool_or("in_line").alias("in_line")))
    joined = narrow.join(_few(answers), ["size", "whole"], "left")
    prefix = F.col("open") & ((F.col("word") & F.col("in_word")) | F.col("in_line"))
    return joined.select("doc_id", "source", F.coalesce(prefix, F.lit(False)).alias("prefix"), "by_end")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id) of the texts that were cut."""
    return verdicts(docs).where("(prefix or by_end) and doc_id is not null").select("doc_id").distinct()


def shares(docs: DataFrame) -> DataFrame:
    """(source, texts, cut, share): how often each source cuts; texts without a source count under null."""
    cut = verdicts(docs).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("prefix") | F.col("by_end")).alias("cut"))
    return cut.select("source", "texts", "cut", F.round(F.col("cut") / F.col("texts"), 6).alias("share"))
