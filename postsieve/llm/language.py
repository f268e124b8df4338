"""Language of documents and of their stretches: averaged hashed subword embeddings under a linear softmax.

A word is the bag of its character pieces, each hashed to one of BUCKETS embeddings; a sentence is the average of the embeddings of its
words' pieces, and a linear softmax gives its language. The model is trained by stochastic gradient descent in numpy on
sentences of at most SAMPLE_ROWS rows, taken by the hash of their id and labelled by the declared language (labels are
noisy; after a first pass, sentences whose label the model contradicts firmly are left out). A temperature is fitted on held-out
sentences, and confidences below a threshold, also set there, are rejected: such a sentence has no language.

As the model is linear, a word adds fixed logits wherever it stands; each task keeps the logits of the words that it met.

Defined results: null, blank and wordless texts have no language and no stretches. Text garbled by a wrong encoding or disguised by
look-alike characters is read in its repaired form. Very long texts are read whole. Repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm import encoding
from postsieve.llm.canonical import canonical
from postsieve.llm.deliveries import first_deliveries

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
SAMPLE_ROWS = 4000
BUCKETS, DIM = 1 << 15, 12
#: Sentences of fewer words (names and titles not counted) are too short to tell, and a document is in a second language only
#: with a sentence of SECOND_WORDS words at a confidence of SECOND, and SECOND_TOTAL words in all.
LEAST_WORDS, SECOND_WORDS, SECOND_TOTAL, SECOND = 3, 5, 8, 0.93

#: Three-letter codes of the languages.
CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "rus": "ru"}
#: Codes that name no language.
NO_LANGUAGE = ("und", "xx", "xxx", "zxx", "mis", "mul", "qaa", "unk")

_HEADER = re.compile(r"^\s*(?:[>|]\s*)*(?:[*_]?(?:From|Von|De|Da|Van|От|Sent|To|Cc|Subject|Date|Gesendet|An|Betreff|Datum|Envoyé|À|A|Objet|Enviado(?: el| em)?|Para|Asunto|Assunto|Fecha|Data|Inviato|Oggetto|Verzonden|Aan|Onderwerp|Отправлено|Кому|Тема|Дата|Tel|Fax)\s?:|[-_=*]{3,}|.*\b(?:wrote|schrieb.*|a écrit|escribió|escreveu|ha scritto|schreef.*|пишет)\s?:\s*$|\s*(?:On|Am|Le|El|Em|Il|Op)\s.{0,40}\d{4}.{0,90}$)")
_LINK = re.compile(r"(?:https?://|www\.|mailto:)\S+|\S+@\S+")
_PREFIX = re.compile(r"^(?:\s*[>|])+\s?")
_SPLIT = re.compile(r"(?<=[.!?…:;])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")


def declared(c: Column) -> Column:
    """The two-letter code that a declared language names; null if it names none."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})*$", 1)
    three = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    return F.when((base != "") & ~base.isin(*NO_LANGUAGE), F.coalesce(F.try_element_at(three, base), base))


def _is_header(x: str) -> bool:
    if x[0] in "-_=*" or ":" in x[:24] or x[-1] == ":" or x[:3] in ("On ", "Am ", "Le ", "El ", "Em ", "Il ", "Op "):
        if _HEADER.match(x):
            return True
    return len(x) < 80 and ("@" in x or x.count("|") + x.count("/") - 2 * x.count("://") > 1)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of the text; header lines, bare codes and lines of contact data are left out."""
    out, held = [], []
    for x in text.split("\n"):
        x = x.strip()
        if x[:1] in (">", "|"):
            x = _PREFIX.sub("", x).strip()
        if not x or _is_header(x):
            if held:
                out.append(" ".join(held))
                held = []
        else:
            held.append(x)
            if x[-1] in ",-" and len(x) < 40 or len(x) < 30:  # greetings and broken-off lines stand alone
                out.append(" ".join(held))
                held = []
    if held:
        out.append(" ".join(held))
    return [w for p in out for s in _SPLIT.split(p) if (w := _plain_words(s))]


def _plain_words(sentence: str) -> list[str]:
    """Words of a sentence, without the capitalised ones inside it (names, titles); of a sentence in capitals, all."""
    if "@" in sentence or "://" in sentence or "www." in sentence:
        sentence = _LINK.sub(" ", sentence)
    words = _WORD.findall(sentence)
    low = [w for w in words if w[0].islower()]
    if 2 * len(low) < len(words):
        return words if len(words) > 5 and sum(w.isupper() for w in words) * 10 > 7 * len(words) else []
    return low


def pieces(word: str) -> list[int]:
    """Buckets of a word and of its character pieces of two to four letters."""
    w = f"<{word.lower()}>"
    parts = [w] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    out = []
    for p in parts:
        h = 2166136261
        for c in p.encode():
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        out.append((h ^ h >> 15) % BUCKETS)
    return out


@dataclass
class Model:
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def table(self) -> np.ndarray:
        """Logits that each bucket adds, BUCKETS x languages: all that reading needs."""
        return self.embeddings @ self.weights


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Reader:
    """Language probabilities of sentences, with the logits of words already met kept by word."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, temperature: float):
        self.table, self.bias, self.temperature = table, bias, temperature
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, table.shape[1] + 1))

    def _add(self, word: str) -> int:
        n = len(self.known)
        if n == len(self.rows):
            if n >= 1 << 18:  # a vocabulary without end: begin anew
                self.known.clear()
                n = 0
            else:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        p = pieces(word)
        self.rows[n, :-1] = self.table[p].sum(0)
        self.rows[n, -1] = len(p)
        self.known[word] = n
        return n

    def read(self, sents: list[list[str]]) -> np.ndarray:
        if not sents:
            return np.zeros((0, self.table.shape[1]))
        if len(self.known) > (1 << 18) - sum(map(len, sents)):
            self.known.clear()
        known, idx = self.known, []
        for s in sents:
            for w in s:
                i = known.get(w)
                idx.append(self._add(w) if i is None else i)
        starts = np.cumsum([0, *map(len, sents[:-1])])
        total = np.add.reduceat(self.rows[np.array(idx)], starts, axis=0)
        return _softmax((total[:, :-1] / total[:, -1:] + self.bias) / self.temperature)


def fit(texts: list[str], labels: list[str], epochs: int = 5, seed: int = 5) -> Model:
    """Fit on sentences of labelled texts. Without any labelled sentence the model rejects everything."""
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(LANGUAGES)}
    xs, ys = [], []
    for t, y in zip(texts, labels):
        for s in sentences(t)[:12]:
            if len(s) >= LEAST_WORDS:
                xs.append(s)
                ys.append(number[y])
    k = len(LANGUAGES)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, k)), np.zeros(k), 1.0, 1.1)
    if not xs:
        return model
    memo: dict[str, list[int]] = {}
    bags = []
    for s in xs:
        b: list[int] = []
        for w in s:
            if w not in memo:
                memo[w] = pieces(w)
            b += memo[w]
        bags.append(np.array(b))
    y = np.array(ys)
    # languages differ in how often they occur; take as many sentences of each as there are of the fifth largest, at most 1500
    # and twice as many of the most frequent
    per = min(1500, max(50, int(np.sort(np.bincount(y, minlength=k))[-min(k, 5)])))
    most = int(np.bincount(y, minlength=k).argmax())
    order = rng.permutation(len(y))
    kept = np.concatenate([order[y[order] == c][: per * (2 if c == most else 1)] for c in range(k)])
    kept = rng.permutation(kept)
    held, train = kept[: len(kept) // 6], kept[len(kept) // 6 :]
    emb, w, bias = model.embeddings, rng.normal(0, 0.1, (DIM, k)), np.zeros(k)

    def average(rows: np.ndarray) -> np.ndarray:
        flat = np.concatenate([bags[i] for i in rows])
        n = np.array([len(bags[i]) for i in rows])
        return np.add.reduceat(emb[flat], np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None], flat, n

    def run(rows: np.ndarray, passes: int, rate: float) -> None:
        nonlocal w, bias
        for e in range(passes):
            step = rate * (1 - e / (passes + 1))
            for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 32)):
                x, flat, n = average(part)
                g = _softmax(x @ w + bias)
                g[np.arange(len(part)), y[part]] -= 1
                gx = g @ w.T
                w = w - step * (x.T @ g) / len(part) * 4
                bias = bias - step * g.mean(0)
                np.add.at(emb, flat, -step * np.repeat(gx / n[:, None], n, axis=0) * 4)

    run(train, epochs, 1.5)
    p = _softmax(average(train)[0] @ w + bias)
    train = train[~((p.argmax(1) != y[train]) & (p.max(1) > 0.6))]  # firmly contradicted labels
    run(train, 2, 0.8)
    x = average(held)[0] @ w + bias
    p = _softmax(x)
    sure = ~((p.argmax(1) != y[held]) & (p.max(1) > 0.6))
    x, t = x[sure], y[held][sure]
    grid = np.geomspace(0.6, 3, 30)  # held-out sentences are like the others: never sharper than this
    loss = [-np.log(_softmax(x / a)[np.arange(len(t)), t] + 1e-12).mean() for a in grid] if len(t) else [0.0]
    model = Model(emb, w, bias, float(grid[int(np.argmin(loss))]) if len(t) else 1.0, 0.5)
    p = _softmax(x / model.temperature)
    wrong = p.max(1)[p.argmax(1) != t]
    model.threshold = float(min(0.95, max(0.6, wrong.max() if len(wrong) else 0.6)))
    return model


def _clean(text: str) -> str:
    return text if text.isascii() else canonical(encoding.repair(text)[0])


def train(df: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model from at most `rows` rows of df(id, message, lang) whose declared language is one of LANGUAGES."""
    labelled = df.select("id", "message", declared(F.col("lang")).alias("lang")).where(F.col("lang").isin(*LANGUAGES) & (F.length("message") > 40) & F.col("id").isNotNull())
    share = max(1, int(labelled.count() // (2 * rows)))  # thin by hash first, so that no task sends more than its part
    got = labelled.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(rows).collect()
    return fit([_clean(r["message"]) for r in got], [r["lang"] for r in got])


def stretches(text: str | None, reader: Reader, threshold: float) -> list[tuple[str, float, int]]:
    """(language, confidence, words) of the stretches of a text, in order; rejected sentences belong to none."""
    if not text:
        return []
    return _merge(s := sentences(_clean(text)), reader.read(s), threshold)


def _merge(sents: list[list[str]], p: np.ndarray, threshold: float) -> list[tuple[str, float, int]]:
    best, top = p.argmax(1), p.max(1)
    size = np.array([len(s) for s in sents])
    sure = (size >= LEAST_WORDS) & (top >= threshold)
    if not sure.any():
        sure = (size >= 2) & (top >= threshold)
        if not sure.any():
            return []
    main = int(np.bincount(best[sure], size[sure], len(LANGUAGES)).argmax())
    total = np.bincount(best[sure], size[sure], len(LANGUAGES))
    firm = {q for q in best[(size >= SECOND_WORDS) & (top >= max(SECOND, threshold))].tolist() if total[q] >= SECOND_TOTAL} | {main}
    out: list[list] = []
    for s, q, m, ok in zip(sents, best, top, sure):
        if not ok or q not in firm:
            continue
        if out and out[-1][0] == q:
            out[-1][1] += m * len(s)
            out[-1][2] += len(s)
        else:
            out.append([q, m * len(s), len(s)])
    return [(LANGUAGES[q], float(m / n), n) for q, m, n in out]


_SCHEMA = pa.schema([("id", pa.int64()), ("declared", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("stretches", pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())])))])


def detect(df: DataFrame, model: Model) -> DataFrame:
    """df(id, text[, declared]) -> (id, declared, lang, confidence, stretches): the language of most words, and every stretch of one language.

    lang is null and stretches empty where nothing is written in a language the model is sure of.
    """
    held = df.sparkSession.sparkContext.broadcast((model.table(), model.bias, model.temperature))  # BUCKETS x languages
    threshold = model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                ids, said, texts = (c.to_pylist() for c in b.slice(lo, 500).columns)
                sents = [sentences(_clean(t)) if t else [] for t in texts]
                p = reader.read([s for d in sents for s in d])
                at, rows = 0, []
                for i, x, d in zip(ids, said, sents):
                    got = _merge(d, p[at : at + len(d)], threshold)
                    at += len(d)
                    words: dict[str, list[float]] = {}
                    for lang, c, n in got:
                        w = words.setdefault(lang, [0, 0.0])
                        w[0] += n
                        w[1] += c * n
                    top = max(words, key=lambda k: (words[k][0], k)) if words else None
                    rows.append((i, x, top, words[top][1] / words[top][0] if top else None, [{"lang": a, "confidence": c, "words": n} for a, c, n in got]))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    declared_ = F.col("declared") if "declared" in df.columns else F.lit(None).cast("string")
    return df.select(F.col("id").cast("long"), declared_.alias("declared"), "text").mapInArrow(run, "id long, declared string, lang string, confidence double, stretches array<struct<lang:string,confidence:double,words:int>>")


def label_mail(mail: DataFrame) -> DataFrame:
    """(id, declared, lang, confidence, stretches) of every message with text, of the first delivery where several differ."""
    texts = first_deliveries(mail.where("message is not null and message <> '' and id is not null").select("id", "message", "lang", "loaded_at"), "id", "message", "lang")
    return detect(texts.select("id", F.col("message").alias("text"), declared(F.col("lang")).alias("declared")), train(mail)).dropDuplicates(["id"])


def found(mail: DataFrame) -> DataFrame:
    """(id, lang): the languages of messages whose declared language is absent or false, or which are in several."""
    m = label_mail(mail)
    langs = F.array_distinct(F.transform("stretches", lambda s: s["lang"]))
    case = F.col("declared").isNull() | (F.col("declared") != F.col("lang")) | (F.size(langs) > 1)
    return m.where(F.col("lang").isNotNull() & case).select("id", F.explode(langs).alias("lang"))
