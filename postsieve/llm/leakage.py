"""Evaluation passages that occur in documents, wholly or in part, literally or with some words changed.

A document holds an item if a run of `run` consecutive words of the item is in it with at most `errors` words changed, dropped or
added. By the pigeonhole principle a run split into errors + 1 pieces then has a piece that is exact, so the word n-grams of all items, of the
length of the shortest piece, are looked up in each document, and every hit is verified with Myers' bit-parallel edit
distance over words. Case, punctuation, line breaks, hyphens at line ends and page headers don't count.

Items are sent to the tasks as one index of hashed words, made once. Their number is checked: beyond ITEM_WORDS words they are taken in
blocks, one pass over the documents for each. An n-gram that many items share is expanded in numpy, and items with too few hits to hold a run are
dropped before any is verified.

Defined results: null and blank texts match nothing, nor do items of fewer than `run` words. Repeated rows give one pair. Very long
texts are read whole. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.arrow import batch_of
from postsieve.llm.truncated import PAGE_HEAD

#: Words of items sent to the tasks at once; about 24 bytes each.
ITEM_WORDS = 2_000_000
RUN, ERRORS = 20, 2

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\xad‐][ \t]*\n\s*(?=[^\W\d_])")
_OUT = re.compile(r"[^\w\s]|_")
_GAP = re.compile(r"[–—/]")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Paragraph numbers at the head of a line.
_PARAGRAPH = re.compile(r"^[ \t]*(?:§[ \t]*\d+|\[\d+\]|\(\d+\)|\d+\.(?=[ \t])|\d+\t|Rn\.?[ \t]*\d+)[ \t]*", re.M)


def words_of(text: str) -> list[str]:
    if "\n" in text:
        if PAGE_HEAD.search(text):
            text = PAGE_HEAD.sub("", text)
        text = _HYPHEN.sub("", text)
        text = _PARAGRAPH.sub("", text)
    return _OUT.sub("", _GAP.sub(" ", text)).lower().split()


class Words:
    """Hashes of words, kept while there are not too many."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, words = self.known, words_of(text)
        out = []
        for w in words:
            v = known.get(w)
            if v is None:
                v = xxhash.xxh64_intdigest(w)
                if len(known) < 500_000:
                    known[w] = v
            out.append(v)
        return np.array(out, dtype=np.uint64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    size = max(0, len(words) - n + 1)
    h = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ words[i : i + size]) * _A
            h ^= h >> np.uint64(32)
            h *= _B
    return h


def myers(pattern: list[int], text: list[int], most: int) -> bool:
    """Whether the pattern occurs somewhere in the text with at most `most` edits: Myers' bit-parallel search over words."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask  # a match may begin anywhere in the text
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score <= most:
            return True
    return False


def holds(item: list[int], doc: list[int], q: int, p: int, piece: int, run: int, errors: int) -> bool:
    """Whether a run of the item around its words q..q+piece occurs in the document around p, within the error budget."""
    for s in range(max(0, q + piece - run), min(q, len(item) - run) + 1):
        lo = max(0, p - (q - s) - errors)
        if myers(item[s : s + run], doc[lo : p + (s + run - q) + errors], errors):
            return True
    return False


@dataclass
class Index:
    """The items' n-grams, sorted, with the item and place of each, as plain arrays: made once, on the driver, and read by all tasks."""

    run: int
    errors: int
    ids: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    key: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @property
    def piece(self) -> int:
        return self.run // (self.errors + 1)

    @classmethod
    def of(cls, ids: list[int], words: list[np.ndarray], run: int = RUN, errors: int = ERRORS) -> Index:
        n, keep = run // (errors + 1), [(i, w) for i, w in zip(ids, words) if len(w) >= run]
        g = [grams(w, n) for _, w in keep]
        none = np.zeros(0, dtype=np.uint64)
        key = np.concatenate(g) if g else none
        item = np.repeat(np.arange(len(keep), dtype=np.int32), [len(x) for x in g]) if g else none.astype(np.int32)
        place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in g]) if g else none.astype(np.int32)
        order = np.argsort(key, kind="stable")
        starts = np.cumsum([0, *(len(w) for _, w in keep)])
        return cls(run, errors, np.array([i for i, _ in keep], dtype=np.int64), np.concatenate([w for _, w in keep]) if keep else none, starts, key[order], item[order], place[order])

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the item and place in the document of every n-gram that both hold, of the items that hold enough of them: `errors` edits
        spoil at most errors * piece of the run - piece + 1 n-grams of a run. Frequent n-grams are expanded in numpy, in slices of bounded size."""
        g = grams(doc, self.piece)
        lo, hi = np.searchsorted(self.key, g), np.searchsorted(self.key, g, "right")
        at = np.flatnonzero(hi > lo)
        if not len(at):
            return (np.zeros(0, dtype=np.int64),) * 3
        lo, many = lo[at], hi[at] - lo[at]
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // 4_000_000)) + 1
        total = np.zeros(len(self.ids), dtype=np.int64)
        parts = list(zip(np.split(at, cuts), np.split(lo, cuts), np.split(many, cuts)))

        def expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

        for _, first, n in parts:
            total += np.bincount(self.item[expand(first, n)], minlength=len(total))
        enough = total >= max(1, self.run - self.piece + 1 - self.errors * self.piece)
        out = []
        for where, first, n in parts:
            k = expand(first, n)
            ok = enough[self.item[k]]
            out.append((self.item[k][ok], self.place[k][ok], np.repeat(where, n)[ok]))
        item, place, pos = (np.concatenate(x).astype(np.int64) for x in zip(*out))
        return item, place, pos

    def matches(self, doc: np.ndarray) -> list[int]:
        """Ids of the items that the document holds."""
        if len(doc) < self.run - self.errors or not len(self.key):
            return []
        item, place, pos = self.hits(doc)
        got: list[int] = []
        words = None
        order = np.lexsort((place, pos - place, item))
        item, place, pos = item[order], place[order], pos[order]
        cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]).tolist() + [len(item)] if len(item) else []
        for a, z in zip(cuts, cuts[1:]):
            i = int(item[a])
            own = self.words[self.starts[i] : self.starts[i + 1]].tolist()
            words = doc.tolist() if words is None else words
            tried: dict[int, int] = {}
            for q, p in zip(place[a:z].tolist(), pos[a:z].tolist()):
                # the next place on a diagonal that failed: only a run that reaches further can be new
                if tried.get(p - q, -9) == p - 1 and q + self.run > len(own):
                    tried[p - q] = p
                    continue
                tried[p - q] = p
                if holds(own, words, q, p, self.piece, self.run, self.errors):
                    got.append(int(self.ids[i]))
                    break
        return got


def leaked(docs: DataFrame, items: DataFrame, run: int = RUN, errors: int = ERRORS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id): which document holds which item."""
    spark = docs.sparkSession
    usable = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("n", F.size(F.split("text", r"\s+")))
    usable = usable.dropDuplicates(["item_id", "text"])
    sizes = usable.groupBy("item_id").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    blocks = max(1, -(-int(sizes["total"] or 0) // ITEM_WORDS))
    part_of = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while blocks > 1:  # no block may hold more than twice ITEM_WORDS, or one item
        most = usable.groupBy(part_of(blocks).alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if most <= max(2 * ITEM_WORDS, sizes["most"]) or blocks > 10_000:
            break
        blocks *= 2
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")

    def one(block: int) -> DataFrame:
        part = usable if blocks == 1 else usable.where(part_of(blocks) == block)
        read = Words()
        rows = [(r["item_id"], read(r["text"])) for r in part.select("item_id", "text").collect()]
        held = spark.sparkContext.broadcast(Index.of([i for i, _ in rows], [w for _, w in rows], run, errors))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, own = held.value, Words()
            for b in batches:
                out = []
                for i, t in zip(*(c.to_pylist() for c in b.columns)):
                    out += [(i, m) for m in index.matches(own(t))]
                yield batch_of(out, "doc_id long, item_id long")

        return texts.mapInArrow(search, "doc_id long, item_id long")

    return reduce(DataFrame.union, map(one, range(blocks))).distinct()


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaked(docs, items)
