"""Near-duplicate records by bottom-k sketches, at a threshold of Jaccard similarity. No pair is missed.

1. Each record becomes the set of hashed runs of w words. Equal sets form a class; only one record of each goes on.
2. One hash function orders all values, within their count level: values that boilerplate repeats have high levels and come last. The
   sketch of a set of n values is its bottom k in this order, with k = n - ceil(threshold * n) + 1, which is the least for which two
   sets of the threshold's similarity are sure to share a retained value.
3. Inverted lists of the retained values generate the overlap of every two sketches, each taken as far as the sizes of the two sets
   ask for. A list of a common value is split into blocks, so that no task holds it whole.
4. The union of two sketches, up to the end of the one that ends first, is known in full. The similarity is estimated from it with
   the most favourable rest: all that the sets have left beyond is common. Pairs that can't reach the threshold so are dropped; the
   estimate is never too low, so that no pair is lost.
5. Exact Jaccard similarity of the full sets verifies the others.

Defined results: records whose text is null or blank, or has fewer than w words, have an empty set and match nothing. Repeated rows
of an id count once; where their texts differ, the one delivered first counts (ties go by the text's hash). Equal texts are similar
with 1.0. Extra columns are ignored; an empty table gives an empty result. The result doesn't depend on the order of rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.deliveries import SMALL, first_deliveries
from postsieve.session import cut_lineage, drop_folder, shared_dir

_WORDS = re.compile(r"[^\W_]+")
_A, _B, _C, _M = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))


@dataclass(frozen=True)
class Settings:
    """words: length of a run. threshold: least similarity. bits: log2 of the greatest size of the count table; a smaller one
    serves while values are few. block: records in a block of a split list. part: postings that a task works on at once. extra: how
    many more values a sketch is read for than would find a pair, as a share of the common part it must have; each must then be shared."""

    words: int = 5
    threshold: float = 0.8
    bits: int = 24
    block: int = 512
    part: int = 500_000
    extra: float = 0.05


def hashed_words(text: str, known: dict[str, int]) -> np.ndarray:
    words = _WORDS.findall(text.lower())
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        v = known.get(w)
        if v is None:
            v = xxhash.xxh64_intdigest(w)
            if len(known) < 500_000:
                known[w] = v
        out[i] = v
    return out


def runs(words: np.ndarray, w: int) -> np.ndarray:
    """Sorted distinct 40-bit hashes of all runs of w words."""
    if len(words) < w:
        return np.empty(0, dtype=np.uint64)
    n = len(words) - w + 1
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(w):
            h = (h ^ (words[i : i + n] + _C)) * _A
            h ^= h >> np.uint64(29)
        h *= _M
        h ^= h >> np.uint64(32)
    return np.unique(h >> np.uint64(24))


def pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def mixed(values: np.ndarray) -> np.ndarray:
    """The one hash function that orders values within a level."""
    with np.errstate(over="ignore"):
        return (values * _A) ^ ((values * _C) >> np.uint64(17))


_SETS = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("print", pa.binary()), ("values", pa.binary())])


def _sets(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(*(c.to_pylist() for c in b.columns)):
                s = runs(hashed_words(text, known), settings.words) if text else ()
                if len(s):
                    raw = pack(s)
                    rows.append((i, len(s), xxhash.xxh128_digest(raw), raw))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SETS)], schema=_SETS)

    return run


def _bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(40 - bits)).astype(np.int64)


_CHUNK = 1 << 14


def _count(bits: int):
    """Counts of the buckets in a partition, as compressed rows (chunk, counts)."""
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        for b in batches:
            raw = b"".join(b.column("values").to_pylist())
            if raw:
                at, n = np.unique(_bucket(unpack(raw), bits), return_counts=True)
                total[at] += n.astype(np.uint32)
        parts = total.reshape(-1, min(_CHUNK, 1 << bits))
        keep = [i for i in range(len(parts)) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in keep], pa.binary())], schema=schema)

    return run


def _add_counts(bits: int):
    """The level of every bucket of a chunk, from its counts in all partitions; only levels go to the driver."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(min(_CHUNK, 1 << bits), dtype=np.uint64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), dtype=np.uint32)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([zlib.compress(levels(total, key[1].as_py()).tobytes(), 1)], pa.binary())})

    return run


def level_table(sets: DataFrame, bits: int, values: int) -> np.ndarray:
    """The count level of each bucket of values; 2**bits bytes, whatever the size of the data."""
    mean = max(1.0, values / (1 << bits))
    counted = sets.select("values").mapInArrow(_count(bits), "chunk int, counts binary").withColumn("mean", F.lit(mean))
    parts = counted.groupBy("chunk", "mean").applyInArrow(_add_counts(bits), "chunk int, levels binary").collect()
    width = min(_CHUNK, 1 << bits)
    out = np.zeros(1 << bits, dtype=np.int8)
    for r in parts:
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(r["levels"]), dtype=np.int8)
    return out


def _noise(mean: float) -> float:
    return 3 * np.sqrt(mean) + 1


def levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """Count level of every bucket: 0 as far as chance fills buckets, then one more for every doubling of what goes beyond."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(counts - mean, 1) / _noise(mean)))).astype(np.int8)


def parts_of(level: np.ndarray, mean: float, block: int) -> np.ndarray:
    """Into how many parts the list of a value of this level is split; at most 4,000, of larger blocks beyond."""
    return np.where(level > 1, np.clip(np.ceil(_noise(mean) * np.exp2(level.astype(np.float64)) / block), 1, 4000), 1).astype(np.int64)


# --- columns of numbers as one binary value: far smaller than rows of them ----------------------------------------------


def encode(cols: list[np.ndarray], kinds: list[str]) -> bytes:
    """Equally long columns, each split into the planes of its bytes, so that zeros lie together for the compression of the shuffle."""
    return b"".join(np.ascontiguousarray(c.astype(k).view(np.uint8).reshape(len(c), -1).T).tobytes() for c, k in zip(cols, kinds))


def decode(raw: bytes, kinds: list[str]) -> list[np.ndarray]:
    width = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(width), 0, []
    for k, w in zip(kinds, width):
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * w, offset=at).reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


_BLOBS = pa.schema([("part", pa.int32()), ("data", pa.binary())])


def _blobs(part: np.ndarray, cols: list[np.ndarray], kinds: list[str]) -> pa.RecordBatch:
    """Rows (part, columns of that part)."""
    order = np.argsort(part, kind="stable")
    part, cols = part[order], [c[order] for c in cols]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(part)]
    data = [encode([c[a:z] for c in cols], kinds) for a, z in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(data, pa.binary())], schema=_BLOBS)


def _by_part(batches: Iterator[pa.RecordBatch], kinds: list[str], squeeze=None, most: int = 4_000_000) -> Iterator[list[np.ndarray]]:
    """The columns of each part, from rows sorted by part; squeeze shortens what is held, whenever it exceeds `most`."""
    now, held, n = None, [], 0

    def whole() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held)] if len(held) > 1 else held[0]

    for b in batches:
        for part, raw in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
            if part != now and held:
                yield whole()
                held, n = [], 0
            now = part
            held.append(decode(raw, kinds))
            n += len(held[-1][0])
            if squeeze and n > most:
                held = [squeeze(whole())]
                n = len(held[0][0])
                most = max(most, 2 * n)
    if held:
        yield whole()


def _spread_over(x: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = x.astype(np.uint64) * _A
        h ^= h >> np.uint64(31)
        return ((h * _B) >> np.uint64(33)).astype(np.int64) % parts


#: value and block in one number, side, id, size of the set, how many of its values are left from this one on.
_POSTING = ["<u8", "u1", "<i8", "<u4", "<u4"]
#: Sides of a block: the two parts of a split list, or one list or part whose own pairs are wanted.
_LEFT, _RIGHT, _WHOLE = 0, 1, 2


def _postings(held, settings: Settings, mean: float, spread: int):
    """Retained values of every record, each with the size of the set and how many of its values are left from there on. The list of a value
    that is more common than a block holds is split into parts; a record in part p goes to the block of each pair of parts that holds p, and
    block p:p forms the pairs within p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column("id").to_numpy(), b.column("n").to_numpy().astype(np.int64)
            raw = b.column("values").to_pylist()
            v = unpack(b"".join(raw))
            many = np.array([len(x) // 5 for x in raw])
            row = np.repeat(np.arange(len(raw)), many)
            place = np.arange(len(v)) - np.repeat(np.cumsum(many) - many, many)
            i, size = ids[row], n[row]
            rest = size - place
            parts = parts_of(level[_bucket(v, settings.bits)], mean, settings.block)
            wide = np.flatnonzero(parts > 1)
            cols = [v, np.full(len(v), _WHOLE, dtype=np.uint8), i, size, rest]
            if len(wide):
                one = parts == 1
                cols = [c[one] for c in cols]
                s = parts[wide]
                p = _spread_over(i[wide], 1 << 30) % s
                at = np.repeat(np.arange(len(wide)), s)
                q = np.arange(len(at)) - np.repeat(np.cumsum(s) - s, s)
                p, s = p[at], s[at]
                # the block p:q is numbered within 23 bits: 4,000 parts have 8,002,000 pairs
                lo, hi = np.minimum(p, q), np.maximum(p, q)
                block = hi * (hi + 1) // 2 + lo
                more = [v[wide][at] | (block.astype(np.uint64) << np.uint64(40)), np.where(q == p, _WHOLE, np.where(q < p, _RIGHT, _LEFT)).astype(np.uint8), i[wide][at], size[wide][at], rest[wide][at]]
                cols = [np.concatenate([a, m]) for a, m in zip(cols, more)]
            for a in range(0, len(cols[0]), 8_000_000):
                some = [c[a : a + 8_000_000] for c in cols]
                yield _blobs(_spread_over(some[0], spread), some, _POSTING)

    return run


#: a < b, retained values that they share, and how many they must.
_OVERLAP = ["<i8", "<i8", "<u2", "<u2"]
_MOST = 65_535


def must_share(na: np.ndarray, nb: np.ndarray, threshold: float, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """(common, c) for sets of these sizes: common values that the threshold asks for, and how many of them must be among the first
    n - common + c values of both."""
    both = na.astype(np.int64) + nb
    common = np.ceil(threshold / (1 + threshold) * both - 1e-6).astype(np.int64)
    held = common - np.ceil(threshold * np.maximum(na, nb) - 1e-9).astype(np.int64) + 1  # as far as the sketches go
    return common, np.clip(np.minimum(1 + np.floor(extra * common).astype(np.int64), held), 1, _MOST)


def at_most(na: np.ndarray, nb: np.ndarray, o: np.ndarray, threshold: float, extra: float) -> np.ndarray:
    """The greatest similarity that the union of two sketches leaves open, with o values common to both: whichever sketch ends first
    shows all common values up to its end, and what its set has left beyond is common at most."""
    common, c = must_share(na, nb, threshold, extra)
    most = np.minimum(o + common - c, np.minimum(na, nb))
    return most / (na + nb - most)


def _summed(cols: list[np.ndarray]) -> list[np.ndarray]:
    """One row for each pair, its shared values added up."""
    order = np.lexsort((cols[1], cols[0]))
    a, b, o, c = (x[order] for x in cols)
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return [a[first], b[first], np.minimum(np.add.reduceat(o.astype(np.int64), first), _MOST).astype(np.uint16), c[first]]


def _lists(settings: Settings, spread: int):
    """Overlaps of pairs of records that share a retained value, from the postings of a part."""
    def pairs(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the two postings of every pair of every list."""
        key, side, n = cols[0], cols[1], cols[3]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        plain = (size > 1) & (size <= 256) & (side[starts] == _WHOLE)
        at = np.repeat(starts[plain], size[plain]) + np.arange(int(size[plain].sum())) - np.repeat(np.cumsum(size[plain]) - size[plain], size[plain])
        end = np.repeat((starts + size)[plain], size[plain])
        step = 1
        while len(at):  # the posting `step` places on, in all lists at once
            ok = at + step < end
            at, end = at[ok], end[ok]
            if len(at):
                yield at, at + step
            step += 1
        for a, m in zip(starts[(size > 1) & ~plain], size[(size > 1) & ~plain]):
            here = np.arange(a, a + m)
            here = here[np.argsort(n[here], kind="stable")]
            whole = side[a] == _WHOLE
            left, right = (here, here) if whole else (here[side[here] == _LEFT], here[side[here] == _RIGHT])
            for k, x in enumerate(left):  # only sets of a size that the threshold allows
                others = right[k + 1 :] if whole else right
                others = others[np.searchsorted(n[others], settings.threshold * n[x] - 1e-6) : np.searchsorted(n[others], n[x] / settings.threshold + 1e-6, "right")]
                if len(others):
                    yield np.full(len(others), x), others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _by_part(batches, _POSTING):
            order = np.argsort(cols[0], kind="stable")
            key, side, i, n, rest = cols = [c[order] for c in cols]
            got, held = [], 0
            for x, y in pairs(cols):
                common, c = must_share(n[x], n[y], settings.threshold, settings.extra)
                ok = (np.minimum(rest[x], rest[y]) > common - c) & (np.minimum(n[x], n[y]) >= settings.threshold * np.maximum(n[x], n[y]) - 1e-6) & (i[x] != i[y])
                x, y, c = i[x[ok]], i[y[ok]], c[ok]
                got.append([np.minimum(x, y), np.maximum(x, y), np.ones(len(x), dtype=np.uint16), c.astype(np.uint16)])
                held += len(x)
                if held > 1_000_000:
                    some = _summed([np.concatenate(g) for g in zip(*got)])
                    yield _blobs(_spread_over(some[0] ^ (some[1] << 20), spread), some, _OVERLAP)
                    got, held = [], 0
            if held:
                some = _summed([np.concatenate(g) for g in zip(*got)])
                yield _blobs(_spread_over(some[0] ^ (some[1] << 20), spread), some, _OVERLAP)

    return run


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose union sketch leaves the threshold open."""
    for cols in _by_part(batches, _OVERLAP, _summed):
        a, b, o, c = _summed(cols)
        ok = o >= c  # just then at_most() reaches the threshold
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _verify(settings: Settings):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = unpack(x), unpack(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                s = common / (len(x) + len(y) - common)
                if s >= settings.threshold:
                    rows.append((a, b, s))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _sketch(held, settings: Settings):
    """The bottom k of a record's values in the one order, in place of all."""
    schema = pa.schema([("id", pa.int64()), ("print", pa.binary()), ("n", pa.int32()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for b in batches:
            small = []
            for raw in b.column("values").to_pylist():
                v = unpack(raw)
                k = len(v) - int(np.ceil(settings.threshold * len(v) - 1e-9)) + 1
                small.append(pack(v[np.lexsort((mixed(v), level[_bucket(v, settings.bits)]))[:k]]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("print"), b.column("n"), pa.array(small, pa.binary())], schema=schema)

    return run


def similar(df: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """df(id, text, loaded_at) -> (links, members).

    links(a, b, similarity): representatives a < b of two classes whose sets have at least the similarity. members(id, rep): the
    class of every record with a set; rep is the least id of its records.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/neardup-{uuid.uuid4().hex}"
    rows = first_deliveries(df.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text", "loaded_at"), "id", "text")
    rows.select("id", "text").mapInArrow(_sets(settings), "id long, n int, print binary, values binary").write.parquet(f"{folder}/sets")  # read several times below
    sets = spark.read.parquet(f"{folder}/sets")
    members = sets.select("id", "print").distinct()
    members = members.join(members.groupBy("print").agg(F.min("id").alias("rep")), "print").select("id", "rep")
    values = int(sets.agg(F.sum("n")).first()[0] or 0)
    settings = replace(settings, bits=int(min(settings.bits, max(10, np.ceil(np.log2(max(1, values) / 12))))))
    mean = max(1.0, values / (1 << settings.bits))
    held = spark.sparkContext.broadcast(level_table(sets, settings.bits, values))  # 2**bits bytes
    sketches = sets.select("id", "print", "n", "values").mapInArrow(_sketch(held, settings), "id long, print binary, n int, values binary")
    reps = sketches.groupBy("print").agg(F.min(F.struct("id", "n", "values")).alias("m")).select("m.id", "m.n", "m.values")
    spread = int(min(1 << 20, max(1, -(-values * (1 - settings.threshold) // settings.part))))
    blobs, by_part = "part int, data binary", lambda d: d.repartition("part").sortWithinPartitions("part")
    posted = by_part(reps.mapInArrow(_postings(held, settings, mean, spread), blobs))
    shared = by_part(posted.mapInArrow(_lists(settings, min(1 << 20, 16 * spread)), blobs))
    likely = cut_lineage(shared.mapInArrow(_estimate, "a long, b long"))
    wanted = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    wanted = F.broadcast(wanted) if 2 * likely.count() <= SMALL else wanted  # else both sides are shuffled
    full = sets.select("id", "values").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    both = likely.join(full.select(F.col("id").alias("a"), F.col("values").alias("va")), "a").join(full.select(F.col("id").alias("b"), F.col("values").alias("vb")), "b")
    links = cut_lineage(both.select("a", "b", "va", "vb").mapInArrow(_verify(settings), "a long, b long, similarity double"))
    members = cut_lineage(members)
    held.destroy()
    drop_folder(spark, folder)
    return links, members


def _within(members: DataFrame, block: int = 1000) -> DataFrame:
    """(x, y) with x < y of each two members of a class. A large class is split into parts by the hash of its ids: every member meets each part
    under a key of its own."""
    large = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    some = members.join(large, "rep").select("rep", "id", "parts")
    left = some.select("rep", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    right = some.select("rep", F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("p"))
    return left.join(right, ["rep", "p"]).where("x < y").select("x", "y")


def pairs_of(df: DataFrame, settings: Settings) -> DataFrame:
    """(id_a, id_b) with id_a < id_b of all records, copies included, that are similar enough."""
    links, members = similar(df, settings)
    a, b = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(a, "a").join(b, "b").select("x", "y")
    return across.union(_within(members)).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups_of(df: DataFrame, settings: Settings, rounds: int | None = None) -> DataFrame:
    """(id, group_id, links): the group of every record with a set, named by its least id, and to how many other records it is similar.

    Groups are the components over class representatives: least ids spread along links and through shortcuts until
    nothing changes; an error tells if that takes more than `rounds`. Each round is cut by a checkpoint; nothing is gathered on the driver but one number.
    """
    links, members = similar(df, settings)
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))))
    label = cut_lineage(both.select(F.col("a").alias("v")).distinct().withColumn("g", F.col("v")))
    for done in count(1):
        near = both.join(label.select(F.col("v").alias("b"), "g"), "b").groupBy(F.col("a").alias("v")).agg(F.min("g").alias("m"))
        step = label.join(near, "v").select("v", F.least("g", "m").alias("g"), (F.col("m") < F.col("g")).alias("moved"))
        jump = step.join(step.select(F.col("v").alias("g"), F.col("g").alias("gg")), "g", "left").select("v", F.least("g", F.coalesce("gg", "g")).alias("g"), "moved")
        label = cut_lineage(jump)
        if not label.where("moved").limit(1).count():
            break
        if done == rounds:
            raise RuntimeError(f"groups still change after {rounds} rounds")
        label = label.select("v", "g")
    size = cut_lineage(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")))
    degree = both.join(size.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    named = members.join(label.select(F.col("v").alias("rep"), "g"), "rep", "left").join(degree, "rep", "left").join(size, "rep")
    return named.select("id", F.coalesce("g", "rep").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))


#: What TESTDATA.md states for mails: runs of three words, similarity 0.6.
MAIL = Settings(words=3, threshold=0.6)


def mail_text(mail: DataFrame) -> DataFrame:
    return mail.where("message is not null and message <> ''").select("id", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), "message").alias("text"), "loaded_at")


def found(mail: DataFrame) -> DataFrame:
    return pairs_of(mail_text(mail), MAIL)


def groups(mail: DataFrame) -> DataFrame:
    return groups_of(mail_text(mail), MAIL)


__all__ = ["MAIL", "Settings", "at_most", "found", "groups", "groups_of", "pairs_of", "similar"]
