"""Documents of varying length packed into containers of fixed capacity, by the linear grouping scheme.

Sizes are counted in tokens of a public tokenizer. A document larger than the container is cut into full containers and a remainder, no other is
split. The lengths above a share of the capacity are sorted and cut into groups of equal cardinality, and each is rounded up to the largest
of its group; over these few sizes the configurations of a container are optimised by column generation on the linear programme, the
whole part of its solution is built, the actual documents take the places of the rounded ones (containers that they leave too
empty are dissolved), the rest is grouped and solved anew while it is large, and what is left and all small documents go where they fit
best, the longest first.

Documents are dealt to shards of about SHARD by the hash of their id; shards are packed independently, so that no task holds more, at
the cost of one badly filled container or two per shard.

Defined results: null and empty texts have no tokens and get no container. A repeated doc_id is packed once. Ties go by doc_id. A
capacity that is null or below 1 is left out. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm.arrow import batch_of
from postsieve.session import cut_lineage

#: Documents packed together.
SHARD = 20_000
#: Items above capacity / n are large, for each n of LARGE in turn; they are rounded in GROUPS groups.
LARGE, GROUPS = (12, 3), 40
#: Most kinds of containers that are packed for at once.
KINDS = 1000
#: A container that its actual documents fill less is dissolved; they go where they fit best.
KEEP = 0.998


def tokenizer_path() -> str:
    """File of the tokenizer's ranks: POSTSIEVE_TOKENIZER, or the byte-level BPE of the installed public tokenizers."""
    return os.environ.get("POSTSIEVE_TOKENIZER") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


_encodings: dict[str, object] = {}

#: Fixed value: the split pattern that goes with byte-level BPE ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(raw: bytes):
    """The tokenizer of a file of ranks, made once in each process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encodings[key] = tiktoken.Encoding("postsieve", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, tokens)."""
    with open(path or tokenizer_path(), "rb") as f:  # a vocabulary of fixed size; the driver's file goes to the tasks, which need none
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(held.value).encode_ordinary
        for b in batches:
            yield batch_of([(i, len(encode(t))) for i, t in zip(*(c.to_pylist() for c in b.columns))], "doc_id long, tokens int")

    some = docs.where("doc_id is not null and text is not null and text <> ''")
    return some.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tokens int")


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack, filled by dynamic programming in slices."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int16)
    for k, (s, v) in enumerate(zip(sizes.tolist(), worth.tolist())):
        if v <= 1e-12:
            continue
        for t in range(s, capacity + 1, s):
            end = min(t + s, capacity + 1)
            new = best[t - s : end - s] + v
            better = new > best[t:end] + 1e-12
            if better.any():
                best[t:end] = np.where(better, new, best[t:end])
                choice[t:end] = np.where(better, k, choice[t:end])
    at, count = int(best.argmax()), np.zeros(len(sizes), dtype=np.int64)
    value = float(best[at])
    while at > 0 and choice[at] >= 0:
        count[choice[at]] += 1
        at -= int(sizes[choice[at]])
    return value, count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """Basic solution of the programme `fewest containers that cover the demand`: (how often, how many of each size)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    while True:  # ends: every column is better than all before it, and there are finitely many
        dual = inverse.sum(0)
        value, column = best_configuration(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        x, step = inverse @ demand, inverse @ column
        ratio = np.full(k, np.inf)
        ratio[step > 1e-9] = np.maximum(x[step > 1e-9], 0) / step[step > 1e-9]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
    x = inverse @ demand
    return [(max(0.0, float(n)), basis[:, j].astype(np.int64)) for j, n in enumerate(x)]


class _Lengths:
    """Unplaced items by length; finds the longest that is not above a bound."""

    def __init__(self, lengths: np.ndarray, items: np.ndarray):
        self.by_length: dict[int, list[int]] = {}
        for i in items[::-1].tolist():
            self.by_length.setdefault(int(lengths[i]), []).append(i)
        self.mask = sum(1 << n for n in self.by_length)

    def put(self, i: int, n: int) -> None:
        self.by_length.setdefault(n, []).append(i)
        self.mask |= 1 << n

    def take(self, most: int) -> tuple[int, int] | None:
        below = self.mask & ((1 << (most + 1)) - 1)
        if not below:
            return None
        n = below.bit_length() - 1
        items = self.by_length[n]
        i = items.pop()
        if not items:
            self.mask &= ~(1 << n)
        return i, n


class _Rooms:
    """Containers by free room; finds the fullest that still has enough."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, container: int, room: int) -> None:
        self.by_room[room].append(container)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        left = self.mask >> size
        if not left:
            return None
        room = size + (left & -left).bit_length() - 1
        container = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return container, room


def _best_fit(lengths: np.ndarray, items: np.ndarray, where: np.ndarray, rooms: _Rooms, used: int) -> int:
    """Put items, in their order, where they fit best; the number of containers then."""
    for i in items.tolist():
        size = int(lengths[i])
        got = rooms.take(size)
        if got is None:
            got, used = (used, rooms.capacity), used + 1
        where[i] = got[0]
        rooms.add(got[0], got[1] - size)
    return used


def _by_configurations(lengths: np.ndarray, large: np.ndarray, capacity: int, where: np.ndarray, rooms: _Rooms) -> int:
    """Containers built from optimal configurations of rounded sizes; what the whole part of a solution leaves is grouped and solved anew, until little is left."""
    used = 0
    while len(large) > 2 * GROUPS:
        merged: dict[int, list[int]] = {}  # equal rounded sizes are one size
        for g in np.array_split(large, GROUPS):
            merged.setdefault(int(lengths[g[0]]), []).extend(g.tolist())
        sizes = np.array(list(merged), dtype=np.int64)
        demand = np.array([len(q) for q in merged.values()], dtype=float)
        left, before = _Lengths(lengths, large), used
        for times, column in sorted(configurations(sizes, demand, capacity), key=lambda x: -int((x[1] * sizes).sum())):
            places = sorted((s for s, c in zip(sizes.tolist(), column.tolist()) for _ in range(c)), reverse=True)
            for _ in range(int(times + 1e-9)):
                room, inside = capacity, []
                for k, s in enumerate(places):
                    # the actual document for a rounded place; the last may use all the room that rounding left
                    got = left.take(min(s, room) if k + 1 < len(places) else room)
                    if got is None:
                        break
                    inside.append(got)
                    room -= got[1]
                if room <= (1 - KEEP) * capacity:
                    where[[i for i, _ in inside]] = used
                    rooms.add(used, room)
                    used += 1
                else:
                    for i, n in inside:
                        left.put(i, n)
        if used == before:
            break
        large = large[where[large] < 0]
    return used


def pack(lengths: np.ndarray, capacity: int, shares: list | None = None) -> np.ndarray:
    """Container number of every item; lengths are 1..capacity. Numbers run from 0 without gaps.

    The scheme is kept where it needs no more containers than best fit alone, which decides the few cases where rounding costs one or two.
    shares: is given (containers, of these by configurations, containers by best fit alone).
    """
    order = np.argsort(-lengths, kind="stable")
    plain = np.full(len(lengths), -1, dtype=np.int64)
    alone = _best_fit(lengths, order, plain, _Rooms(capacity), 0)
    best, fewest, by = plain, alone, 0
    for n in LARGE:
        where, rooms = np.full(len(lengths), -1, dtype=np.int64), _Rooms(capacity)
        built = _by_configurations(lengths, order[lengths[order] > capacity // n], capacity, where, rooms)
        used = _best_fit(lengths, order[where[order] < 0], where, rooms, built)
        if built and (used, -built) < (fewest, -by):
            best, fewest, by = where, used, built
    if shares is not None:
        shares.append((fewest, by, alone))
    return best


_PACKED = "container string, shard int, doc_id long, piece int, local long, tokens int, built int, alone int"


def _pack_shard(t: pa.Table) -> pa.Table:
    capacity = int(t.column("capacity")[0].as_py())
    ids, tokens = (np.array(t.column(c).to_pylist(), dtype=np.int64) for c in ("doc_id", "tokens"))
    order = np.argsort(ids, kind="stable")
    ids, tokens = ids[order], tokens[order]
    full = np.where(tokens > capacity, tokens // capacity, 0)
    rest = tokens - full * capacity
    item = np.flatnonzero(rest > 0)
    shares: list[tuple[int, int, int]] = []
    where = pack(rest[item], capacity, shares)
    _, built, alone = shares[0]
    used = int(where.max()) + 1 if len(where) else 0
    whole = np.repeat(np.arange(len(ids)), full)
    piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    n = len(whole) + len(item)
    return pa.table({
        "container": pa.array([t.column("container")[0].as_py()] * n, pa.string()), "shard": pa.array(np.full(n, t.column("shard")[0].as_py()), pa.int32()),
        "doc_id": pa.array(np.concatenate([ids[whole], ids[item]])), "piece": pa.array(np.concatenate([piece, full[item]]).astype(np.int32)),
        "local": pa.array(np.concatenate([used + np.arange(len(whole)), where]).astype(np.int64)), "tokens": pa.array(np.concatenate([np.full(len(whole), capacity), rest[item]]).astype(np.int32)),
        "built": pa.array(np.full(n, built, dtype=np.int32)), "alone": pa.array(np.full(n, alone + len(whole), dtype=np.int32)),
    })


def _packed(docs: DataFrame, capacities: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The packed pieces, and for each container kind and shard how many containers are used, built by configurations, and needed by best fit alone."""
    kinds = capacities.where("capacity_tokens > 0 and container is not null").groupBy("container").agg(F.max("capacity_tokens").alias("capacity")).limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    each = F.array(*(F.struct(F.lit(r["container"]).alias("container"), F.lit(int(r["capacity"])).alias("capacity")) for r in kinds)) if kinds else F.array().cast("array<struct<container:string,capacity:int>>")
    shards = max(1, -(-docs.count() // SHARD))
    sized = token_counts(docs, path).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")
    dealt = sized.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(each).alias("kind")).select("doc_id", "tokens", "shard", "kind.container", "kind.capacity")
    dealt = dealt.repartition(int(min(10_000, max(1, 2 * shards * len(kinds)))), "container", "shard")  # as many tasks as there are shards to pack, however few bytes they are
    done = cut_lineage(dealt.groupBy("container", "shard").applyInArrow(_pack_shard, _PACKED))
    sizes = done.groupBy("container", "shard").agg((F.max("local") + 1).alias("used"), F.max("built").alias("built"), F.max("alone").alias("alone"))
    before = F.sum("used").over(Window.partitionBy("container").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("container", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    return done.join(offsets, ["container", "shard"]).select("container", "doc_id", "piece", (F.col("offset") + F.col("local")).alias("container_no"), "tokens"), sizes


def packed(docs: DataFrame, capacities: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text), capacities(container, capacity_tokens) -> (container, doc_id, piece, container_no, tokens).

    Piece 0 is the whole document unless it was split. Containers of a kind are numbered from 0 without gaps.
    """
    return _packed(docs, capacities, path)[0]


def fill(docs: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container, containers, tokens, least, best_fit, configured, filled): how many containers are used, the fewest that the tokens could fill, how many best fit
    alone would use, the share that configurations built, and the share that is filled."""
    kinds = capacities.groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    pieces, sizes = _packed(docs, capacities)
    per = pieces.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    used = sizes.groupBy("container").agg(F.sum("used").alias("containers"), F.sum("alone").alias("best_fit"), F.sum("built").alias("built"))
    return per.join(used, "container").join(kinds, "container").select(
        "container", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "best_fit", F.round(F.col("built") / F.col("containers"), 4).alias("configured"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled")
    )
