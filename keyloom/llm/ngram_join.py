"""Near duplicates by an exact Jaccard join on word shingles with token-combination prefixes.

A text's set holds its distinct shingles of five words; texts link when their
sets' Jaccard likeness is at least 0.75. Texts with equal sets are one class,
named by a 64-bit hash of the set, and only classes are joined.

1. **Which shingles are shared.** The shingles of each slice of texts are sorted
   and dealt out by their leading bits, packed into binary rows. A shingle met in
   several classes of a slice goes out once, as a witness, and its classes are
   reported at once, so a shingle reaches its bucket once a slice at most, however
   many texts hold it. Each bucket reports the classes of shingles seen twice.
   A shingle of a single class can't be in any intersection.
2. **Prefixes.** The order of shingles is: unshared ones first, then by hash. Sets
   of sizes n and m that link have ``ceil(3 (n + m) / 7)`` shingles in common, so
   sizes are split into levels (steps of 1.1), a class is indexed apart for each
   level its partners may have, and for each needs a prefix of ``n - ceil(3 (n +
   least m) / 7) + 1`` shingles: a quarter of the set for the smallest partners, a
   seventh for its own size. Where its unshared shingles are as many, it has no
   partner there. Shared shingles that many prefixes hold are *frequent*; these
   are dealt into groups by a hash, as many as fit the sizes, and indexed as pairs
   within a group. With c members of a group in the prefix, all pairs failing to
   match means c - 1 or more members missing, so each group in use lengthens the
   prefix by one. Rare ones are indexed alone.
3. **Candidates and verification.** Classes that share an index entry are
   verified on their shared shingles, which hold the whole intersection. Before
   the index is built, the classes that have one of a few shingles meet one hub
   only (a star): the class with the least unshared shingles, which is what the
   original of a group of copies has. What links joins into components, and
   shingles that only one component has count as unshared from then on, so groups
   that are whole drop out. Then classes of one entry that are still in
   different components meet, all of them, so no component is missed. Entries of
   more than ``CROWD`` such classes are not written out as pairs: the classes that
   they hold together are dealt into blocks of ``BLOCK`` of about one size, and each
   pair of blocks of sizes that can link counts all its common shingles by a matrix
   product, and returns only links that join something. So a large group writes no
   more links than it has members; its classes are copied once for each block.

Shingles are compared by a 64-bit hash of their words. Two texts of 1,000 shingles
get a false common one with odds of 5e-14, which matters only to a pair that lies
a shingle below the threshold; nothing is lost by it. A class's members must agree
in a second, independent 64-bit hash of their sets; should two not, all is done
again with another seed.

Defined results: null and empty texts, and texts of separators only, have the
empty set and link with nothing; texts of fewer than five words have one shingle,
the whole sequence; rows that repeat an id are documents of that id; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import IS_SPACE, LOWER, buffers, mix, released, runs, slices, span_hashes
from .common import free_name, join_counted, mark, materialize, release, two_columns
from .components import components

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
SLICE = 1 << 21
#: Shingles that a bucket takes in, about; the number of buckets follows the corpus.
BUCKET_SHINGLES = 1_000_000
LEAST_BUCKETS = 256
#: Prefixes that hold a shingle before it counts as frequent.
FREQUENT = 24
#: Set size for each group of frequent shingles.
GROUP_SIZE = 16
#: Classes of an entry, not yet in one component, from which blocks take the place of pairs.
CROWD = 24
BLOCK = 512
#: Shared shingles of a class that look for a hub before the index is built.
FIRST = 8
#: Shingles that a block's matrix takes in at once.
BLOCK_COLUMNS = 4096

_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_CHECKS = mix(_FACTORS) | np.uint64(1)
#: Seeds that are tried before the job gives up.
SEEDS = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, seed: int = 0, check: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes, document of each, set size, set hash, second set hash if wanted): each document's distinct shingles, ascending."""
    data = LOWER[data]
    starts, ends, per_doc = runs(~IS_SPACE[data], offsets)
    n_docs = len(per_doc)
    words = span_hashes(data, starts, ends)
    if seed:
        words = mix(words + mix(np.full(1, seed, dtype=np.uint64)))
    firsts = np.cumsum(per_doc) - per_doc
    full = np.maximum(per_doc - WORDS + 1, 0)
    # one shingle for each start that has four more words after it in its document
    place = np.arange(len(words)) - np.repeat(firsts, per_doc)
    at = np.flatnonzero(place < np.repeat(full, per_doc))
    hashes, second = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at) if check else 0, dtype=np.uint64)
    for k in range(WORDS):
        hashes += words[at + k] * _FACTORS[k]
        if check:
            second += mix(words[at + k]) * _CHECKS[k]
    owner = np.repeat(np.arange(n_docs), full)
    # texts of one to four words: the whole sequence, marked by its length
    few = np.flatnonzero((per_doc > 0) & (full == 0))
    if len(few):
        whole, other = np.zeros(len(few), dtype=np.uint64), np.zeros(len(few), dtype=np.uint64)
        for k in range(WORDS - 1):
            has = per_doc[few] > k
            whole[has] += words[firsts[few[has]] + k] * _FACTORS[k]
            other[has] += mix(words[firsts[few[has]] + k]) * _CHECKS[k]
        whole = mix(whole + per_doc[few].astype(np.uint64))
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, few])
        second = np.concatenate([second, other]) if check else second
    hashes = mix(hashes)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16 if n_docs < 65536 else np.int64), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    second = mix(second[order][new]) if check else None
    hashes, owner = hashes[new], owner[new]
    sizes = np.bincount(owner, minlength=n_docs).astype(np.int64)
    filled = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[filled]

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n_docs, dtype=np.uint64)
        if len(filled):
            out[filled] = np.add.reduceat(values, begin)
        return mix(out + sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)

    return hashes, owner, sizes, sums(mix(hashes + np.uint64(0x9E3779B97F4A7C15))), sums(second) if check else None


def set_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n (set size), key (the class) and check (a second hash of the set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            found = [(np.zeros(0, np.int64),) * 3, *(shingle_sets(part, cuts, seed, check=True)[2:] for _, _, part, cuts in slices(data, offsets, SLICE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], names=["doc_id", "n", "key", "check"])

    return docs.mapInArrow(released(run), "doc_id long, n long, key long, check long")


def _blob(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unblob(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def shared_shingles(docs: DataFrame, bits: int, seed: int = 0) -> DataFrame:
    """(key, token): every class with each of its shingles that another class has too.

    A row may come more than once. ``bits``: log2 of the number of buckets, the
    leading bits of a shingle's hash, its token; a bucket's rows keep the other bytes.
    """
    shift, width = np.uint64(64 - bits), 8 - bits // 8

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, _, part, cuts in slices(data, offsets, SLICE):
                hashes, owner, _, keys, _ = shingle_sets(part, cuts, seed)
                if not len(hashes):
                    continue
                # a class stands once in a slice
                _, first = np.unique(keys, return_index=True)
                once = np.zeros(len(keys), dtype=bool)
                once[first] = True
                use = once[owner]
                tokens, owner = hashes[use], owner[use]
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                begins = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                counts = np.diff(np.append(begins, len(tokens)))
                several = np.repeat(counts > 1, counts)
                rows: list[tuple] = []
                if several.any():
                    k, t = keys[owner[several]], tokens[several]
                    for at in range(0, len(k), 1 << 16):
                        rows.append((int(mix(t[at : at + 1])[0] >> shift), 1, k[at : at + (1 << 16)].tobytes(), b"", _blob(t[at : at + (1 << 16)], 8)))
                # one entry for each token of the slice: its class, or 0 for a witness that it is shared
                tokens = tokens[begins]
                own = np.where(counts > 1, len(keys), owner[begins])
                names = np.append(keys, 0)
                buckets = (tokens >> shift).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
                for a, b in zip(edges, [*edges[1:], len(tokens)], strict=True):
                    order = np.argsort(own[a:b], kind="stable")
                    who, n = np.unique(own[a:b], return_counts=True)
                    rows.append((int(buckets[a]), 0, names[who].tobytes(), n.astype("<i4").tobytes(), _blob(tokens[a:b][order], width)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "names", "counts", "tokens"])

    def gather(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, tokens, ready_keys, ready_tokens = [], [], [], []
        for kind, names, counts, packed in zip(*(table.column(c).to_pylist() for c in ("kind", "names", "counts", "tokens")), strict=True):
            own = np.frombuffer(names, dtype=np.int64)
            if kind == 1:
                ready_keys.append(own)
                ready_tokens.append(_unblob(packed, 8))
            else:
                keys.append(np.repeat(own, np.frombuffer(counts, dtype="<i4")))
                tokens.append(_unblob(packed, width))
        if keys:
            key, token = np.concatenate(keys), np.concatenate(tokens)
            order = np.argsort(token, kind="stable")
            key, token = key[order], token[order]
            begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            counts = np.diff(np.append(begins, len(token)))
            # shared: two classes differ, or a witness says so
            shared = np.repeat((np.minimum.reduceat(key, begins) != np.maximum.reduceat(key, begins)) | (np.maximum.reduceat((key == 0).astype(np.int8), begins) > 0), counts) & (key != 0)
            ready_keys.append(key[shared])
            low = np.uint64((1 << (64 - bits)) - 1)
            ready_tokens.append(token[shared] & low | np.uint64(bucket) << shift)
        key, token = np.concatenate(ready_keys), np.concatenate(ready_tokens)
        return pa.table({"key": pa.array(key, pa.int64()), "token": pa.array(token.view(np.int64))})

    dealt = docs.select("text").mapInArrow(released(deal), "bucket int, kind int, names binary, counts binary, tokens binary")
    return dealt.groupBy("bucket").applyInArrow(gather, "key long, token long")


def required(n: int) -> int:
    """Prefix shingles that a set of n needs: one more than it can lack of a set it links with."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


#: Least size of each level; a level's sizes lie within a factor of 1.1.
_LEVELS = np.unique(np.ceil(1.1 ** np.arange(320) - 1e-9).astype(np.int64))


def size_level(n: int) -> int:
    return int(np.searchsorted(_LEVELS, n, side="right")) - 1


def partner_needs(n: int) -> list[tuple[int, int]]:
    """(level, prefix shingles needed) for each level that may hold a partner of a set of n."""
    least, most = -(-NUMERATOR * n // DENOMINATOR), DENOMINATOR * n // NUMERATOR
    out = []
    for level in range(size_level(least), size_level(most) + 1):
        partner = max(int(_LEVELS[level]), least)
        # equal to 3 / 7 of both sizes: the overlap that a likeness of 3 / 4 takes
        overlap = -(-NUMERATOR * (n + partner) // (NUMERATOR + DENOMINATOR))
        if overlap <= n:
            out.append((level, n - overlap + 1))
    return out


def index_entries(n: int, shared: np.ndarray, frequent: np.ndarray, n_shared: int) -> np.ndarray:
    """Index entries of a set of ``n`` with ``n_shared`` shared shingles, for all levels of partners.

    ``shared``: the shared shingles ascending, at least as far as a prefix reaches.
    """
    own, parts = size_level(n), [np.zeros(0, dtype=np.int64)]
    for level, needed in partner_needs(n):
        need = needed - (n - n_shared)
        if need <= 0:
            continue
        low, high = min(own, level), max(own, level)
        if not frequent[:need].any():
            parts.append(_entry(shared[:need], np.zeros(1, np.int64), low, high))
            continue
        groups = max(1, int(_LEVELS[high]) // GROUP_SIZE)
        slot = (mix(shared.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        members: dict[int, list[int]] = {}
        done, left, right = 0, [], []
        for token, often, g in zip(shared.tolist(), frequent.tolist(), slot.tolist(), strict=True):
            if done >= need:
                break
            if not often:
                left.append(token)
                right.append(0)
                done += 1
                continue
            held = members.setdefault(g, [])
            left += held
            right += [token] * len(held)
            done += bool(held)
            held.append(token)
        # only sets of one shingle end short of what they need, and those link with nothing but their own class
        parts.append(_entry(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), low, high))
    return np.concatenate(parts)


def _entry(left: np.ndarray, right: np.ndarray, low: int, high: int) -> np.ndarray:
    """A number for a shingle, or a pair of shingles, between two levels."""
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h ^ mix(np.full(1, low * 4096 + high + 1, dtype=np.uint64))).view(np.int64)


def _need(n, shared):
    """``required(n)`` less the unshared shingles, as columns."""
    return n - F.floor((NUMERATOR * n + DENOMINATOR - 1) / DENOMINATOR) + 1 - (n - shared)


def candidate_sets(docs: DataFrame, sets: DataFrame, seed: int = 0) -> DataFrame:
    """(key, n, tokens): the classes that could link, with their shared shingles ascending."""
    spark = docs.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_BUCKETS, math.ceil(total / BUCKET_SHINGLES)) - 1
    tokens = shared_shingles(docs, bits.bit_length(), seed).groupBy("key").agg(F.collect_set("token").alias("tokens"))
    classes = sets.where("n > 0").groupBy("key").agg(F.max("n").alias("n"))
    found = tokens.join(classes, "key").where(_need(F.col("n"), F.size("tokens")) > 0)
    return materialize(spark, found.select("key", "n", F.array_sort("tokens").alias("tokens")), "candidate-sets")


def index_table(candidates: DataFrame) -> DataFrame:
    """(entry, key, n, spare): the prefix index; ``spare``: unshared shingles in a thousand."""
    # as far as a prefix can reach: a group costs one more, and there are n / 12 at most
    reach = (_need(F.col("n"), F.size("tokens")) + F.floor(F.col("n") / 12) + 3).cast("int")
    rows = candidates.select("key", "n", F.explode(F.slice("tokens", F.lit(1), reach)).alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FREQUENT).select("token", "c", F.lit(True).alias("often"))
    often = materialize(candidates.sparkSession, often, "frequent-shingles")
    n_often = often.agg(F.sum("c")).first()[0] or 0
    marked = join_counted(rows, often, "token", "c", n_often, how="left").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("token", F.coalesce("often", F.lit(False)).alias("often")))).alias("prefix"))
    whole = marked.join(candidates.select("key", F.size("tokens").alias("shared")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, spares, entries = [], [], [], []
            for key, n, tokens, often, shared in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "tokens", "often", "shared")), strict=True):
                # the reach is a prefix of the shared shingles: the unshared ones are n - shared
                got = index_entries(n, np.array(tokens, dtype=np.int64), np.array(often, dtype=bool), shared)
                keys.append(np.full(len(got), key, dtype=np.int64))
                sizes.append(np.full(len(got), n, dtype=np.int64))
                spares.append(np.full(len(got), 1000 * (n - shared) // n, dtype=np.int64))
                entries.append(got)
            none = [np.zeros(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + x)) for x in (entries, keys, sizes, spares)], names=["entry", "key", "n", "spare"])

    shaped = whole.select("key", "n", F.col("prefix.token").alias("tokens"), F.col("prefix.often").alias("often"), "shared")
    return materialize(candidates.sparkSession, shaped.mapInArrow(run, "entry long, key long, n long, spare long"), "index")


def verify(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; all of an intersection lies in the shared shingles."""
    left = candidates.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = candidates.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    met = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")).cast("long"))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return met.where(100 * F.col("common") >= 75 * union).select("a", "b")


def _with_components(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("comp", F.col("key"))
    return entries.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("entry", "key", "n", "spare", F.coalesce("root", "key").alias("comp"))


def _mixed(entries: DataFrame, n_rows: int) -> DataFrame:
    """Rows of the entries whose classes are in several components."""
    several = entries.groupBy("entry").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("entry", "rows")
    return join_counted(entries, several, "entry", "rows", n_rows)


def star_pairs(entries: DataFrame, n_rows: int) -> DataFrame:
    """Each class with the one hub that it shares most entries with: (a, b).

    The hub of an entry is its class with the least unshared shingles; hubs of
    the class's own component don't count.
    """
    hubs = entries.groupBy("entry").agg(F.min(F.struct("spare", "key", "n", "comp")).alias("hub"), F.count(F.lit(1)).alias("rows"))
    # an entry of one class has no hub but itself
    met = join_counted(entries, hubs.where("rows > 1"), "entry", "rows", n_rows)
    met = met.where((F.col("hub.comp") != F.col("comp")) & (DENOMINATOR * F.least("n", "hub.n") >= NUMERATOR * F.greatest("n", "hub.n")))
    best = met.groupBy("key", F.col("hub.key").alias("hub")).count().groupBy("key").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    return best.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def all_pairs(entries: DataFrame) -> DataFrame:
    """Every pair of classes that share an entry, in different components and not of one zone: (a, b).

    Components of an entry are paired first, so classes of one component never
    meet each other, not even inside a join.
    """
    differ = (F.col("c_a") < F.col("c_b")) & ~F.coalesce(F.col("z_a") == F.col("z_b"), F.lit(False))
    spots = entries.select("entry", "comp", "zone").distinct()
    duos = spots.select("entry", F.col("comp").alias("c_a"), F.col("zone").alias("z_a")).join(spots.select("entry", F.col("comp").alias("c_b"), F.col("zone").alias("z_b")), "entry").where(differ)
    left = entries.select("entry", F.col("comp").alias("c_a"), F.col("zone").alias("w_a"), F.col("key").alias("k_a"), F.col("n").alias("n_a"))
    right = entries.select("entry", F.col("comp").alias("c_b"), F.col("zone").alias("w_b"), F.col("key").alias("k_b"), F.col("n").alias("n_b"))
    near = DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b")
    met = duos.join(left, ["entry", "c_a"]).where(F.col("z_a").eqNullSafe(F.col("w_a"))).join(right, ["entry", "c_b"]).where(F.col("z_b").eqNullSafe(F.col("w_b")) & near)
    return met.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b")).distinct()


def zones(entries: DataFrame, n_rows: int) -> DataFrame | None:
    """(key, zone): classes that crowded entries hold together, directly or by others; None without any."""
    crowded = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("v")).where(F.col("c") > CROWD)
    edges = join_counted(entries, crowded, "entry", "c", n_rows).select(F.col("key").alias("u"), "v").where("u <> v").distinct()
    edges = materialize(entries.sparkSession, edges, "crowds")
    if edges.isEmpty():
        return None
    found = components(edges, "zones")
    return found.select(F.col("node").alias("key"), F.col("root").alias("zone")).unionByName(found.select(F.col("root").alias("key"), F.col("root").alias("zone")).distinct())


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the left sets with the right ones."""
    sizes = [np.array([len(t) for t in side], dtype=np.int64) for side in (left, right)]
    flat = [np.concatenate([np.zeros(0, np.int64), *side]) for side in (left, right)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    spots = []
    for values, n in zip(flat, sizes, strict=True):
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        hit = both[at] == values if len(both) else np.zeros(len(values), dtype=bool)
        spots.append((np.repeat(np.arange(len(n)), n)[hit], at[hit]))
    for first in range(0, len(both), BLOCK_COLUMNS):
        parts = []
        for (rows, at), n in zip(spots, sizes, strict=True):
            inside = (at >= first) & (at < first + BLOCK_COLUMNS)
            part = np.zeros((len(n), min(BLOCK_COLUMNS, len(both) - first)), dtype=np.float32)
            part[rows[inside], at[inside] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _link_block(table: pa.Table) -> pa.Table:
    """Links of two blocks of classes that join components; no more than there are classes."""
    table = table.sort_by("key")
    part, low, high = (np.array(table.column(c)) for c in ("part", "low", "high"))
    keys, n, comp = (np.array(table.column(c)) for c in ("key", "n", "comp"))
    tokens = [np.array(t, dtype=np.int64) for t in table.column("tokens").to_pylist()]
    left, right = np.flatnonzero(part == low[0]), np.flatnonzero(part == high[0])
    common = common_counts([tokens[i] for i in left], [tokens[i] for i in right])
    union = n[left][:, None] + n[right][None, :] - common
    links = np.argwhere((100 * common >= 75 * union) & (comp[left][:, None] != comp[right][None, :]))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out: list[tuple[int, int]] = []
    for i, j in links.tolist():
        a, b = find(int(comp[left[i]])), find(int(comp[right[j]]))
        if a != b:
            parent[a] = b
            out.append((int(keys[left[i]]), int(keys[right[j]])))
    return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})


def block_links(entries: DataFrame, zoned: DataFrame, candidates: DataFrame) -> DataFrame:
    """(u, v): links between the components of each zone, enough to join what links."""
    # sizes that link lie within a factor of 4 / 3, three steps of 1.1 and a part
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(1.1)).cast("long")
    members = materialize(candidates.sparkSession, entries.select("key", "n", "comp").distinct().join(zoned, "key").withColumn("level", level), "zone-members")
    counts = members.groupBy("zone", "level").agg(F.count(F.lit(1)).alias("rows"))
    shape = F.collect_list(F.struct("level", F.ceil(F.col("rows") / BLOCK).cast("long").alias("parts")))
    shapes = counts.groupBy("zone").agg(shape.alias("shape"), F.sum("rows").alias("rows"))
    placed = join_counted(members, shapes, "zone", "rows", members.count())
    block = lambda level, part: level * F.lit(1 << 32) + part
    own = F.element_at(F.filter("shape", lambda x: x["level"] == F.col("level")), 1)["parts"]
    near = F.filter("shape", lambda x: F.abs(x["level"] - F.col("level")) <= 4)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda p: block(x["level"], p))))
    placed = placed.withColumns({"part": block(F.col("level"), F.pmod(F.xxhash64("key"), own)), "others": others}).select("zone", "key", "n", "comp", "part", F.explode("others").alias("other"))
    pairs = placed.select("zone", "key", "n", "comp", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    rows = pairs.join(candidates.select("key", "tokens"), "key")
    return rows.groupBy("zone", "low", "high").applyInArrow(_link_block, "u long, v long")


def narrowed(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """The candidates that could still link outside their component, with the shingles that other components have.

    Classes that link across components have only such shingles in common, so
    the others go before them in the order, as unshared ones do.
    """
    spark = candidates.sparkSession
    comps = candidates.select("key", "n", "tokens").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("comp", F.coalesce("root", "key"))
    rows = comps.select("key", "n", "comp", F.explode("tokens").alias("token"))
    foreign = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("token", "rows")
    n_rows = candidates.agg(F.sum(F.size("tokens"))).first()[0] or 0
    found = join_counted(rows, foreign, "token", "rows", n_rows).groupBy("key", "n").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return materialize(spark, found.where(_need(F.col("n"), F.size("tokens")) > 0).select("key", "n", "tokens"), "narrowed-sets")


def first_links(candidates: DataFrame) -> DataFrame:
    """(u, v): links of each class to one hub, by its first shared shingles alone; most groups of near copies join by these."""
    spare = (1000 * (F.col("n") - F.size("tokens")) / F.col("n")).cast("long")
    entries = candidates.select(F.explode(F.slice("tokens", 1, FIRST)).alias("entry"), "key", "n", spare.alias("spare"), F.col("key").alias("comp"))
    return verify(star_pairs(entries, FIRST * candidates.count()), candidates).select(F.col("a").alias("u"), F.col("b").alias("v"))


def link_components(docs: DataFrame, sets: DataFrame, seed: int = 0) -> DataFrame | None:
    """(node, root) of the classes that link with another; None if none does."""
    spark = docs.sparkSession
    candidates = candidate_sets(docs, sets, seed)
    links: DataFrame | None = None
    roots: DataFrame | None = None
    found = materialize(spark, first_links(candidates), "links")
    if not found.isEmpty():
        links, roots = found, components(found)
        candidates = narrowed(candidates, roots)
    entries = index_table(candidates)
    # an entry of a single component is no candidate
    rest = materialize(spark, _mixed(_with_components(entries, roots), entries.count()), "open-entries")
    if not rest.isEmpty():
        parts = [] if links is None else [links]
        zoned = zones(rest, rest.count())
        if zoned is not None:
            parts.append(materialize(spark, block_links(rest, zoned, candidates), "links"))
        found = verify(all_pairs(_with_zones(rest, zoned)), candidates).select(F.col("a").alias("u"), F.col("b").alias("v"))
        parts.append(materialize(spark, found, "links"))
        links = reduce(DataFrame.unionByName, parts)
        roots = None if links.isEmpty() else components(links)
    return roots


def _with_zones(entries: DataFrame, zoned: DataFrame | None) -> DataFrame:
    """With each class's zone, if any, and without the entries of a single zone."""
    if zoned is None:
        return entries.withColumn("zone", F.lit(None).cast("long"))
    marked = materialize(entries.sparkSession, entries.join(zoned, "key", "left"), "zoned-entries")
    settled = marked.groupBy("entry").agg(F.min("zone").alias("lo"), F.max("zone").alias("hi"), F.count("zone").alias("in_zone"), F.count(F.lit(1)).alias("c")).where("lo = hi and in_zone = c").select("entry")
    return marked.join(settled, "entry", "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    docs = two_columns(docs, id_col, text_col)
    since = mark(spark)
    for seed in range(SEEDS):
        sets = materialize(spark, set_table(docs, seed), "sets")
        firsts = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        firsts = materialize(spark, firsts, "classes")
        if firsts.where("lo <> hi").isEmpty():
            break
    else:
        raise ArithmeticError(f"hashes of sets collide with {SEEDS} seeds")
    roots = link_components(docs, sets, seed)
    firsts = firsts.drop("lo", "hi")
    if roots is not None:
        named = firsts.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        # a component's first document: of its classes, not of its documents
        least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("classes"))
        named = join_counted(named, least, "root", "classes", named.count())
    else:
        named = firsts.withColumn("component_id", F.col("first"))
    named = materialize(spark, named.select("key", "component_id", "copies"), "class-components")
    release(spark, since, keep=[sets, named])
    some = join_counted(sets.where("n > 0"), named, "key", "copies", sets.count())
    alone = sets.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return some.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all their columns.

    The document that stays has the smallest id of its component; rows with a
    null id stay, and so do all rows that repeat the id that stays.
    """
    own = free_name(docs, "_keyloom_stay")
    stay = near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(stay, docs["doc_id"] == F.col(own), "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
