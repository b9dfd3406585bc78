"""Exact similarity self-join of word-shingle sets (problems 4 and 6).

Texts become sets of 64-bit shingle hashes. Equal sets form one class, known by a 64-bit signature, and only classes
take part in what follows, so copies never multiply work. Candidates come from tiles: every class posts the rarest
shingles of its set (for similarity t a set of n shingles posts n - ceil(t n) + 1, and two similar sets must meet in one
of them), so a tile holds the classes that share one rare shingle, in order of size. A posting that skips p rarer
shingles can't share more than n - p, so it only meets a band of sizes, from t n up to what n - p allows; inside the band
the bits of hashed bitmaps bound the overlap from above, and what is left is settled by an exact intersection of the
sorted arrays. Nothing is sampled, capped or dropped: every bound is safe.

A tile with too many pairs inside its bands is hot and is split by a further shared shingle, again and again: the rest of
each set is put in the order of how often its shingles occur inside that tile, so what all its members share comes last
and isn't posted. Tiles that would not fit a task are split before anything is sent to them. What is still hot after
``LEVELS`` shingles is compared in blocks, each a task of bounded size.

Sets are cheap to make (a few microseconds a text) and large to keep, so they are made anew from the texts in each of the
passes, and only signatures are written down. Postings travel packed by bucket of tiles, built as Arrow columns without a
step per bucket. Rarity is ordered by count sketches of fixed size; any order is exact, a better one is only faster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm import blocks
from veriscope.llm.shingles import by_text, chunks, mixed, shingle_sets
from veriscope.llm.textforms import canonical
from veriscope.session import staged

#: Counters of a sketch: 2**18, and more for inputs over 2**36 bytes, up to 2**24.
SKETCH_BITS, SKETCH_BYTES, SKETCH_MOST = 18, 36, 24
#: Postings that one bucket of tiles should hold at most on average, and characters that a task reads before it posts.
BUCKET_POSTINGS, TASK_CHARS = 1_000_000, 32_000_000
#: Candidate texts up to this number are broadcast (16 MB at most); more are joined by shuffling.
BROADCAST_TEXTS = 500_000
#: Pairs compared at once within a bucket, and shingles handled at once when tiles are split; both bound memory.
PAIRS_AT_ONCE, SPLIT_AT_ONCE = 1 << 21, 1 << 22
#: A tile is hot with more pairs inside its bands than this many classes have among each other.
HOT_TILE = 4096
#: Shingles by which a tile is split at most.
LEVELS = 4
#: Hot tiles known one by one up to this number; beyond it by the leading bits of their keys, which only adds candidates.
KNOWN_HOT, HOT_BITS = 1_000_000, 27
#: Larger sets have a bitmap of four words, smaller ones of two; a larger one is folded to meet a smaller one.
WIDE_FROM = 96


class Sets:
    """The sets of some texts: their sizes, signatures and one array of all sets, which start at ``at``."""

    def __init__(self, raw: list[str], k: int):
        texts = [canonical(t).lower() for t in raw]
        made = [shingle_sets(texts[lo:hi], k) for lo, hi in chunks([len(t) for t in texts])]
        self.sets = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in made)])
        self.n = np.concatenate([np.empty(0, np.int64), *(np.diff(y) for _, y in made)])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        raw_ = memoryview(self.sets).cast("B") if len(self.sets) else b""
        cut = (8 * self.at).tolist()
        # a text shorter than a shingle is its own set, known by its words and marks
        self.sig = np.array([xxhash.xxh3_64_intdigest(raw_[x:y], seed=1) if y > x else xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for x, y, t in zip(cut[:-1], cut[1:], texts, strict=True)], np.uint64).view(np.int64)

    def of(self, i: int) -> bytes:
        return self.sets[self.at[i] : self.at[i + 1]].tobytes()

    def kept(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sizes and sets of some texts, and which of these texts each shingle is of."""
        keep = np.zeros(len(self.n), bool)
        keep[first] = True
        n = self.n[keep]
        return n, self.sets[np.repeat(keep, self.n)], np.repeat(np.arange(len(n)), n)


class Corpus:
    """The texts of a table that have an id and a word, as (id, t, mask), and how many words make a shingle."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, k: int, mask_col: str | None = None):
        self.kind, self.k, self._read = df.schema[id_col].dataType.simpleString(), k, None
        mask = F.col(mask_col).cast("int") if mask_col else F.lit(0)
        self.rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), mask.alias("mask")).where(F.col("id").isNotNull() & F.col("t").rlike(r"[\p{L}\p{N}]"))
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()
        self.bits = min(SKETCH_MOST, SKETCH_BITS + max(0, size - SKETCH_BYTES)) if size < 60 else SKETCH_BITS  # 60 and more: unknown

    def _first_pass(self) -> DataFrame:
        """Signatures and counts of shingles from one pass over the texts, written down."""
        if self._read is None:
            k, bits = self.k, self.bits

            def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros(1 << bits, np.uint32)
                for b in batches:
                    s = Sets(b["t"].tolist(), k)
                    _, sets, _ = s.kept(np.unique(s.sig, return_index=True)[1])  # copies side by side count once
                    total += np.bincount(sets >> np.uint64(64 - bits), minlength=1 << bits).astype(np.uint32)
                    yield pd.DataFrame({"id": b["id"], "sig": s.sig, "mask": b["mask"], "n": s.n, "block": None, "c": None})
                counts = blocks.cut(total)
                yield pd.DataFrame({"id": None, "sig": None, "mask": None, "n": None, "block": counts["block"], "c": counts["c"]})

            self._read = staged(self.rows.mapInPandas(build, f"id {self.kind}, sig bigint, mask int, n bigint, block int, c binary"), "members")
        return self._read

    def members(self) -> DataFrame:
        """(id, sig, mask, n) of every text."""
        return self._first_pass().where("block is null").select("id", "sig", "mask", "n")

    def sketch(self) -> np.ndarray:
        """How many texts hold each of ``2**bits`` groups of shingles: fixed size whatever the number of texts."""
        return blocks.joined(self._first_pass().where("block is not null"), 1 << self.bits, "<u4")


def _bitmaps(sets: np.ndarray, doc: np.ndarray, n: int, parity: bool) -> np.ndarray:
    """Row per set: 256 bits that its shingles set, or with ``parity`` flip."""
    bit = (sets >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(24)
    out = np.zeros((n, 4), np.uint64)
    (np.bitwise_xor if parity else np.bitwise_or).at(out.reshape(-1), doc * 4 + (bit >> np.uint32(6)).astype(np.int64), np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64))
    return out


def _planes(a: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bytes of small numbers by place within each segment, so that the zeros lie together and compress."""
    start, size = np.repeat(first, many), np.repeat(many, many)
    out, at = np.empty(4 * len(a), np.uint8), 3 * start + np.arange(len(a))
    for j, byte in enumerate(a.astype("<u4").view(np.uint8).reshape(-1, 4).T):
        out[at + j * size] = byte
    return out


def _unplanes(blobs: pd.Series) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint32), *(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1) for x in blobs)])


def _runs(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``start[i]``, ``start[i] + 1``, ... ``many[i]`` numbers of each, in one array."""
    return np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def even_keys(spark: SparkSession, buckets: int) -> np.ndarray:
    """A number for each bucket such that hash partitioning puts every bucket in a partition of its own.

    Hashes of few numbers collide, and a task with three buckets takes three times as long. Beyond 10,000 buckets chance
    evens them out, and the numbers are just those of the buckets.
    """
    if buckets > 10_000:
        return np.arange(buckets, dtype=np.int32)
    tries = spark.range(int(buckets * (np.log(buckets) + 12)), numPartitions=1).select(F.col("id").cast("int").alias("id"))
    rows = tries.groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("part")).agg(F.min("id").alias("id")).collect()
    return np.array([r.id for r in sorted(rows)], np.int32) if len(rows) == buckets else np.arange(buckets, dtype=np.int32)


def _joined_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) + b)


@dataclass
class Hot:
    """The hot tiles of a level, as (bucket, low half of the key): one by one with their classes, or as bits of a hash."""

    buckets: int
    ids: np.ndarray
    classes: np.ndarray
    bits: np.ndarray | None = None

    def id(self, key: np.ndarray) -> np.ndarray:
        return bucket_of(key, self.buckets).astype(np.uint64) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)

    def _at(self, key: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.ids, self.id(key)), len(self.ids) - 1)

    def holds(self, key: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            cell = mixed(self.id(key)) >> np.uint64(64 - HOT_BITS)
            return (self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return self.ids[self._at(key)] == self.id(key) if len(self.ids) else np.zeros(len(key), bool)

    def size(self, key: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        """How many classes the tiles hold; ``otherwise`` for those not known one by one."""
        if not len(self.ids):
            return otherwise
        at = self._at(key)
        return np.where(self.ids[at] == self.id(key), self.classes[at], otherwise)


@dataclass
class Level:
    """What a level of tiles is posted by: the sketch that orders shingles, and which tiles are hot."""

    sketch: np.ndarray
    #: Tiles in cells of the sketch with a greater count would not fit a task: they are split before they are met.
    most: int
    hot: Hot | None = None

    def count(self, key: np.ndarray) -> np.ndarray:
        return self.sketch[(key >> np.uint64(64 - (len(self.sketch).bit_length() - 1))).astype(np.int64)]

    def split(self, key: np.ndarray) -> np.ndarray:
        too_many = self.count(key) > self.most
        return too_many if self.hot is None else too_many | self.hot.holds(key)


class Tiles:
    """The similarity bounds for one threshold; cross: only pairs with masks 1 and 2 on different sides."""

    def __init__(self, t: Fraction, cross: bool, block: int = HOT_TILE):
        self.num, self.den, self.cross, self.block = t.numerator, t.denominator, cross, block

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n + (-self.num * n // self.den) + 1, 0)

    def need(self, both: np.ndarray) -> np.ndarray:
        """The least overlap of two sets with so many members together."""
        return -(-self.num * both // (self.num + self.den))

    def fits(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether fingerprints allow an overlap of ``need``; a false answer is certain.

        Bitmaps: a bit that only one set has stands for a member that only it has. Parity fingerprints: two that differ in
        more bits than the sets may differ in members (the Hamming radius) are of sets that differ in more.
        """
        bits = lambda z: np.bitwise_count(z).sum(1, dtype=np.int64)
        if self.cross:
            return bits(x ^ y) <= n + m - 2 * need
        return np.minimum(n - bits(x & ~y), m - bits(y & ~x)) >= need

    def fold(self, wide: np.ndarray) -> np.ndarray:
        return wide[:, :2] ^ wide[:, 2:] if self.cross else wide[:, :2] | wide[:, 2:]

    def places(self, s: np.ndarray, n: np.ndarray, doc: np.ndarray, levels: list[Level], counting: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key of a tile, text, shingles skipped) of every posting of the last level of some sets.

        Where a level's tile is split, each of its members goes on with the shingles after the one met, in the order of the
        next level's sketch, as far as skipping them leaves enough. Sets so small that the shingles met may be all they
        share also go on together without another. ``counting``: all shingles left come out, for the last level's sketch.
        """
        by = by_text(levels[0].count(s).astype(np.uint64) << np.uint64(32) | s >> np.uint64(32), doc, len(n), s)
        key, start = s[by], np.cumsum(n) - n
        skip = np.arange(len(s)) - np.repeat(start, n)
        at = np.flatnonzero(skip < np.repeat(self.prefix(n), n))
        hot = levels[0].split(key[at])
        if len(levels) == 1:
            at = at[~hot]
            yield key[at], doc[at], skip[at]
        else:
            at = at[hot]
            yield from self._further(key[at], doc[at], skip[at], key, at + 1, (start + n)[doc[at]] - at - 1, n, levels, 1, counting)

    def _further(self, key: np.ndarray, doc: np.ndarray, skip: np.ndarray, every: np.ndarray, start: np.ndarray, many: np.ndarray, n: np.ndarray, levels: list[Level], met: int, counting: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The next level of postings with split tiles, which have ``many`` shingles left, from ``start`` in ``every``."""
        ends, lo = np.cumsum(many + 1), 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SPLIT_AT_ONCE, side="right")))
            k, d, p, left, m = key[lo:hi], doc[lo:hi], skip[lo:hi], every[_runs(start[lo:hi], many[lo:hi])], many[lo:hi]
            lo = hi
            of = np.repeat(np.arange(len(k)), m)
            further = _joined_keys(k[of], left)
            alone = np.flatnonzero(self.num * n[d] <= self.den * met)
            end = _joined_keys(k[alone], np.full(len(alone), met, np.uint64))
            if met == len(levels) - 1 and counting:
                yield np.concatenate([further, end]), np.concatenate([d[of], d[alone]]), np.concatenate([p[of], p[alone]])
                continue
            level = levels[met]
            order = by_text(level.count(further).astype(np.uint64) << np.uint64(32) | further >> np.uint64(32), of, len(k), further)
            further, left, begin = further[order], left[order], np.cumsum(m) - m
            now = p[of] + np.arange(len(of)) - begin[of]
            ok = np.flatnonzero(now < self.prefix(n)[d[of]])
            none = np.zeros(len(alone), np.int64)
            k2, d2, p2 = np.concatenate([further[ok], end]), np.concatenate([d[of[ok]], d[alone]]), np.concatenate([now[ok], p[alone]])
            hot = level.split(k2)
            if met == len(levels) - 1:
                yield k2[~hot], d2[~hot], p2[~hot]
            else:
                from_, rest = np.concatenate([ok + 1, none]), np.concatenate([(begin + m)[of[ok]] - ok - 1, none])
                yield from self._further(k2[hot], d2[hot], p2[hot], left, from_[hot], rest[hot], n, levels, met + 1, counting)

    def in_blocks(self, key: np.ndarray, doc: np.ndarray, skip: np.ndarray, sig: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings of tiles of so many classes, sent to every pair of blocks of the tile that has the class's own block."""
        many = np.maximum(1, -(-size // self.block))
        of = np.repeat(np.arange(len(key)), many)
        mine = (mixed(sig[doc].view(np.uint64)) % many.astype(np.uint64))[of].astype(np.int64)
        other = _runs(np.zeros(len(key), np.int64), many)
        pair = np.minimum(mine, other) * (1 << 31) + np.maximum(mine, other) + 1
        return _joined_keys(key[of], pair.astype(np.uint64)), doc[of], skip[of]

    SCHEMA = "q int, sig binary, n binary, mask binary, narrow binary, wide binary, count binary, h binary, p binary"

    def packed(self, h: np.ndarray, d: np.ndarray, p: np.ndarray, sig: np.ndarray, n: np.ndarray, mask: np.ndarray, wide: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """One row per bucket of tiles with its postings and the texts that they are of."""
        bucket = bucket_of(h, len(keys))
        texts = max(1, len(n))
        key = bucket * texts + d
        order = np.argsort(key, kind="stable")
        key, h, p = key[order], h[order], p[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(head, len(key)))
        docs, q = key[head] % texts, key[head] // texts
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
        held = np.diff(np.append(first, len(q)))
        large = n[docs] > WIDE_FROM
        ends = lambda x: np.concatenate([[0], np.cumsum(np.add.reduceat(x, first) if len(first) else x)])
        at, at_wide, at_post = ends(np.ones(len(docs), np.int64)), ends(large.astype(np.int64)), ends(count)
        column = lambda data, offsets: pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        columns = {
            "q": pa.array(keys[q[first]]), "sig": column(sig[docs], 8 * at), "n": column(_planes(n[docs], first, held), 4 * at), "mask": column(mask[docs], at),
            "narrow": column(self.fold(wide)[docs[~large]], 16 * (at - at_wide)), "wide": column(wide[docs[large]], 32 * at_wide), "count": column(_planes(count, first, held), 4 * at),
            "h": column((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), 4 * at_post), "p": column(np.minimum(p, 255).astype(np.uint8), at_post),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def post(self, s: Sets, mask: np.ndarray, levels: list[Level], keys: np.ndarray, whole: Level | None = None) -> Iterator[pa.RecordBatch]:
        """The postings of some texts at the last level; copies among them post once. ``whole``: what to compare in blocks."""
        first = np.sort(np.unique(np.stack([s.sig, mask]), axis=1, return_index=True)[1])
        n, sets, doc = s.kept(first)
        sig, mask = s.sig[first], mask[first].astype(np.uint8)
        wide = None
        for h, d, p in self.places(sets, n, doc, levels):
            if whole is not None:
                in_ = whole.split(h)
                h, d, p = h[in_], d[in_], p[in_]
                h, d, p = self.in_blocks(h, d, p, sig, whole.hot.size(h, whole.count(h).astype(np.int64)))
            if len(h):
                wide = _bitmaps(sets, doc, len(n), self.cross) if wide is None else wide
                yield self.packed(h, d, p, sig, n, mask, wide, keys)

    def meet(self, b: pd.DataFrame, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Pairs of signatures of one bucket that the bounds leave, or the tiles with more pairs than ``most`` classes have."""
        cat = lambda c, t: np.frombuffer(b"".join(b[c]), t)
        sig, n, mask, count = cat("sig", np.int64), _unplanes(b["n"]).astype(np.int64), cat("mask", np.uint8), _unplanes(b["count"])
        big = n > WIDE_FROM
        wide, at_wide = cat("wide", np.uint64).reshape(-1, 4), np.cumsum(big) - 1
        maps = np.empty((len(n), 2), np.uint64)
        maps[~big], maps[big] = cat("narrow", np.uint64).reshape(-1, 2), self.fold(wide)
        h, p, d = cat("h", np.uint32), cat("p", np.uint8).astype(np.int64), np.repeat(np.arange(len(sig)), count)
        # one posting per tile and class: copies in other tasks only add their sides
        order = np.lexsort((p, sig[d], n[d], h))
        h, p, d = h[order], p[order], d[order]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (sig[d[1:]] != sig[d[:-1]])
        sides = np.bitwise_or.reduceat(mask[d], np.flatnonzero(head)) if len(h) else mask[:0]
        h, p, d = h[head], p[head], d[head]

        def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Size and tile of each posting and how many later ones of its tile are in the band of sizes it can meet."""
            size, tile = n[d], np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else h
            span = int(size.max()) + 1 if len(h) else 1
            # the partner is no smaller; what the skipped shingles leave bounds how much larger it may be
            top = np.minimum(size * self.den // self.num, (size - p) * (self.num + self.den) // self.num - size)
            reach = np.searchsorted(tile * span + size, tile * span + np.clip(top, 0, span - 1), side="right")
            return size, tile, np.maximum(reach - np.arange(len(h)) - 1, 0)

        size, tile, limit = bands()
        if most is not None and len(h):
            pairs, classes = np.bincount(tile, weights=limit), np.bincount(tile)
            if (hot := pairs[tile] > most * (most - 1) / 2).any():
                lead = np.flatnonzero(hot & np.concatenate([[True], tile[1:] != tile[:-1]]))
                yield h[lead].astype(np.int64), classes[tile[lead]], np.zeros(0)
                h, p, d, sides = h[~hot], p[~hot], d[~hot], sides[~hot]
                size, tile, limit = bands()
        live = np.flatnonzero(limit > 0)
        left = limit[live]
        while len(live):
            ends = np.cumsum(left)
            take = max(1, int(np.searchsorted(ends, PAIRS_AT_ONCE, side="right")))
            i0, k0 = live[:take], left[:take]
            if take == 1 and k0[0] > PAIRS_AT_ONCE:  # one long row: its partners in pieces
                k0 = np.array([PAIRS_AT_ONCE])
                done = PAIRS_AT_ONCE
            else:
                done = 0
            i, j = np.repeat(i0, k0), _runs(i0 + 1 + limit[i0] - left[:take], k0)
            if done:
                left = left.copy()
                left[0] -= done
            else:
                live, left = live[take:], left[take:]
            need = self.need(size[i] + size[j])
            ok = size[j] - p[j] >= need
            if self.cross:
                x, y = sides[i], sides[j]
                ok &= ((x & 1) & (y >> 1) | (y & 1) & (x >> 1)).astype(bool)
            i, j, need = i[ok], j[ok], need[ok]
            a, c = d[i], d[j]
            ok = self.fits(maps[a], maps[c], size[i], size[j], need)
            a, c, need = a[ok], c[ok], need[ok]
            both = big[a] & big[c]
            if both.any():
                fit = self.fits(wide[at_wide[a[both]]], wide[at_wide[c[both]]], n[a[both]], n[c[both]], need[both])
                keep = np.ones(len(a), bool)
                keep[both] = fit
                a, c = a[keep], c[keep]
            if len(a):
                yield np.minimum(sig[a], sig[c]), np.maximum(sig[a], sig[c]), None


def _hot(found: DataFrame, buckets: int) -> Hot:
    """The hot tiles of a level; at most ``KNOWN_HOT`` of them or 2**HOT_BITS bits reach the driver."""
    keys = found.where("hot is not null").select("hot", F.col("sig_a").alias("classes"))
    none = np.empty(0, np.int64)
    if keys.count() <= KNOWN_HOT:
        rows = sorted(keys.collect())
        return Hot(buckets, np.array([r.hot for r in rows], np.int64).view(np.uint64), np.array([r.classes for r in rows], np.int64))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << (HOT_BITS - 3), np.uint8)
        for b in batches:
            cell = mixed(b["hot"].values.astype(np.int64).view(np.uint64)) >> np.uint64(64 - HOT_BITS)
            np.bitwise_or.at(total, (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8))
        yield blocks.cut(total)

    return Hot(buckets, none.view(np.uint64), none, blocks.joined(keys.mapInPandas(bits, "block int, c binary"), 1 << (HOT_BITS - 3), "u1", np.bitwise_or))


def similar_classes(corpus: Corpus, members: DataFrame, similarity: float, cross: bool = False, hot_tile: int = HOT_TILE, tile_postings: int = 4 * BUCKET_POSTINGS, levels_most: int = LEVELS) -> DataFrame:
    """Pairs of different classes (sig_a < sig_b) with their exact similarity of at least ``similarity``.

    ``hot_tile``: tiles with more pairs to bound than so many classes have are split; ``tile_postings``: tiles that may
    hold more are split unseen; ``levels_most``: by so many shingles at most, and then into blocks. No setting changes
    the result.
    """
    t = Fraction(similarity).limit_denominator(10_000)
    num, den, k, bits = t.numerator, t.denominator, corpus.k, corpus.bits
    tiles, spark = Tiles(t, cross, hot_tile), members.sparkSession
    postings = members.agg(F.sum(F.col("n") - F.ceil(F.col("n") * float(t)) + 1)).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Sets, np.ndarray]]:
        texts, masks, chars = [], [], 0
        for b in batches:
            some = b.column("t").to_pylist()
            texts += some
            masks.append(b.column("mask").to_numpy())
            chars += sum(map(len, some))
            if chars >= TASK_CHARS:
                yield Sets(texts, k), np.concatenate(masks)
                texts, masks, chars = [], [], 0
        if texts:
            yield Sets(texts, k), np.concatenate(masks)

    def candidates_of(levels: list[Level], buckets: int, most: int | None, whole: Level | None = None) -> DataFrame:
        shared, keys = spark.sparkContext.broadcast((levels, whole)), even_keys(spark, buckets)
        bucket = {int(k): i for i, k in enumerate(keys)}

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, mask in held(batches):
                yield from tiles.post(s, mask, shared.value[0], keys, shared.value[1])

        def meet(b: pd.DataFrame) -> pd.DataFrame:
            pairs, hot = [np.empty((0, 2), np.int64)], [np.empty((0, 2), np.int64)]
            for x, y, z in tiles.meet(b, most):
                if z is None:
                    pairs.append(np.unique(np.stack([x, y], 1), axis=0))
                else:
                    hot.append(np.stack([y, x | bucket[int(b["q"].iloc[0])] << 32], 1))
            p, z = np.unique(np.concatenate(pairs), axis=0), np.concatenate(hot)
            return pd.DataFrame({"sig_a": np.concatenate([p[:, 0], z[:, 0]]), "sig_b": np.concatenate([p[:, 1], z[:, 1]]), "hot": pd.Series(np.concatenate([p[:, 1], z[:, 1]])).astype("Int64").where(np.arange(len(p) + len(z)) >= len(p))})

        # tasks follow the number of buckets, not the session's partitions
        blobs = corpus.rows.mapInArrow(post, Tiles.SCHEMA).repartition(buckets, "q")
        return staged(blobs.groupBy("q").applyInPandas(meet, "sig_a bigint, sig_b bigint, hot bigint").distinct(), "candidates")

    def sketch_of(levels: list[Level]) -> np.ndarray:
        """How often the shingles left occur in the tiles that the level before splits."""
        shared = spark.sparkContext.broadcast(levels)

        def count(batches: Iterator[pa.RecordBatch]) -> pd.DataFrame:
            total = np.zeros(1 << bits, np.uint32)
            for s, _ in held(batches):
                n, sets, doc = s.kept(np.unique(s.sig, return_index=True)[1])
                for h, _, _ in tiles.places(sets, n, doc, shared.value, True):
                    total += np.bincount(h >> np.uint64(64 - bits), minlength=1 << bits).astype(np.uint32)
            return blocks.cut(total)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pandas(count(batches), pa.schema([("block", pa.int32()), ("c", pa.binary())]), preserve_index=False)

        return blocks.joined(corpus.rows.mapInArrow(run, "block int, c binary"), 1 << bits, "<u4")

    levels, candidates = [Level(corpus.sketch(), tile_postings)], None
    buckets = max(1, parts, -(-postings // BUCKET_POSTINGS))
    while True:
        found = candidates_of(levels, buckets, hot_tile)
        pairs = found.where("hot is null").select("sig_a", "sig_b")
        candidates = pairs if candidates is None else candidates.union(pairs)
        last = levels[-1]
        last.hot = _hot(found, buckets)
        if not len(last.hot.ids) and last.hot.bits is None and not (last.sketch > last.most).any():
            break
        if len(levels) == levels_most:
            free = Level(last.sketch, 2**32)
            rest = candidates_of([*levels[:-1], free], buckets, None, last)
            candidates = candidates.union(rest.select("sig_a", "sig_b"))
            break
        sketch = sketch_of([*levels, Level(last.sketch, 2**32)])
        if not sketch.any():
            break
        levels.append(Level(sketch, tile_postings))
        buckets = max(1, parts, int(-(-sketch.sum(dtype=np.int64) // BUCKET_POSTINGS)))
    if len(levels) > 1:
        candidates = candidates.distinct()

    met = candidates.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).distinct()
    speakers = members.join(met, "sig", "left_semi").groupBy("sig").agg(F.min("id").alias("id")).select("id").distinct()
    if speakers.count() <= BROADCAST_TEXTS:
        speakers = F.broadcast(speakers)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = Sets(b["t"].tolist(), k)
            yield pd.DataFrame({"sig": s.sig, "sh": [s.of(i) for i in range(len(s.n))]})

    # an id may stand for several texts, and a text for several ids: one set per signature is kept
    sets = corpus.rows.join(speakers, "id", "left_semi").mapInPandas(again, "sig bigint, sh binary").groupBy("sig").agg(F.first("sh").alias("sh"))
    a, b = sets.select(F.col("sig").alias("sig_a"), F.col("sh").alias("a")), sets.select(F.col("sig").alias("sig_b"), F.col("sh").alias("b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            inter, union = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for i, (p, q) in enumerate(zip(x["a"], x["b"], strict=True)):
                w = np.frombuffer(p + q, np.uint64).copy()
                w.sort()
                inter[i] = np.count_nonzero(w[1:] == w[:-1])
                union[i] = len(w) - inter[i]
            ok = inter * den >= num * union
            yield pd.DataFrame({"sig_a": x["sig_a"][ok], "sig_b": x["sig_b"][ok], "similarity": (inter / np.maximum(union, 1))[ok]})

    return candidates.join(a, "sig_a").join(b, "sig_b").mapInPandas(verify, "sig_a bigint, sig_b bigint, similarity double")
